"""Chunking and retrieval with their checks.

Chunks are the documents' sections and the embedding table; the questions are one per label, the
mean vector of the label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from retailscope.functions import texts
from retailscope.functions.vectors import cosine_similarity, norm
from retailscope.operators import chunking, retrieval
from retailscope.plans.registry import add
from retailscope.session import staged

DIM = 64


def documents(s):
    return s.raw("documents").selectExpr("doc_id", "concat('doc-', cast(doc_id as string), '.md') AS source_file", "text")


def sections(s):
    return chunking.chunk_documents(documents(s))


# the same splitting by lines: numbered lines, running heading count, lines put together again
LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10))) AS line,
  generate_subscripts(string_split(regexp_replace(text, '\r\n|[\r\x0b\x0c\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)), 1) AS i FROM documents),
m AS (SELECT *, starts_with(line, '## ') AS head, i = 1 AND starts_with(line, '# ') AS title FROM l),
n AS (SELECT *, sum(head::int) OVER (PARTITION BY doc_id ORDER BY i) AS section_index FROM m),
g AS (SELECT doc_id, section_index, max(line) FILTER (head) AS h, string_agg(line, chr(10) ORDER BY i) FILTER (NOT head AND NOT title) AS body FROM n GROUP BY 1, 2),
t AS (SELECT doc_id, trim(regexp_replace(line[3:], '^\s+|\s+$', '', 'g')) AS title FROM m WHERE title),
c AS (SELECT g.doc_id, 'doc-' || g.doc_id || '.md' AS source_file, coalesce(t.title, 'doc-' || g.doc_id) AS doc_title, cast(section_index as int) AS section_index,
  CASE WHEN section_index = 0 THEN 'About this document' ELSE regexp_replace(h[4:], '^\s+|\s+$', '', 'g') END AS section_title,
  regexp_replace(body, '^[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+|[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+$', '', 'g') AS chunk_text
  FROM g LEFT JOIN t USING (doc_id)),
s AS (SELECT * FROM c WHERE length(chunk_text) > 0)"""

add(
    "r1_section_chunks",
    lambda s: sections(s).select("doc_id", "doc_title", "section_index", "section_title", "chunk_text"),
    LINES + " SELECT doc_id, doc_title, section_index, section_title, chunk_text FROM s",
)
add(
    "r2_chunk_metadata",
    lambda s: chunking.with_metadata(sections(s), "supplied", DIM).select(
        "doc_id", "metadata.source_file", "metadata.section_index", "metadata.word_count", F.md5("embedding_input").alias("embedding_input_md5")
    ),
    LINES
    + r""" SELECT doc_id, source_file, section_index, cast(len(regexp_extract_all(chunk_text, '\S+')) as int) AS word_count,
  md5(doc_title || chr(10) || section_title || chr(10) || chunk_text) AS embedding_input_md5 FROM s""",
)
add(
    "r3_chunks_per_document",
    lambda s: chunking.chunks_per_document(sections(s)),
    LINES + " SELECT source_file, count(*) AS chunks FROM s GROUP BY 1",
)


def chunk_vectors(s):
    return s.raw("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def label_queries(s):
    """One question per label: the mean of its vectors."""
    long = s.raw("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cells = F.array_sort(F.collect_list(F.struct("i", "x")))
    vectors = means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.transform(cells, lambda c: c["x"]).alias("embedding"))
    return vectors.withColumn("question", F.concat(F.lit("Which passages are like label "), F.col("query_id").cast("string"), F.lit("?")))


HITS = """WITH e AS (SELECT vec_id, embedding::double[] AS v, label FROM embeddings),
x AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
a AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
q AS (SELECT label::bigint AS query_id, list(x ORDER BY i) AS v FROM a GROUP BY 1),
d AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(q.v, e.v) AS sim FROM q, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, chunk_id) AS rank FROM d),
h AS (SELECT query_id, chunk_id, round(sim, 4) AS similarity, cast(rank as int) AS rank FROM r WHERE rank <= 4)"""


def hits(s, k: int = retrieval.TOP_K):
    return retrieval.top_k_similar(label_queries(s), chunk_vectors(s), k)


add("r6_top_k", hits, HITS + " SELECT * FROM h")
add(
    "r6_top_k_blocked",
    lambda s: retrieval.top_k_similar(label_queries(s), chunk_vectors(s), question_bytes=1_500),
    HITS + " SELECT * FROM h",
)
add(
    "r5_cosine_similarity",
    lambda s: chunk_vectors(s)
    .withColumn("q", F.explode(label_queries(s).agg(F.collect_list(F.struct("query_id", "embedding"))).scalar()))  # ten questions
    .select("q.query_id", "chunk_id", (F.round(cosine_similarity(F.col("embedding"), F.col("q.embedding")), 4) + 0.0).alias("similarity")),
    HITS + " SELECT query_id, chunk_id, round(sim, 4) + 0.0 AS similarity FROM d",
)
add(
    "x15_vector_norms",
    lambda s: chunk_vectors(s).select("chunk_id", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 5).alias("length")),
    "SELECT vec_id AS chunk_id, cast(len(embedding) as int) AS dims, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) AS length FROM embeddings",
)
GUARD_AT = 0.75
add(
    "r7_guard",
    lambda s: retrieval.guard(label_queries(s), hits(s), GUARD_AT),
    HITS
    + f""" SELECT query_id, max(similarity) AS best_similarity, count(*) FILTER (similarity >= {GUARD_AT}) AS kept_hits,
  count(*) FILTER (similarity >= {GUARD_AT}) = 0 AS guard_triggered FROM h GROUP BY 1""",
)


def stored_chunks(s):
    """Document texts with the vectors that carry the same number."""
    return s.raw("documents").selectExpr(
        "doc_id AS chunk_id", "source AS doc_title", "lang AS section_title", "concat('doc-', cast(doc_id as string), '.md') AS source_file", "text AS chunk_text"
    )


add(
    "r8_citations",
    lambda s: retrieval.citations(hits(s), stored_chunks(s), 0.0),
    HITS
    + r""" SELECT query_id, rank AS n, chunk_id, source AS doc_title, lang AS section_title, 'doc-' || doc_id || '.md' AS source_file, similarity,
  regexp_replace(text[1:200], '\s+$', '') || CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS excerpt FROM h JOIN documents ON doc_id = chunk_id WHERE similarity >= 0""",
)
add(
    "x16_numbered_context",
    lambda s: retrieval.contexts(hits(s), stored_chunks(s), 0.0).select("query_id", F.md5("context").alias("context_md5")),
    HITS
    + """ SELECT query_id, md5(string_agg('[' || rank || '] ' || source || ' > ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_md5
FROM h JOIN documents ON doc_id = chunk_id GROUP BY 1""",
)
BEFORE, BETWEEN, _ = (part.replace("'", "''") for part in retrieval.PROMPT.split("%s"))
add(
    "r9_prompts",
    lambda s: retrieval.prompts(label_queries(s), hits(s), stored_chunks(s), 0.0).select("query_id", F.md5("prompt").alias("prompt_md5")),
    HITS
    + f""", c AS (SELECT query_id, string_agg('[' || rank || '] ' || source || ' > ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM h JOIN documents ON doc_id = chunk_id GROUP BY 1)
SELECT query_id, md5('{BEFORE}' || context || '{BETWEEN}' || 'Which passages are like label ' || query_id || '?') AS prompt_md5 FROM c""",
)


def replies(s):
    """Assistant turns of the conversations as replies; some questions get none."""
    turns = s.raw("conversations").where("role = 'assistant'")
    first = turns.groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("reply"))
    marked = F.when(F.col("query_id") == 4, F.concat(F.lit("  insufficient data\n"), F.col("reply"))).otherwise(F.col("reply"))
    return first.where("query_id <> 5").select("query_id", marked.alias("reply"))


add(
    "r10_answer_routing",
    lambda s: retrieval.route_answers(label_queries(s), hits(s), stored_chunks(s), replies(s), GUARD_AT).select(
        "query_id", "best_similarity", "answered", "generated_by"
    ),
    HITS
    + f""", y AS (SELECT conv_id AS query_id FROM conversations WHERE role = 'assistant' AND conv_id <> 5 GROUP BY 1),
k AS (SELECT query_id, max(similarity) AS best_similarity FROM h GROUP BY 1)
SELECT k.query_id, best_similarity, best_similarity >= {GUARD_AT} AND k.query_id <> 4 AS answered,
  CASE WHEN best_similarity < {GUARD_AT} THEN 'guard' WHEN y.query_id IS NULL THEN 'extractive_fallback' ELSE 'model' END AS generated_by
FROM k LEFT JOIN y ON y.query_id = k.query_id""",
)


def probes(s):
    probe = F.when(F.col("query_id") <= 4, "in_domain").when(F.col("query_id") <= 7, "off_topic").otherwise("near_topic")
    return label_queries(s).withColumn("probe", probe)


add(
    "r11_calibration",
    lambda s: retrieval.calibration(probes(s), hits(s, 1), GUARD_AT),
    HITS
    + f""", b AS (SELECT query_id, max(similarity) AS s FROM h GROUP BY 1),
w AS (SELECT min(s) FILTER (query_id <= 4) AS lo, max(s) FILTER (query_id BETWEEN 5 AND 7) AS hi, count(*) FILTER (query_id > 7 AND s >= {GUARD_AT}) AS p,
  count(*) FILTER (query_id > 7) AS n FROM b)
SELECT lo AS weakest_in_domain, hi AS strongest_off_topic, round(lo - hi, 4) AS gap, round_even((lo + hi) / 2, 2) AS midpoint, p AS near_topic_passing,
  n AS near_topic_probes FROM w""",
)
def share_read(s):
    """Questions and vectors, the hits found of those that there are, and whether a tenth of the vectors at most were read."""
    found = staged(retrieval.approximate_top_k(label_queries(s), chunk_vectors(s)), "approximate-hits")
    read = found.where("rank = 1").agg(F.count(F.lit(1)).alias("questions"), F.sum("candidates").alias("read"))
    total = chunk_vectors(s).agg(F.count("embedding").alias("vectors"))
    told = retrieval.recall(found, hits(s))
    return read.join(F.broadcast(total)).join(F.broadcast(told)).select("questions", "vectors", "exact_hits", "found", "recall", (F.col("read") * 10 <= F.col("questions") * F.col("vectors")).alias("few_read"))


add(
    "r12_approximate_neighbours",
    lambda s: retrieval.approximate_top_k(label_queries(s), chunk_vectors(s)).drop("candidates"),
    HITS + " SELECT * FROM h",
)
add(
    "r12_share_read",
    share_read,
    HITS
    + """ SELECT count(DISTINCT query_id) AS questions, (SELECT count(embedding) FROM embeddings) AS vectors, count(*) AS exact_hits, count(*) AS found,
  1.0::double AS recall, true AS few_read FROM h""",
)
add(
    "r4_attached_embeddings",
    lambda s: retrieval.attach_embeddings(
        documents(s).select(F.col("doc_id").alias("chunk_id"), "source_file"), chunk_vectors(s), "chunk_id", DIM
    ).select("chunk_id", "source_file", "embedding_error"),
    """SELECT doc_id AS chunk_id, 'doc-' || doc_id || '.md' AS source_file, CASE WHEN vec_id IS NULL THEN 'no embedding' END AS embedding_error
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
add(
    "q15_vector_store",
    lambda s: chunking.store_report(s.raw("embeddings"), DIM, "label"),
    f"SELECT label, count(*) AS chunks, count(*) FILTER (len(embedding) <> {DIM}) AS wrong_dimension FROM embeddings GROUP BY 1",
)
add(
    "s9_document_scan",
    lambda s: documents(s).select("doc_id", "source_file", F.length("text").alias("characters")),
    "SELECT doc_id, 'doc-' || doc_id || '.md' AS source_file, cast(length(text) as int) AS characters FROM documents",
)
add(
    "x11_reply_marker",
    lambda s: s.raw("conversations").select("conv_id", "turn", texts.says_insufficient(F.concat(F.lit(" \n"), F.col("text"))).alias("insufficient")),
    r"SELECT conv_id, turn, starts_with(upper(regexp_replace(text, '^\s+', '')), 'INSUFFICIENT DATA') AS insufficient FROM conversations",
)
add(
    "x12_excerpts",
    lambda s: s.raw("documents").select("doc_id", texts.excerpt(F.col("text")).alias("excerpt")),
    r"SELECT doc_id, regexp_replace(text[1:200], '\s+$', '') || CASE WHEN length(text) > 200 THEN '…' ELSE '' END AS excerpt FROM documents",
)
add(
    "x13_word_counts",
    lambda s: s.raw("documents").select("doc_id", texts.word_count(F.col("text")).alias("words")),
    r"SELECT doc_id, cast(len(regexp_extract_all(text, '\S+')) as int) AS words FROM documents",
)
