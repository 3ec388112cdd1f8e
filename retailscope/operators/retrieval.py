"""Nearest chunks per question, the similarity guard, citations and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import rows
from retailscope.functions.texts import excerpt, says_insufficient, stripped
from retailscope.operators import vector_index
from retailscope.session import staged

TOP_K = 4
THRESHOLD = 0.40
MAX_TOP_K = 10
QUESTION_LENGTH = (3, 500)

# Instruction in front of an embedded question, the guard's answer, and the fallback.
QUERY_INSTRUCTION = "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "
GUARD_MESSAGE = (
    "Insufficient data: the knowledge base has no section relevant enough to answer this question. "
    "It covers this company's 2021-2025 sales, products, customers, regions, ratings and marketing."
)
FALLBACK = "The language model was unavailable, so here is the most relevant knowledge-base section verbatim [1] (%s > %s):\n\n%s"


def query_text(question: Column) -> Column:
    """A question as it is embedded; chunks are embedded bare."""
    return F.concat(F.lit(QUERY_INSTRUCTION), question)


def attach_embeddings(texts: DataFrame, vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Join supplied vectors; rows without one, or with the wrong width, say so in `embedding_error`."""
    joined = texts.join(vectors.select(key, "embedding"), key, "left")
    error = F.when(F.col("embedding").isNull(), "no embedding").when(
        F.size("embedding") != dim, F.format_string(f"%d values instead of {dim}", F.size("embedding"))
    )
    return joined.withColumn("embedding_error", error)


def top_k_similar(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, question_bytes: int = vector_index.QUESTION_BYTES) -> DataFrame:
    """The k nearest chunks per question by cosine: (query_id, chunk_id, similarity, rank).

    `queries` is (query_id, embedding), `chunks` (chunk_id, embedding). Chunks are laid out by cells first, and questions
    stay a table that meets the cells in parts of about `question_bytes`; cells that can't hold a hit are skipped. For
    several searches of the same chunks build the index once and call `vector_index.search`. Ties go by chunk id.
    Questions meet vectors of their own width only; vectors that are missing, of length zero or not finite take no part
    (`attach_embeddings` and `store_report` name them).
    """
    return _rounded(vector_index.search(vector_index.build(chunks), queries, k, question_bytes))


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("similarity", F.round("similarity", 4))


def guard(queries: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per question: best similarity before the guard (0 without hits), hits kept, and whether it fired.

    The threshold meets the rounded similarity.
    """
    summary = hits.groupBy("query_id").agg(
        F.max("similarity").alias("best"), F.count_if(F.col("similarity") >= threshold).alias("kept")
    )
    joined = queries.select("query_id").join(summary, "query_id", "left")
    kept = F.coalesce("kept", F.lit(0))
    return joined.select(
        "query_id",
        F.coalesce("best", F.lit(0.0)).alias("best_similarity"),
        kept.alias("kept_hits"),
        (kept == 0).alias("guard_triggered"),
    )


def kept_hits(hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return hits.where(F.col("similarity") >= threshold)


def citations(hits: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Numbered sources of each answer, with an excerpt of the section."""
    shown = chunks.select("chunk_id", "doc_title", "section_title", "source_file", "chunk_text")
    return kept_hits(hits, threshold).join(shown, "chunk_id").select(
        "query_id",
        F.col("rank").alias("n"),
        "chunk_id",
        "doc_title",
        "section_title",
        "source_file",
        "similarity",
        excerpt(F.col("chunk_text")).alias("excerpt"),
    )


# Fixed value: the instructions of the grounded prompt.
PROMPT = (
    "You are a business analyst assistant for an e-commerce company. Answer the question using ONLY the numbered "
    "context sections below.\n\nRules:\n"
    "- Use only facts and numbers that appear in the context. Do not add outside knowledge, estimates, or numbers "
    "that are not in the context.\n"
    "- Cite the section(s) you used by number in square brackets, e.g. [1] or [2][3], right after the sentence "
    "that relies on them. Every factual sentence needs a citation.\n"
    "- If the context does not contain the information needed to answer, reply with exactly the words "
    '"INSUFFICIENT DATA" as the first line, followed by one sentence saying what the context does cover instead. '
    "Do not guess.\n"
    "- Be concise: a direct answer first, then at most a few supporting sentences. Plain text, no markdown headings.\n\n"
    "Context:\n%s\n\nQuestion: %s"
)


def contexts(hits: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The kept sections of a question as one numbered text, best first; at most k sections each."""
    shown = chunks.select("chunk_id", "doc_title", "section_title", "chunk_text")
    kept = kept_hits(hits, threshold).join(shown, "chunk_id")
    cells = F.array_sort(F.collect_list(F.struct("rank", "doc_title", "section_title", "chunk_text")))
    block = F.transform(
        cells, lambda c: F.format_string("[%d] %s > %s\n%s", c["rank"], c["doc_title"], c["section_title"], c["chunk_text"])
    )
    return kept.groupBy("query_id").agg(F.array_join(block, "\n\n").alias("context"))


def prompts(queries: DataFrame, hits: DataFrame, chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The grounded prompt of every question that passes the guard (query_id, question needed)."""
    joined = queries.select("query_id", "question").join(contexts(hits, chunks, threshold), "query_id")
    return joined.select("query_id", F.format_string(PROMPT, F.col("context"), F.col("question")).alias("prompt"))


def route_answers(
    queries: DataFrame, hits: DataFrame, chunks: DataFrame, replies: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """The answer of each question: the guard's refusal, the model's reply, or the best section verbatim.

    A reply that opens with the insufficient-data marker is an answer, but not answered.
    """
    guarded = guard(queries, hits, threshold)
    best = kept_hits(hits, threshold).where("rank = 1").join(
        chunks.select("chunk_id", "doc_title", "section_title", "chunk_text"), "chunk_id"
    )
    joined = (
        guarded.join(best.select("query_id", "doc_title", "section_title", "chunk_text"), "query_id", "left")
        .join(replies.select("query_id", "reply"), "query_id", "left")
    )
    fired, replied = F.col("guard_triggered"), F.col("reply").isNotNull()
    verbatim = F.format_string(FALLBACK, F.col("doc_title"), F.col("section_title"), F.col("chunk_text"))
    return joined.select(
        "query_id",
        "best_similarity",
        F.when(fired, False).when(replied, ~says_insufficient(F.col("reply"))).otherwise(True).alias("answered"),
        F.when(fired, GUARD_MESSAGE).when(replied, stripped(F.col("reply"))).otherwise(verbatim).alias("answer"),
        F.when(fired, "guard").when(replied, "model").otherwise("extractive_fallback").alias("generated_by"),
    )


def valid_questions(queries: DataFrame) -> DataFrame:
    """Questions of acceptable length."""
    low, high = QUESTION_LENGTH
    return queries.where(F.length("question").between(low, high))


def calibration(queries: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Where a threshold could lie: weakest in-domain against strongest off-topic probe.

    `queries` has query_id and probe: in_domain, off_topic or near_topic.
    """
    best = staged(
        queries.select("query_id", "probe").join(hits.where("rank = 1").select("query_id", "similarity"), "query_id", "left"),
        "probes",
    ).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    near = F.col("probe") == "near_topic"
    sums = best.agg(
        F.min(F.when(F.col("probe") == "in_domain", F.col("similarity"))).alias("weakest_in_domain"),
        F.max(F.when(F.col("probe") == "off_topic", F.col("similarity"))).alias("strongest_off_topic"),
        F.count_if(near & (F.col("similarity") >= threshold)).alias("near_topic_passing"),
        F.count_if(near).alias("near_topic_probes"),
    )
    low, high = F.col("weakest_in_domain"), F.col("strongest_off_topic")
    return sums.select(
        low,
        high,
        F.round(low - high, 4).alias("gap"),
        F.bround((low + high) / 2, 2).alias("midpoint"),
        "near_topic_passing",
        "near_topic_probes",
    )


def approximate_top_k(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, question_bytes: int = vector_index.QUESTION_BYTES) -> DataFrame:
    """Nearest chunks by an index of cells and codes, with `candidates`, the vectors read for a question.

    How many those are follows from the codes' bounds and is not fixed; no hit is lost.
    """
    return _rounded(vector_index.search_by_codes(vector_index.build(chunks), queries, k, question_bytes))


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found."""
    found = exact.select("query_id", "chunk_id").join(
        approximate.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left"
    )
    return found.agg(rows().alias("exact_hits"), F.count("hit").alias("found")).withColumn(
        "recall", F.round(F.col("found") / F.nullif("exact_hits", F.lit(0)), 4)
    )
