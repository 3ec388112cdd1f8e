"""Registered queries over the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.llm import alignment, backoff, huffman, language, neardup, packing, pages, pii, quality, sampling, sharding, topk, trie
from retailscope.llm.common import fold, kept, table
from retailscope.llm.registry import CHECKS, QUERIES


def op1_language_field(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    field = language.fit(language.passages_of(docs.filter(~F.col("held_out")), F.col("lang"), F.col("doc_id"), F.col("text")))
    found = language.identify(docs.select("doc_id", "held_out", "text"), field)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op2_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    path = huffman.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return huffman.read(spark, path)


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op4_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(table(spark, folder, "pages"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    statistics = kept(quality.text_statistics(table(spark, folder, "documents")), "text-statistics")
    rules = quality.learn(statistics, table(spark, folder, "labels"))
    return quality.verdicts(statistics, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "rule_text")


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(pii.find(table(spark, folder, "documents")))


def op7_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.score_texts(table(spark, folder, "documents"), fold(F.col("doc_id"), 7) == 2)


def op8_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), k=2, seed=8)


def op9_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op10_block_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, k=5, scale=256.0)


def op11_label_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, folder, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("same"))
    placed = sharding.balanced(docs, [F.col("same")], shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_token_groups(spark: SparkSession, folder: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    groups = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    # the digest stands for the groups from here on, so that they needn't be stored
    found = alignment.align(table(spark, folder, "documents"), *paths).withColumn("groups", groups).withColumnRenamed("groups", "groups_sha256")
    aligned = kept(found, "aligned", "zstd")
    sums = alignment.with_link_sums(aligned, alignment.link_counts(aligned, *paths))
    return sums.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 6
    found = trie.build(table(spark, folder, "conversations"), c - c % 100, head, 5)
    ends = trie.digests(trie.ends_of(found))
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return trie.nodes_of(found).join(ends, trie.KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest)


CHECKS["op10_block_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

CHECKS["op13_prefix_trie"] = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  -- CRC-32 of the decimal id, bit by bit: a byte enters before each eighth bit
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(conv_id::VARCHAR, (i // 8 + 1)::INTEGER, 1))::BIGINT ELSE 0::BIGINT END)),
      lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT k.conv_id, 0 AS part, t.place, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.place < k.h
  UNION ALL SELECT k.conv_id, 1, t.place, t.role, t.text FROM k JOIN t ON t.conv_id = k.conv_id AND t.place >= k.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, text, list({'role': role, 'text': text}) OVER w AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL SELECT conv_id, 0, '', [] FROM k),
i AS (SELECT conv_id, depth, text, min(conv_id) OVER (PARTITION BY depth, path) AS first, max(depth) OVER (PARTITION BY conv_id) AS turns FROM p),
n AS (
  SELECT first, depth, count(*) AS n_convs, (count(*) - 1) * length(any_value(text)) AS saved, max(turns) AS deepest,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = turns), '')) AS ends_sha256
  FROM i GROUP BY first, depth),
-- a node's smallest member has all prefixes of the node
a AS (SELECT n.first, n.depth, n.saved, n.deepest, u.first AS top, u.depth AS top_depth FROM n JOIN i u ON u.conv_id = n.first AND u.depth <= n.depth),
s AS (
  SELECT top, top_depth, sum(saved) AS saved_tokens, count_if(deepest = depth) AS n_leaves, count_if(depth = top_depth + 1) AS n_children
  FROM a GROUP BY top, top_depth)
SELECT n.first AS conv_id, n.depth, u.first AS parent_conv_id, n.n_convs, CAST(s.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s ON s.top = n.first AND s.top_depth = n.depth LEFT JOIN i u ON u.conv_id = n.first AND u.depth = n.depth - 1"""

QUERIES |= {f.__name__: f for f in (op1_language_field, op2_huffman_ids, op3_best_fit_packing, op4_page_text, op5_quality_rules, op6_personal_data, op7_backoff_scores, op8_sampled_pieces, op9_simhash_groups, op10_block_top_k, op11_label_shards, op12_token_groups, op13_prefix_trie)}

__all__ = ["CHECKS", "QUERIES"]
