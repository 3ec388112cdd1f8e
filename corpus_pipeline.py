"""Corpus pipeline: five stages over `documents`, each working on all that its predecessor kept.

All stages but the last keep the columns of `documents`. What each decides on odd rows is said in its operator:
documents without letters go in the first stage, and with them missing and empty texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.llm import language, neardup, packing, pii, quality
from retailscope.llm.common import kept, table

#: Share of its words that a document's language must have.
SURE = 0.5
#: Words that a packing task remembers, and bytes that it encodes together; fewer than alone, since other stages have filled
#: the executors before.
CACHED, TOGETHER = 200_000, 5_000_000


def one_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by at least half of their words; mixtures and texts without letters go."""
    field = language.fit(language.passages_of(docs, F.col("lang"), F.col("doc_id"), F.col("text")))
    found = language.identify(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), field)
    return found.filter((F.col("language.lang") != language.UNKNOWN) & (F.col("language.score") >= SURE)).select("row.*")


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and all learned rules."""
    labels = table(spark, sf_dir, "labels")
    # of all documents, so that their few numbers meet the labels and not their texts
    told = kept(quality.text_statistics(docs), "text-statistics")
    rules = quality.learn(told.join(labels.select("doc_id"), "doc_id", "left_semi"), labels)
    rows = docs.select(F.struct(*docs.columns).alias("doc_id"), F.col("text"))
    return quality.verdicts(quality.text_statistics(rows), rules).filter("kept").select("doc_id.*")


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash fingerprints within 3 bits, or five-word shingles with a similarity
    of 0.8 or more."""
    return neardup.one_of_near(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by the name of its kind, and the characters counted again."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Few sequences of at most 1024 tokens from all that is left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024, cached=CACHED, together=TOGETHER)


STAGES = [
    ("language ID", one_language),
    ("quality rules", good_text),
    ("SimHash near-dedup", no_copies),
    ("PII", no_personal_data),
    ("best-fit packing", pack_documents),
]
#: The stages hash, learn and tokenise in ways that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = kept(docs, f"stage-{at + 1}")
    return docs
