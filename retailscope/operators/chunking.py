"""Section chunks of markdown documents, and the chunk store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import count_where, rows
from retailscope.functions.texts import normal_lines, stripped, word_count

# Fixed value: title of the text before the first section heading.
PREAMBLE = "About this document"


def chunk_documents(documents: DataFrame) -> DataFrame:
    """One row per non-empty section of each document (source_file, text).

    A document splits at lines that start with `## `; the text before them is section 0. Empty
    sections are dropped but still count in the index. A narrow transformation: no shuffle, and a
    document is never taken apart into line rows.
    """
    kept = [c for c in documents.columns if c != "text"]
    # one step per projection, so that no text is normalised or cut twice
    normal = documents.select(*kept, normal_lines(F.col("text")).alias("lines"))
    titled = F.col("lines").startswith("# ")
    heading = F.regexp_extract("lines", r"^# ([^\n]*)", 1)
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    base = normal.select(
        *kept,
        F.when(titled, stripped(heading)).otherwise(stem).alias("doc_title"),
        F.when(titled, F.regexp_replace("lines", r"^# [^\n]*\n?", "")).otherwise(F.col("lines")).alias("body"),
    )
    parts = F.posexplode(F.split("body", r"(?<![^\n])## ")).alias("section_index", "part")
    sections = base.select(*kept, "doc_title", parts)
    first = F.col("section_index") == 0
    title = F.when(first, PREAMBLE).otherwise(stripped(F.regexp_extract("part", r"^[^\n]*", 0)))
    text = F.when(first, F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    chunks = sections.select(*kept, "doc_title", title.alias("section_title"), "section_index", stripped(text).alias("chunk_text"))
    return chunks.where(F.length("chunk_text") > 0)


def embedding_input() -> Column:
    """What is embedded: both titles and the text, one per line. Only the text is stored."""
    return F.concat_ws("\n", "doc_title", "section_title", "chunk_text")


def with_metadata(chunks: DataFrame, embedding_model: str, embedding_dim: int) -> DataFrame:
    """Adds the metadata struct of a stored chunk and the text to embed."""
    metadata = F.struct(
        "source_file",
        F.col("section_index").cast("int").alias("section_index"),
        word_count(F.col("chunk_text")).cast("int").alias("word_count"),
        F.lit(embedding_model).alias("embedding_model"),
        F.lit(embedding_dim).alias("embedding_dim"),
    )
    return chunks.withColumns({"metadata": metadata, "embedding_input": embedding_input()})


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(rows().alias("chunks"))


def store_report(chunks: DataFrame, dim: int, by: str) -> DataFrame:
    """Stored chunks and wrong vector widths, per document."""
    wrong = F.coalesce(F.size("embedding"), F.lit(-1)) != dim
    return chunks.groupBy(by).agg(rows().alias("chunks"), count_where(wrong).alias("wrong_dimension"))
