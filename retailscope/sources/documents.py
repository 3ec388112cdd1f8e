"""Markdown documents as (source_file, text) rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Every *.md file of a folder, one row per file. An empty folder is an error."""
    path = f"{folder.rstrip('/')}/*.md"
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no .md files in {folder}") from error
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return files.select(name.alias("source_file"), F.col("value").alias("text"))
