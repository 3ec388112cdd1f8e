"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "retailscope", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and local benches. On a cluster the submitter owns these settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RETAILSCOPE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; a private folder is set only in local mode without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="retailscope-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_STAGED: list[str] = []


def staged(df: DataFrame, label: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete what `staged` wrote in this process, once no result that reads it is needed any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _STAGED:
        path = hadoop.Path(_STAGED.pop())
        dropped += bool(path.getFileSystem(configuration).delete(path, True))
    return dropped


def slice_count(spark: SparkSession) -> int:
    """Range slices for the ordered operators: the session's shuffle width."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
