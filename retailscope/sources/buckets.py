"""A table laid out in buckets of its key, so that a small batch of changes costs what it touches.

A row's bucket is a hash of its key. A version of the table is an entry of a numbered log that names the folder of each
bucket. A batch reads the buckets of its keys only, is applied to them, and writes them anew; the new version keeps the
folders of all other buckets as they are. An entry is created only if nobody else has taken its number, so of two batches
at once the second one is applied again, to what the first one left. Readers see one version or the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailscope.operators.maintenance import Change, Rules, delete_restrict, insert_batch, patch_batch
from retailscope.sources.publish import entries, put_entry

BUCKET = "_bucket"
#: How often a batch is applied again because another one came first.
TRIES = 20


class Conflict(RuntimeError):
    """Other batches have always been faster."""


class State(NamedTuple):
    version: int
    key: str
    buckets: int
    schema: str
    paths: Mapping[str, str]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def create(df: DataFrame, target: str, key: str, buckets: int = 64) -> int:
    """Lay `df` out as the first version; rows of a bucket are sorted by the key."""
    if entries(df.sparkSession, target):
        raise ValueError(f"{target} holds a table already")
    state = State(0, key, buckets, df.schema.json(), {})
    paths = _write(df, target, state)
    if not _commit(df.sparkSession, target, state._replace(paths=paths)):
        raise Conflict(target)
    return 1


def _write(df: DataFrame, target: str, state: State) -> dict[str, str]:
    """The folder of each bucket that has rows."""
    folder = f"{target.rstrip('/')}/data/{uuid.uuid4().hex}"
    placed = df.withColumn(BUCKET, bucket_of(F.col(state.key), state.buckets))
    placed.repartition(BUCKET).sortWithinPartitions(BUCKET, state.key).write.partitionBy(BUCKET).parquet(folder)
    place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).listStatus(place)]
    return {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def _commit(spark: SparkSession, target: str, state: State) -> bool:
    """Whether `state` has become the version after its own."""
    return put_entry(spark, target, state.version + 1, {"key": state.key, "buckets": state.buckets, "schema": state.schema, "paths": dict(state.paths)})


def state_of(spark: SparkSession, target: str, version: int | None = None) -> State:
    log = {v: e for v, e in entries(spark, target).items() if e}
    if not log:
        raise LookupError(f"no table in {target}")
    at = max(log) if version is None else version
    return State(at, log[at]["key"], log[at]["buckets"], log[at]["schema"], log[at]["paths"])


def read(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The newest version of the table, or the one asked for."""
    state = state_of(spark, target, version)
    return _part(spark, state, state.paths)


def _part(spark: SparkSession, state: State, wanted) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(state.schema))
    paths = [state.paths[b] for b in sorted(wanted) if b in state.paths]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(spark: SparkSession, target: str, batch: DataFrame, apply: Callable[[DataFrame], Change]) -> DataFrame:
    """Apply a batch to the buckets of its keys and make the result the next version; returns the refused rows.

    `apply` gets the rows of these buckets as if they were the table.
    """
    for _ in range(TRIES):
        state = state_of(spark, target)
        touched = {str(r[0]) for r in batch.select(bucket_of(F.col(state.key), state.buckets)).distinct().collect()}  # one row for each bucket
        if not touched:
            return apply(_part(spark, state, ())).refused
        done = apply(_part(spark, state, touched))
        paths = {b: p for b, p in state.paths.items() if b not in touched} | _write(done.table.select(*read(spark, target, state.version).columns), target, state)
        if _commit(spark, target, state._replace(paths=paths)):
            return done.refused
    raise Conflict(target)


def insert(spark: SparkSession, target: str, batch: DataFrame, parents: Mapping[str, DataFrame] | None = None, defaults: Mapping[str, object] | None = None, rules: Rules | None = None) -> DataFrame:
    """`maintenance.insert_batch` on the batch's buckets."""
    key = state_of(spark, target).key
    return change(spark, target, batch, lambda table: insert_batch(table, batch, key, parents, defaults, rules))


def patch(spark: SparkSession, target: str, patches: DataFrame, fields, rules: Rules | None = None) -> DataFrame:
    """`maintenance.patch_batch` on the patches' buckets."""
    key = state_of(spark, target).key
    return change(spark, target, patches, lambda table: patch_batch(table, patches, key, fields, rules))


def delete(spark: SparkSession, target: str, requests: DataFrame, children: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """`maintenance.delete_restrict` on the requests' buckets; a child's rows that refer to them are kept from it."""
    key = state_of(spark, target).key
    return change(spark, target, requests, lambda table: delete_restrict(table, requests, key, children or {}))


def delete_with(spark: SparkSession, target: str, requests: DataFrame, children: Mapping[str, str]) -> DataFrame:
    """Delete keys, and before that the rows that refer to them in the bucket tables `children` (laid out by the same key).

    Returns the keys that were not found.
    """
    key = state_of(spark, target).key
    asked = requests.select(key).distinct()
    for child in children.values():
        change(spark, child, asked, lambda table: Change(table.join(asked, key, "left_anti"), asked.limit(0).withColumn("reason", F.lit(""))))
    return delete(spark, target, asked)
