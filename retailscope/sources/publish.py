"""Writing a set of tables so that readers see all of it or nothing.

Tables go to a new folder first, side by side; rows and broken rules of each are counted in one pass over what is written.
Keys are then compared in one pass over the key columns alone. Only when all is well does an entry of the log name the
folder: its number is one more than the last, and it is created only if nobody else has taken that number, so two
publishers never share a version and the newest is known without clocks. A refused load leaves nothing behind;
`remove_leftovers` deletes what a lost driver left.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailscope.functions.numeric import rows
from retailscope.operators import quality
from retailscope.schemas import PRIMARY_KEY

# child table, key column, parent table; in load order
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
    ("ratings", "order_id", "orders"),
)
# columns that only lay out the files
LAYOUT = ("order_year", "order_month")


class LoadRefused(ValueError):
    """A staged table breaks a key or a rule."""


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Orders are laid out by year and month for date pruning; the rebalance splits a hot month."""
    if table == "orders":
        dated = df.withColumns({"order_year": F.year("order_date"), "order_month": F.month("order_date")})
        spread = dated.hint("rebalance", "order_year", "order_month")
        spread.write.mode("error").partitionBy("order_year", "order_month").parquet(path)
    else:
        df.write.mode("error").parquet(path)


def key_problems(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(problem, rows) for repeated primary keys and missing parents, over all tables at hand.

    All keys of one kind meet in one group: how often they are a primary key, and in how many rows of each child. So one
    shuffle of counted keys answers everything.
    """
    uses = [(name, key, name) for name, key in PRIMARY_KEY.items() if name in tables]
    uses += [(child, key, parent) for child, key, parent in FOREIGN_KEYS if child in tables and parent in tables]
    parts = [tables[name].select(F.lit(parent).alias("parent"), F.lit(name).alias("name"), F.col(key).cast("string").alias("key")) for name, key, parent in uses]
    if not parts:
        raise ValueError("no table with a key")
    every = reduce(DataFrame.unionByName, parts)
    own = F.count_if(F.col("name") == F.col("parent"))
    children = dict.fromkeys(u[0] for u in uses)
    by_key = every.groupBy("parent", "key").agg(own.alias("own"), *[F.count_if(F.col("name") == c).alias(f"_{c}") for c in children])
    known = F.col("key").isNotNull()
    tests = {f"{n}.{k} repeats": (F.col("parent") == n) & known & (F.col("own") > 1) for n, k in PRIMARY_KEY.items() if n in tables}
    sums = [F.coalesce(F.sum(F.when(test, 1)), F.lit(0)).cast("bigint") for test in tests.values()]
    names = list(tests)
    for name, key in PRIMARY_KEY.items():
        if name in tables:
            names.append(f"{name}.{key} is missing")
            sums.append(F.coalesce(F.sum(F.when((F.col("parent") == name) & ~known, F.col("own"))), F.lit(0)).cast("bigint"))
    for child, key, parent in FOREIGN_KEYS:
        if child in tables and parent in tables:
            names.append(f"{child}.{key} has no {parent}")
            # a missing key has no parent either
            lost = (F.col("parent") == parent) & ((F.col("own") == 0) | ~known)
            sums.append(F.coalesce(F.sum(F.when(lost, F.col(f"_{child}"))), F.lit(0)).cast("bigint"))
    one = by_key.agg(*[s.alias(f"p{i}") for i, s in enumerate(sums)])
    cells = F.array(*[F.struct(F.lit(name).alias("problem"), F.col(f"p{i}").alias("n")) for i, name in enumerate(names)])
    return one.select(F.explode(cells).alias("cell")).select("cell.*").where("n > 0")


def _load(df: DataFrame, path: str, table: str, rules: quality.Rules) -> dict[str, int]:
    """Write one table, and count on what is written the rows and those that break each rule, in one pass."""
    write_table(df, path, table)
    broken = [F.count_if(~F.coalesce(rule, F.lit(True))).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    return df.sparkSession.read.schema(df.schema).parquet(path).agg(rows().alias("rows"), *broken).first().asDict()


def publish(tables: Mapping[str, DataFrame], target: str, rules: Mapping[str, quality.Rules] | None = None) -> DataFrame:
    """Write, check and publish the tables; returns (table, rows, path).

    Keys must be present and unique and their parents there, and every row must keep the rules of its
    table: `rules` by table name, by default those of the star schema for the columns at hand.
    """
    if rules is None:
        rules = {name: quality.table_rules(name, df.columns) for name, df in tables.items() if name in PRIMARY_KEY or name == "order_items"}
    spark = next(iter(tables.values())).sparkSession
    folder = f"{target.rstrip('/')}/versions/{uuid.uuid4().hex}"
    paths = {name: f"{folder}/{name}" for name in tables}
    try:
        counts, problems = _written(spark, tables, paths, rules)
        if problems:
            raise LoadRefused("; ".join(f"{problem} ({n})" for problem, n in problems))
    except BaseException:
        _delete(spark, folder)
        raise
    entry = {"tables": {name: {"path": path, "rows": counts[name]} for name, path in paths.items()}}
    _commit(spark, target, entry)
    return spark.createDataFrame([(name, counts[name], path) for name, path in paths.items()], "table string, rows bigint, path string")


def _written(spark: SparkSession, tables: Mapping[str, DataFrame], paths: Mapping[str, str], rules: Mapping[str, quality.Rules]) -> tuple[dict[str, int], list[tuple[str, int]]]:
    """Rows of each table, and what is wrong with them."""
    with ThreadPoolExecutor(len(tables)) as pool:
        jobs = {name: pool.submit(inheritable_thread_target(spark)(_load), df, paths[name], name, rules.get(name) or {}) for name, df in tables.items()}
        seen = {name: job.result() for name, job in jobs.items()}
    counts = {name: found["rows"] for name, found in seen.items()}
    problems = [(f"{name}: {rule}", found[f"r{i}"]) for name, found in seen.items() for i, rule in enumerate(rules.get(name) or {}) if found[f"r{i}"]]
    written = {name: spark.read.schema(tables[name].schema).parquet(path) for name, path in paths.items() if name in PRIMARY_KEY or name == "order_items"}
    if set(written) & set(PRIMARY_KEY):
        problems = [tuple(p) for p in key_problems(written).collect()] + problems  # a few rows per key
    return counts, problems


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file, unless it exists. Stores promise this for `create` without overwriting; local disks by an exclusive open."""
    files, place = _files(spark, path)
    files.mkdirs(place.getParent())
    if files.getScheme() == "file":
        try:
            with open(place.toUri().getPath(), "x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(place, False)
    except Py4JJavaError as error:
        if files.exists(place):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def entries(spark: SparkSession, target: str) -> dict[int, dict]:
    """Entries by version; an entry that its publisher hasn't finished is left out."""
    files, place = _files(spark, f"{target.rstrip('/')}/log")
    if not files.exists(place):
        return {}
    out = {}
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if not name.endswith(".json") or name.startswith("."):
            continue
        stream = files.open(status.getPath())
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            out[int(name.removesuffix(".json"))] = json.loads(text)
        except json.JSONDecodeError:
            out[int(name.removesuffix(".json"))] = {}
    return out


def put_entry(spark: SparkSession, target: str, version: int, entry: dict) -> bool:
    """Write the log's entry of that number, unless there is one."""
    return _put_if_absent(spark, f"{target.rstrip('/')}/log/{version:020d}.json", json.dumps(entry))


def _commit(spark: SparkSession, target: str, entry: dict) -> int:
    """The entry under the next free number; whoever comes second takes the one after."""
    version = max(entries(spark, target), default=0) + 1
    while not put_entry(spark, target, version, entry):
        version += 1
    return version


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the published versions."""
    return sorted(v for v, entry in entries(spark, target).items() if entry)


def published(spark: SparkSession, target: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest published version, or of the one asked for."""
    log = {v: entry for v, entry in entries(spark, target).items() if entry}
    if not log:
        raise LookupError(f"nothing is published in {target}")
    entry = log[max(log) if version is None else version]
    return {name: spark.read.parquet(t["path"]).drop(*LAYOUT) for name, t in entry["tables"].items()}


def remove_leftovers(spark: SparkSession, target: str, older_than: float = 86_400) -> int:
    """Delete folders that no version names, untouched for so many seconds; returns how many."""
    named = {t["path"].rsplit("/", 2)[1] for entry in entries(spark, target).values() for t in entry.get("tables", {}).values()}
    files, place = _files(spark, f"{target.rstrip('/')}/versions")
    old = [s.getPath() for s in (files.listStatus(place) if files.exists(place) else []) if s.getPath().getName() not in named and s.getModificationTime() / 1000 <= time.time() - older_than]
    return sum(bool(files.delete(path, True)) for path in old)


def replace_chunks(chunks: DataFrame, target: str) -> DataFrame:
    """Replace the whole chunk store; the old one stays readable until the new one is published."""
    return publish({"chunks": chunks}, target)


def write_metadata(parts: Mapping[str, DataFrame], folder: str) -> None:
    """Model metrics and reference statistics as JSON tables."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
