"""CSV exports of the retail system, read by column name and typed explicitly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from csv import reader

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailscope.functions.ordered import positions
from retailscope.operators.quality import conform
from retailscope.schemas import schema

# Cell texts that mean "missing" in the exports.
MISSING = ("", "NaN", "nan", "NaT", "NA", "N/A", "n/a", "NULL", "null", "None", "<NA>")

# Columns of the published statistics file and the metric each holds.
STATISTICS = {
    "Total Transactions": "total_transactions",
    "Total Customers": "total_customers",
    "Total Revenue": "total_revenue",
    "Total Profit": "total_profit",
    "Average Order Value": "avg_order_value",
    "Average Rating": "avg_rating",
    "Return Rate": "return_rate",
    "Cancellation Rate": "cancellation_rate",
}


#: Quoted cells may hold commas, doubled quotes and line ends; a record with too many or too few cells fails.
OPTIONS = {"escape": '"', "multiLine": "true", "mode": "FAILFAST"}
#: Records of one block of a file, and pieces of records that cross blocks: the end of one that began before, the
#: beginning of one that ends later, or a block that lies within one.
WHOLE, END, BEGIN, WITHIN = range(4)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, by header name, of a file, a folder or a pattern; files are read in many tasks.

    Lines are read in byte ranges ("blocks") as Spark splits them. A line end is within a cell if the number of quotes
    before it is odd, so the quotes of each block are counted first, one number for a block, and summed in the order of
    the blocks; each block is then cut into records on its own, and pieces of records that cross blocks are put together.
    Quotes have a meaning in quoted cells only: an odd number of them in a file fails the load. All files must have the
    same header.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.min_by(F.when(F.col("start") == 0, F.struct("value", quotes.alias("quotes"))), "at")
    blocks = placed.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"), first.alias("first"))
    in_file = Window.partitionBy("file").orderBy("start")  # one row for each block of a file
    before = F.coalesce(F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each block (128 MB by default) that begins within a cell, each file's first and each that ends so
    found = blocks.withColumn("inside", before % 2 == 1).withColumn("open", F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1)
    told = found.where(F.col("inside") | F.col("open") | F.col("first").isNotNull()).drop("quotes").collect()
    if bad := sorted({r.file for r in told if r.open}):
        raise ValueError(f"{bad[0]} ends within a quoted cell")
    inside = {(r.file, r.start) for r in told if r.inside}
    records = _records(lines, inside)
    heads = {r.first.value for r in told if r.first}
    if any(r.first.quotes % 2 for r in told if r.first):  # a name with a line end
        heads = {r.text for r in records.where("head").select("text").distinct().limit(2).collect()}
    names = {tuple(next(reader([h.removeprefix("\ufeff").removesuffix("\r")]), ())) for h in heads}
    if len(names) > 1:
        raise ValueError(f"the files of {path} have different headers")
    fields = _names(next(iter(names), ()))
    if not fields:
        return spark.createDataFrame([], T.StructType())
    schema_ = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    text = F.regexp_replace("text", "\r$", "")
    cells = records.where(~F.col("head")).select(text.alias("text")).where("text != ''")
    return cells.select(F.from_csv("text", F.lit(schema_.toDDL()), OPTIONS).alias("cells")).select("cells.*")


def _names(header: Sequence[str]) -> list[str]:
    """Columns without a name are numbered, and so are names that repeat."""
    lower = [n.lower() for n in header]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(header)]


def _records(lines: DataFrame, inside: set[tuple[str, int]]) -> DataFrame:
    """text and head (it is its file's first record) of all records; `inside` names the blocks that begin within a cell."""
    held = lines.sparkSession.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, out = None, [], []

        def row(kind: int, pieces: list[str]) -> None:
            nonlocal number
            out.append((*block, number, kind, "\n".join(pieces)))
            number += 1

        def over() -> None:
            """What is left of a block belongs to a record that goes on."""
            if block and waiting:
                row(WITHIN if ending else BEGIN, waiting)

        for batch in batches:
            odd = (pc.count_substring(batch.column("value"), '"').to_numpy(zero_copy_only=False) & 1).tolist()
            for value, file, start, flips in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), odd, strict=True):
                if (file, start) != block:
                    over()
                    block, waiting, number = (file, start), [], 0
                    quoted = ending = block in held.value
                quoted ^= bool(flips)
                waiting.append(value)
                if not quoted:
                    row(END if ending else WHOLE, waiting)
                    waiting, ending = [], False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "start", "number", "kind", "text"])
                out.clear()
        over()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "start", "number", "kind", "text"])

    rows = lines.mapInArrow(cut, "file string, start bigint, number bigint, kind bigint, text string")
    head = (F.col("start") == 0) & (F.col("number") == 0)
    records = rows.where(F.col("kind") == WHOLE).select("text", head.alias("head"))
    if not inside:
        return records
    # two pieces of each block at most
    order = Window.partitionBy("file").orderBy("start", "number")
    pieces = rows.where(F.col("kind") != WHOLE).withColumn("head", head).withColumn("record", F.count_if(F.col("kind") == BEGIN).over(order))
    listed = F.array_sort(F.collect_list(F.struct("start", "number", "text")))
    joined = pieces.groupBy("file", "record").agg(F.array_join(F.transform(listed, lambda p: p["text"]), "\n").alias("text"), F.max("head").alias("head"))
    return records.unionByName(joined.select("text", "head"))


def cleaned(value: Column) -> Column:
    return F.when(~value.isin(*MISSING), value)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Missing-value texts and NaN numbers become NULL."""
    fixed = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "string":
            fixed[field.name] = cleaned(F.col(field.name))
        elif kind in ("double", "float"):
            fixed[field.name] = F.when(~F.isnan(field.name), F.col(field.name))
    return df.withColumns(fixed) if fixed else df


def load(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The table's columns out of a CSV that may hold more, typed by the table schema."""
    wanted = list(columns or schema(table).fieldNames())
    cells = read_cells(spark, path)
    absent = [c for c in wanted if c not in cells.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent}")
    return conform(missing_to_null(cells.select(*[f"`{c}`" for c in wanted])), table)


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "customers")


def load_products(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "products")


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    """Order columns only: the export repeats customer and review columns, which have their own tables."""
    return load(spark, path, "orders")


def load_order_items(spark: SparkSession, path: str) -> DataFrame:
    return load(spark, path, "order_items")


def with_item_ids(items: DataFrame, item_order: Sequence[str]) -> DataFrame:
    """Adds `order_item_id` 1, 2, 3 … in the order of order_id and `item_order`; the same on every run."""
    return positions(items, ["order_id", *item_order], "order_item_id")


def split_ratings(order_export: DataFrame, rating: str = "customer_rating") -> DataFrame:
    """Ratings out of the order export: rows that have one, five columns, renamed."""
    return order_export.where(F.col(rating).isNotNull()).select(
        "order_id",
        "customer_id",
        F.col(rating).cast("decimal(3,1)").alias("rating"),
        *[c for c in ("review_sentiment", "customer_review") if c in order_export.columns],
    )


def with_rating_ids(ratings: DataFrame) -> DataFrame:
    """Adds `rating_id` 1, 2, 3 … in the order of order_id; an order has one rating at most."""
    return positions(ratings, ["order_id"], "rating_id")


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    return split_ratings(missing_to_null(read_cells(spark, path)))


def number(text: Column) -> Column:
    """`$1,234.56` and `6.85%` as numbers."""
    return F.regexp_replace(text, "[$,%]", "").cast("double")


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The published totals in one row of numbers."""
    cells = read_cells(spark, path)

    return cells.select(*[number(F.col(f"`{c}`")).alias(name) for c, name in STATISTICS.items()])
