"""Products bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import percent, rows
from retailscope.operators.filters import top
from retailscope.session import slice_count, staged

#: Products of a basket that meet in one group.
BLOCK = 200
#: Lines or pairs that a task holds at once, so that more of them mean more tasks and not larger ones.
ROWS = 1_000_000
#: Pairs of two products that are both in as many orders are counted where they are made.
HOT = 1_000_000


def cross_sell_pairs(items: DataFrame, orders: DataFrame, min_support: int = 2, limit: int = 20, block: int = BLOCK) -> DataFrame:
    """The product pairs found together in most orders, with at least `min_support` orders.

    Exact. A pair cannot be in more orders than its rarer product, so products below the support go
    first. Baskets are cut into blocks and every two blocks of a basket meet in their own group, so that
    a large basket is spread over many tasks. The tasks grow in number with lines and pairs, not in size; pairs of two
    products that are in very many orders are counted where they are made before they are shuffled.
    """
    known = items.select("order_id", "product_id").where("order_id is not null and product_id is not null")
    tasks = _tasks(known.agg(rows()))
    lines = staged(known.repartition(tasks, "order_id", "product_id").distinct(), "basket-lines")
    counts = staged(lines.groupBy("product_id").agg(rows().alias("n")).where(F.col("n") >= min_support), "product-counts")
    # one product for each `HOT` lines at most, hence the broadcast; the others have that many lines at most
    common = lines.join(F.broadcast(counts.where(F.col("n") >= HOT).select("product_id", F.lit(True).alias("hot"))), "product_id", "left")
    rare = common.where("hot is null").drop("hot").repartition(tasks, "product_id").join(counts.where(F.col("n") < HOT).select("product_id"), "product_id")
    kept = rare.withColumn("hot", F.lit(False)).unionByName(common.where("hot")).repartition(tasks, "order_id")
    sizes = kept.groupBy("order_id").agg(rows().alias("size")).where("size > 1")
    counted = _pair_counts(staged(kept.join(sizes, "order_id"), "baskets"), block)
    total = orders.agg(rows()).scalar()
    enough = counted.where(F.col("orders_together") >= min_support).withColumn("_total", total)
    shown = enough.select(
        "product_a",
        "product_b",
        "orders_together",
        percent(F.col("orders_together"), F.col("_total"), 4).alias("support_pct"),
    )
    return top(shown, "orders_together", ["product_a", "product_b"], limit)


def _tasks(count: DataFrame) -> int:
    """Tasks for as many rows as `count` tells."""
    return max(slice_count(count.sparkSession), int(count.first()[0] or 0) // ROWS + 1)


def _pair_counts(baskets: DataFrame, block: int) -> DataFrame:
    """Orders of every pair; `size` tells into how many blocks a basket is cut, `hot` whether a product is in very many orders."""
    tasks = _tasks(baskets.agg(F.sum((F.col("size") - 1) / 2)))
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = baskets.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("product_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.select("order_id", F.col("product_id").alias("product_a"), F.col("hot").alias("ha"), F.col("own").alias("ba"), other.alias("bb"))
    right = own.select("order_id", F.col("product_id").alias("product_b"), F.col("hot").alias("hb"), F.col("own").alias("bb"), other.alias("ba"))
    group = ["order_id", "ba", "bb"]
    pairs = left.repartition(tasks, *group).join(right.repartition(tasks, *group), group).where(F.col("product_a") < F.col("product_b"))
    common = left.where("ha").join(right.where("hb"), group).where(F.col("product_a") < F.col("product_b"))
    apart = pairs.where(~(F.col("ha") & F.col("hb"))).select("product_a", "product_b").repartition(tasks, "product_a", "product_b")
    count = rows().alias("orders_together")
    return apart.groupBy("product_a", "product_b").agg(count).unionByName(common.groupBy("product_a", "product_b").agg(count))
