"""A small sample of the star schema whose keys all resolve."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.session import staged


def shuffled(key: str, seed: int) -> Column:
    """A fixed pseudo-random order of the rows."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def sample_star(tables: Mapping[str, DataFrame], orders: int = 300, extra: int = 20, seed: int = 42) -> dict[str, DataFrame]:
    """`orders` random orders with their items, ratings, customers and products, and a few unreferenced
    customers and products."""
    picked = tables["orders"].select("order_id").orderBy(shuffled("order_id", seed), "order_id").limit(orders)
    chosen = tables["orders"].join(staged(picked, "sample-keys"), "order_id", "left_semi")
    items = tables["order_items"].join(chosen.select("order_id"), "order_id", "left_semi")

    def referenced(name: str, key: str, users: DataFrame) -> DataFrame:
        used = users.select(key)
        inside = tables[name].join(used, key, "left_semi")
        outside = tables[name].join(used, key, "left_anti").orderBy(key).limit(extra)
        return inside.unionByName(outside)

    return {
        "orders": chosen,
        "order_items": items,
        "ratings": tables["ratings"].join(chosen.select("order_id"), "order_id", "left_semi"),
        "customers": referenced("customers", "customer_id", chosen),
        "products": referenced("products", "product_id", items),
    }
