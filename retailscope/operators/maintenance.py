"""Batch insert, patch and delete: whole-table joins that return the new table and the refused rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import rows
from retailscope.operators.quality import Rules


class Change(NamedTuple):
    table: DataFrame
    refused: DataFrame  # the requests with a `reason`


# Column defaults of new rows.
DEFAULTS: dict[str, dict[str, object]] = {
    "customers": {"customer_acquisition_cost": "0.00"},
    "orders": {
        "currency": "USD",
        "loyalty_points_earned": 0,
        "loyalty_points_redeemed": 0,
        "discount_amount": "0.00",
        "tax_amount": "0.00",
        "shipping_cost": "0.00",
        "is_repeat_customer": False,
        "customer_order_count": 1,
    },
}


def with_defaults(batch: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    types = {f.name: f.dataType for f in batch.schema.fields}
    return batch.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items() if c in types}
    )


def insert_batch(
    table: DataFrame,
    batch: DataFrame,
    key: str,
    parents: Mapping[str, DataFrame] | None = None,
    defaults: Mapping[str, object] | None = None,
    rules: Rules | None = None,
) -> Change:
    """Append new rows. A key that is missing, exists, or repeats in the batch is refused; so is a missing
    parent, and a row (with its defaults) that breaks one of `rules`."""
    parents = parents or {}
    repeats = batch.where(F.col(key).isNotNull()).groupBy(key).agg(rows().alias("_times"))
    marked = with_defaults(batch, defaults or {}).join(repeats, key, "left").join(table.select(key, F.lit(True).alias("_exists")), key, "left")
    reason = F.when(F.col(key).isNull(), "key is missing").when(F.col("_exists") | (F.col("_times") > 1), "duplicate key")
    for column, parent in parents.items():
        flag = f"_has_{column}"
        known = parent.select(column).distinct().withColumn(flag, F.lit(True))
        marked = marked.join(known, column, "left")
        reason = reason.when(F.col(flag).isNull(), f"no such {column}")
    for name, rule in (rules or {}).items():
        reason = reason.when(~F.coalesce(rule, F.lit(True)), name)
    marked = marked.withColumn("reason", reason)
    good = marked.where("reason is null").select(*batch.columns)
    if "created_at" in table.columns:  # new rows are stamped unless they say when they were made
        told = F.col("created_at") if "created_at" in batch.columns else F.lit(None)
        good = good.withColumn("created_at", F.coalesce(told, F.current_timestamp()).cast(table.schema["created_at"].dataType))
    bad = marked.where("reason is not null").select(*batch.columns, "reason")
    return Change(table.unionByName(good, allowMissingColumns=True), bad)


def patch_batch(table: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], rules: Rules | None = None) -> Change:
    """Partial updates. `patches` has the key, new values, and `set_fields`, the names that were supplied:
    a supplied NULL overwrites, an unsupplied field stays. The key itself cannot change.

    Refused are patches whose key is missing, unknown or repeated in the batch, and those whose supplied
    values break one of `rules` (conditions on the fields)."""
    if key in fields:
        raise ValueError(f"{key} is immutable")
    repeats = patches.where(F.col(key).isNotNull()).groupBy(key).agg(rows().alias("_times"))
    marked = patches.join(repeats, key, "left").join(table.select(key, F.lit(True).alias("_exists")), key, "left")
    reason = F.when(F.col(key).isNull(), "key is missing").when(F.col("_exists").isNull(), "not found").when(F.col("_times") > 1, "key repeats")
    for name, rule in (rules or {}).items():
        reason = reason.when(F.array_contains("set_fields", name.split()[0]) & ~F.coalesce(rule, F.lit(True)), name)
    marked = marked.withColumn("reason", reason)
    renamed = marked.where("reason is null").select(key, "set_fields", *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = table.join(renamed, key, "left")
    given = F.coalesce(F.col("set_fields"), F.array().cast("array<string>"))
    values = {f: F.when(F.array_contains(given, f), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    updated = joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in table.columns])
    return Change(updated, marked.where("reason is not null").select(*patches.columns, "reason"))


def delete_restrict(table: DataFrame, requests: DataFrame, key: str, children: Mapping[str, DataFrame]) -> Change:
    """Delete by key unless a child row refers to it."""
    asked = requests.select(key).distinct()
    marked = asked.join(table.select(key, F.lit(True).alias("_exists")), key, "left")
    reason = F.when(F.col("_exists").isNull(), "not found")
    for name, child in children.items():
        flag = f"_in_{name}"
        marked = marked.join(child.select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
        reason = reason.when(F.col(flag), f"referenced by {name}")
    marked = marked.withColumn("reason", reason)
    kept = table.join(marked.where("reason is null").select(key), key, "left_anti")
    return Change(kept, marked.where("reason is not null").select(key, "reason"))


def delete_cascade(table: DataFrame, requests: DataFrame, key: str, children: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Delete by key with everything that refers to it; returns every table, the parent as 'table'."""
    asked = requests.select(key).distinct()
    left = {name: child.join(asked, key, "left_anti") for name, child in children.items()}
    return {"table": table.join(asked, key, "left_anti"), **left}
