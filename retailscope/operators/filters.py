"""Optional conjunctive filters and stable pages."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.schemas import check_vocabulary

Date = dt.date | str | None

MAX_PAGE_SIZE = 100
#: Rows up to the end of a page that is read as a bounded top-n; slices that are counted at once, and keys sampled for them.
DEEP, SLICES, SAMPLED = 10_000, 64, 4_096


def in_range(date_from: Date = None, date_to: Date = None, column: str = "order_date") -> Column | None:
    """Inclusive date range, or None when neither end is given."""
    ends = []
    if date_from is not None:
        ends.append(F.col(column) >= F.lit(date_from).cast("date"))
    if date_to is not None:
        ends.append(F.col(column) <= F.lit(date_to).cast("date"))
    return functools.reduce(operator.and_, ends) if ends else None


def apply_filters(df: DataFrame, date_from: Date = None, date_to: Date = None, **equals) -> DataFrame:
    """Keep rows that meet every given condition; a condition whose value is None is skipped."""
    conditions = [F.col(name) == F.lit(value) for name, value in equals.items() if value is not None]
    dates = in_range(date_from, date_to)
    if dates is not None:
        conditions.append(dates)
    return df.where(functools.reduce(operator.and_, conditions)) if conditions else df


def checked(**values: str | None) -> dict[str, str | None]:
    """Filter values, each validated against the vocabulary of its column."""
    return {column: check_vocabulary(column, value) for column, value in values.items()}


def top(df: DataFrame, by: str, key: str | Sequence[str], n: int) -> DataFrame:
    """First `n` rows by `by` descending; equal values are ordered by the key, so the cut is stable.

    Compute columns before this and at most drop some after it: a computing projection on top of a
    limit moves below it, and the bounded top-n then becomes a sort of everything.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.desc_nulls_last(by), *keys).limit(n)


def sort_order(sort_by: str, sort_dir: str, key: str) -> list[Column]:
    """Ascending puts NULL last, descending puts it first; the key breaks ties."""
    lead = F.asc_nulls_last(sort_by) if sort_dir == "asc" else F.desc_nulls_first(sort_by)
    return [lead, F.asc(key)]


def after(sort_by: str, sort_dir: str, key: str, bound: tuple) -> Column:
    """Whether a row comes after the bound (value, key) in `sort_order`."""
    value, last = bound
    v, k = F.col(sort_by), F.col(key) > F.lit(last)
    if sort_dir == "asc":  # NULL last
        return v.isNull() & k if value is None else v.isNull() | (v > F.lit(value)) | (v == F.lit(value)) & k
    return v.isNotNull() | k if value is None else v.isNotNull() & ((v < F.lit(value)) | (v == F.lit(value)) & k)


def narrowed(df: DataFrame, key: str, sort_by: str, sort_dir: str, skip: int, size: int, total: int) -> tuple[DataFrame, int]:
    """A slice of the order that holds the rows from `skip` on, and how many of its rows come before them.

    A sample of at most `2 * SAMPLED` keys gives the slices' bounds; each round counts `SLICES` slices.
    """
    while skip + size > DEEP and total > DEEP:
        rate = min(1.0, SAMPLED / total)
        some = df.where(F.pmod(F.xxhash64(F.lit(total), key), F.lit(1 << 30)) < int(rate * (1 << 30))).select(sort_by, key).limit(2 * SAMPLED)
        sampled = [tuple(r) for r in some.orderBy(*sort_order(sort_by, sort_dir, key)).collect()]
        bounds = sampled[:: max(1, len(sampled) // SLICES)]
        place = sum((after(sort_by, sort_dir, key, b).cast("int") for b in bounds), F.lit(0))
        counts = {r.place: r.n for r in df.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        before = 0
        first = last = None
        for at in range(len(bounds) + 1):
            n = counts.get(at, 0)
            if first is None and before + n > skip:
                first, start = at, before
            if before < skip + size:
                last = at
            before += n
        if first is None or (first == 0 and last == len(bounds)):
            break  # past the end, or one slice holds all
        if first:
            df = df.where(after(sort_by, sort_dir, key, bounds[first - 1]))
        if last < len(bounds):
            df = df.where(~after(sort_by, sort_dir, key, bounds[last]))
        skip, total = skip - start, sum(counts.get(at, 0) for at in range(first, last + 1))
    return df, skip


def page(
    df: DataFrame,
    key: str,
    sort_by: str,
    sort_dir: str = "desc",
    page_number: int = 1,
    page_size: int = 20,
    sortable: Sequence[str] | None = None,
    **filters,
) -> DataFrame:
    """One page of the filtered rows, each with the `total` rows and `pages` of the filtered set.

    A page that ends within the first `DEEP` rows is a bounded top-n. For a page further in, rows are counted in slices of
    the order until the slice that holds the page is known to be short; only that one is sorted. `key` must be unique.
    """
    if page_number < 1 or not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and page_size within 1..{MAX_PAGE_SIZE}")
    if sort_dir not in ("asc", "desc"):
        raise ValueError("sort_dir must be 'asc' or 'desc'")
    if sortable is not None and sort_by not in sortable:
        raise ValueError(f"cannot sort by {sort_by!r}; expected one of {list(sortable)}")
    matching = apply_filters(df, **filters)
    total = matching.agg(F.count(F.lit(1))).scalar()
    skip = (page_number - 1) * page_size
    if skip + page_size > DEEP:
        n = matching.count()
        matching, skip = narrowed(matching, key, sort_by, sort_dir, skip, page_size, n)
        total = F.lit(n)
    rows = matching.orderBy(*sort_order(sort_by, sort_dir, key)).offset(skip).limit(page_size)
    return rows.withColumn("total", total).withColumn(
        "pages", F.expr("total div {0} + if(total % {0} > 0, 1, 0)".format(page_size))
    )

