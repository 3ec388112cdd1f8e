"""Ordered totals, positions and quantiles that never put an unbounded group into one task.

`Window.orderBy` without (or with a hot) partition key sorts everything in one task. Here rows are
range-partitioned on (group, order) so that even one group spreads over many slices; each slice adds
up its own rows, and what earlier slices hold of the same group is carried in. A slice can only
continue the group of the slice before it, so the carries are at most one row per slice. There is no
other way for small tables: what is tested is what runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailscope.session import slice_count, staged

SLICE = "_slice"


def running_totals(
    df: DataFrame,
    totals: Mapping[str, Column],
    order_by: Sequence[str],
    group_by: Sequence[str] = (),
    include_current: bool = True,
) -> DataFrame:
    """`df` plus one running sum per entry of `totals`, in the order of `order_by` within `group_by`.

    `order_by` must be unique within a group. With `include_current=False` a row's own value is left out
    (0 for the first row).
    """
    addends = {name: f"_add_{i}" for i, name in enumerate(totals)}
    base = df.select("*", *[expr.alias(addends[name]) for name, expr in totals.items()])
    kept = df.columns
    spark = df.sparkSession
    sliced = staged(
        base.repartitionByRange(slice_count(spark), *group_by, *order_by).withColumn(SLICE, F.spark_partition_id()),
        "ordered",
    )
    carry = _carries(sliced, list(addends.values()), list(group_by))
    frame = _frame(Window.partitionBy(SLICE, *group_by).orderBy(*order_by), include_current)
    within = sliced.select(
        *kept, SLICE, _key(group_by).alias("head"), *[_zero(F.sum(a).over(frame), base, a).alias(a) for a in addends.values()]
    )
    # one row per slice at most, hence the broadcast
    joined = within.join(F.broadcast(carry), on=[SLICE, "head"], how="left")
    sums = [
        (F.col(a) + _zero(F.col(f"carry{a}"), base, a)).cast(_sum_type(base, a)).alias(name)
        for name, a in addends.items()
    ]
    return joined.select(*kept, *sums)


def _frame(window, include_current: bool):
    return window.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)


def _sum_type(df: DataFrame, column: str) -> str:
    return df.select(F.sum(column).alias("s")).schema["s"].dataType.simpleString()


def _zero(value: Column, df: DataFrame, column: str) -> Column:
    return F.coalesce(value, F.lit(0).cast(_sum_type(df, column)))


def _key(group_by: Sequence[str]) -> Column:
    return F.struct(*group_by) if group_by else F.lit(1)


def _carries(sliced: DataFrame, addends: list[str], group_by: list[str]) -> DataFrame:
    """(slice, group, what earlier slices hold of the group) for the first group of each slice."""
    per_slice = sliced.groupBy(SLICE, *group_by).agg(*[F.sum(a).alias(a) for a in addends])
    key = _key(group_by)
    edges = per_slice.groupBy(SLICE).agg(
        F.min(key).alias("head"),
        F.max(key).alias("tail"),
        *[F.max_by(a, key).alias(a) for a in addends],
    )
    # windows over one row per slice: what the slices up to here hold of the group that each ends in
    so_far = Window.partitionBy("tail").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    upto = edges.select(SLICE, "head", "tail", *[F.sum(a).over(so_far).alias(a) for a in addends])
    before = Window.orderBy(SLICE)
    continues = F.lag("tail").over(before) == F.col("head")
    carried = upto.select(SLICE, "head", continues.alias("_on"), *[F.lag(a).over(before).alias(f"carry{a}") for a in addends])
    return carried.where("_on").drop("_on")


def positions(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """`df` plus the 1-based global position in the order of `order_by` (which must be unique)."""
    return running_totals(df, {name: F.lit(1).cast("bigint")}, order_by)


#: Values per column that the sketch behind the brackets tells apart.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of each column, in the order of `probabilities` (None without values).

    Every round is one aggregate for all columns and probabilities, and returns bounds and counts only. The first one
    sketches the columns, which brackets every wanted rank by two values; the sketch's error bound proves that. A bracket
    of one value is the answer. Others are counted, which tells whether an end is the answer; if not, the values between
    the ends are sketched again, until few enough are left that the sketch is exact: three rounds for some ten million rows, two more for every thousand times as many.
    NULL and NaN are skipped.
    """
    value = {c: f"_v{i}" for i, c in enumerate(columns)}
    numbers = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(v) for c, v in value.items()])
    few, slack = ACCURACY // 4, 8 / ACCURACY
    near = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probabilities for d in (-slack, slack)])
    sketch = [F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, near, ACCURACY).alias("near")).alias(v) for v in value.values()]
    first = numbers.agg(*sketch).first()
    wanted: dict[tuple[str, int], tuple[float, float]] = {}  # (column, rank) -> bracket
    for v in value.values():
        n = first[v]["n"]
        for k, p in enumerate(probabilities):
            if n:
                whole = n <= few
                bracket = (first[v]["low"], first[v]["high"]) if whole else (first[v]["near"][2 * k], first[v]["near"][2 * k + 1])
                for rank in {int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1)}:
                    low, high = wanted.get((v, rank), (float("-inf"), float("inf")))
                    wanted[v, rank] = max(low, bracket[0]), min(high, bracket[1])
    found: dict[tuple[str, int], float] = {}
    while wanted:
        found |= {at: low for at, (low, high) in wanted.items() if low == high}
        wanted = {at: bracket for at, bracket in wanted.items() if at not in found}
        # values below the bracket, equal to its ends, and between them; few values in all needn't be counted
        brackets = [b for b in dict.fromkeys((v, *bracket) for (v, _), bracket in wanted.items()) if first[b[0]]["n"] > few]
        counts = {}
        if brackets:
            sums = [F.struct(*[F.count_if(test) for test in (F.col(v) < low, F.col(v) == low, (F.col(v) > low) & (F.col(v) < high))]).alias(f"b{i}") for i, (v, low, high) in enumerate(brackets)]
            counts = dict(zip(brackets, numbers.agg(*sums).first(), strict=True))
        asked = {}
        for (v, rank), (low, high) in wanted.items():
            if first[v]["n"] <= few:
                asked[v, rank] = F.col(v), [(rank + 0.5) / first[v]["n"]]
                continue
            below, lowest, inner = counts[v, low, high]
            at = rank - below - lowest
            if at < 0 or at >= inner:
                found[v, rank] = low if at < 0 else high
                continue
            place = (at + 0.5) / inner
            cell = F.when((F.col(v) > low) & (F.col(v) < high), F.col(v))
            asked[v, rank] = cell, [place] if inner <= few else [max(0.0, place - slack), min(1.0, place + slack)]
        wanted = {}
        if asked:
            row = numbers.agg(*[F.percentile_approx(cell, F.array(*map(F.lit, q)), ACCURACY).alias(f"q{i}") for i, (cell, q) in enumerate(asked.values())]).first()
            wanted = {at: (q[0], q[-1]) for at, q in zip(asked, row, strict=True)}

    def quantile(v: str, p: float) -> float | None:
        n = first[v]["n"]
        if not n:
            return None
        place = p * (n - 1)
        low = int(place)
        lower, upper = found[v, low], found[v, min(n - 1, low + 1)]
        return lower + (upper - lower) * (place - low)

    return {c: [quantile(v, p) for p in probabilities] for c, v in value.items()}


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (by…, feature, probability, quantile).

    Without groups this is `exact_quantiles`. With them one pass sketches all columns and so brackets each quantile; the sketch's error bound proves that
    the bracket holds both neighbouring values. A second pass counts what lies below each bracket and
    the different values inside, a few in ten thousand of all, which are then positioned exactly.
    NULL and NaN are skipped.
    """
    wanted = [float(p) for p in probabilities]
    if not by:
        told = exact_quantiles(df, columns, wanted)
        listed = [(c, p, q) for c in columns for p, q in zip(wanted, told[c], strict=True) if q is not None]
        return df.sparkSession.createDataFrame(listed, "feature string, probability double, quantile double")
    slack = 4 / ACCURACY
    value = {c: f"_v{i}" for i, c in enumerate(columns)}
    numbers = df.select(*by, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(v) for c, v in value.items()])
    ends = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in wanted for d in (-slack, slack)])

    def bracket(v: str) -> Column:
        """Rows, and per quantile its bracket; up to `ACCURACY` rows that is the whole range."""
        sketch = F.percentile_approx(v, ends, ACCURACY)
        few = F.count(v) <= ACCURACY
        edge = lambda k: F.struct(
            F.when(few, F.min(v)).otherwise(F.get(sketch, F.lit(2 * k))).alias("low"),
            F.when(few, F.max(v)).otherwise(F.get(sketch, F.lit(2 * k + 1))).alias("high"),
        )
        return F.struct(F.count(v).alias("rows"), F.array(*[edge(k) for k in range(len(wanted))]).alias("edges"))

    edges = staged(numbers.groupBy(*by).agg(*[bracket(v).alias(f"_b{v}") for v in value.values()]), "brackets")
    met = numbers.join(edges, list(by))
    below = met.groupBy(*by).agg(
        *[
            F.array(*[F.count_if(F.col(v) < F.get(F.col(f"_b{v}.edges"), F.lit(k))["low"]) for k in range(len(wanted))]).alias(f"_n{v}")
            for v in value.values()
        ]
    )
    cell = lambda c, v, k: F.when(
        F.col(v).between(F.get(F.col(f"_b{v}.edges"), F.lit(k))["low"], F.get(F.col(f"_b{v}.edges"), F.lit(k))["high"]),
        F.struct(F.lit(c).alias("feature"), F.lit(k).alias("_q"), F.col(v).alias("value")),
    )
    cells = F.filter(F.array(*[cell(c, v, k) for c, v in value.items() for k in range(len(wanted))]), lambda x: x.isNotNull())
    inside = met.select(*by, F.explode(cells).alias("_x")).groupBy(*by, "_x.feature", "_x._q", "_x.value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(inside, {"upto": F.col("n")}, ["value"], [*by, "feature", "_q"])
    # one row per group, column and probability
    listed = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(k).alias("_q"), F.lit(p).alias("probability"), (F.lit(p) * (F.col(f"_b{v}.rows") - 1)).alias("place"), F.get(f"_n{v}", F.lit(k)).alias("below"))
            for c, v in value.items()
            for k, p in enumerate(wanted)
        ]
    )
    sizes = below.join(edges, list(by))
    targets = sizes.select(*by, F.explode(listed).alias("_t")).select(*by, "_t.*").withColumn("low", F.floor("place"))
    upto = F.col("below") + F.col("upto")
    touched = placed.join(targets, [*by, "feature", "_q"]).where((upto > F.col("low")) & (upto - F.col("n") <= F.col("low") + 1))
    hits = touched.groupBy(*by, "feature", "probability", "place", "low").agg(
        F.min("value").alias("lower"),
        F.min(F.when(upto > F.col("low") + 1, F.col("value"))).alias("upper"),
    )
    upper = F.coalesce("upper", "lower")
    found = F.col("lower") + (upper - F.col("lower")) * (F.col("place") - F.col("low"))
    return hits.select(*by, "feature", "probability", found.alias("quantile"))
