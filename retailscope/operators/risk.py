"""Reference statistics, leakage audit, scaling, and explained batch scores of the return-risk model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailscope.functions.numeric import rows
from retailscope.functions.ordered import exact_quantiles, quantiles
from retailscope.operators import quality
from retailscope.operators.features import BINARY, CATEGORICAL, NUMERIC, shipping_ratio
from retailscope.session import staged

DEFAULT_SEGMENT = "Consumer"
RISK_MARGIN = 0.003
MIN_SUPPORT = 100


def melted_categories(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return train.select("target", F.explode(cells).alias("cell")).select("target", "cell.feature", "cell.value")


def category_rates(train: DataFrame, columns: Sequence[str] = (*CATEGORICAL, *BINARY)) -> DataFrame:
    """Return rate and support per feature value, all features in one pass."""
    return (
        melted_categories(train, columns)
        .groupBy("feature", "value")
        .agg(F.avg("target").alias("rate"), rows().alias("support"))
    )


def numeric_quartiles(train: DataFrame) -> DataFrame:
    return quantiles(train, NUMERIC, [0.25, 0.75])


def reference_stats(train: DataFrame) -> DataFrame:
    """Everything the explanations need, as (statistic, feature, value, amount). From training rows only."""
    overall = train.agg(F.avg("target").alias("amount")).select(
        F.lit("overall_rate").alias("statistic"), F.lit("").alias("feature"), F.lit("").alias("value"), "amount"
    )
    rates = category_rates(train).select(F.lit("rate").alias("statistic"), "feature", "value", F.col("rate").alias("amount"))
    quartiles = numeric_quartiles(train).select(
        F.lit("quantile").alias("statistic"),
        "feature",
        F.when(F.col("probability") == 0.25, "p25").otherwise("p75").alias("value"),
        F.col("quantile").alias("amount"),
    )
    return overall.unionByName(rates).unionByName(quartiles)


def decile_rates(train: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Return rate and support per decile; equal edges merge, bins are right-closed, the lowest included."""
    told = exact_quantiles(train, columns, [i / 10 for i in range(11)])
    # a short list of upper edges for each column
    edges = {c: sorted(set(q))[1:] or list(q[:1]) for c, q in told.items() if q[0] is not None}
    upper = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*map(F.lit, edges[c])) if c in edges else F.lit(None).cast("array<double>"))])[F.col("feature")]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = train.select("target", F.explode(cells).alias("cell")).select("target", "cell.*")
    decile = F.size(F.filter(upper, lambda e: e < F.col("value"))) + 1
    return long.groupBy("feature", decile.alias("bin")).agg(F.avg("target").alias("rate"), rows().alias("support"))


def leakage_audit(train: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Per feature value and decile the return rate; flagged when enough rows all share one outcome."""
    values = category_rates(train).select("feature", F.col("value").alias("bin"), "rate", "support")
    bins = decile_rates(train).select("feature", F.col("bin").cast("string").alias("bin"), "rate", "support")
    pinned = (F.col("support") >= min_support) & F.col("rate").isin(0.0, 1.0)
    return values.unionByName(bins).withColumn("leaks", pinned)


def robust_scaled(df: DataFrame, reference: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """(x - median) / interquartile range with exact statistics of the reference rows; a zero range divides by 1."""
    stats = exact_quantiles(reference, columns, [0.25, 0.5, 0.75])
    scaled = {}
    for c, (low, middle, high) in stats.items():
        spread = 1.0 if low is None or high == low else high - low
        scaled[c] = (F.col(c) - F.lit(middle).cast("double")) / spread
    return df.withColumns(scaled)


def one_hot(df: DataFrame, column: str, vocabulary: Sequence[str]) -> DataFrame:
    """One 0/1 column per known value; an unknown value is all zeros."""
    flags = {f"{column}={v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(vocabulary)}
    return df.withColumns(flags)


# --- scoring --------------------------------------------------------------------------------------


def validated_requests(requests: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Requests with their violations: amounts, vocabularies, and values the model never saw.

    `categories` is the training vocabulary as (feature, value); without it only fixed rules apply.
    """
    rules = {
        **quality.required("customer_id", "gross_sales", "shipping_cost"),
        **quality.positive("gross_sales"),
        **quality.within("shipping_cost", 0),
    }
    checked = quality.violations(requests, rules)
    if categories is None:
        return checked
    unseen = []
    for c in CATEGORICAL:
        if c in requests.columns:  # joined by value; Spark sends the vocabulary along where it is small
            values = categories.where(F.col("feature") == c).select(F.col("value").alias(c)).distinct().withColumn(f"_known_{c}", F.lit(True))
            checked = checked.join(values, c, "left")
            unseen.append(F.when(F.col(c).isNotNull() & F.col(f"_known_{c}").isNull(), F.lit(f"{c} was never seen in training")))
    told = checked.withColumn("violations", F.concat("violations", F.array_compact(F.array(*unseen))))
    return told.select(*requests.columns, "violations")


def request_features(requests: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Model features of orders not yet placed: every stored order of the customer is history.

    Unknown customers count as first-time buyers of the default segment.
    """
    asked = requests.select("customer_id").distinct()
    history = orders.join(asked, "customer_id", "left_semi").groupBy("customer_id").agg(rows().alias("n"), F.sum("net_sales").alias("net"))
    joined = requests.join(history, "customer_id", "left").join(
        customers.select("customer_id", "customer_segment"), "customer_id", "left"
    )
    return joined.withColumns(
        {
            "shipping_ratio": shipping_ratio(),
            "customer_segment": F.coalesce("customer_segment", F.lit(DEFAULT_SEGMENT)),
            "customer_prior_order_count": F.coalesce("n", F.lit(0)).cast("bigint"),
            "customer_prior_revenue": F.coalesce(F.col("net").cast("double"), F.lit(0.0)),
            "is_repeat_customer_asof": (F.coalesce("n", F.lit(0)) > 0).cast("int"),
        }
    ).drop("n", "net")


# Sentences of the explanation.
RATE_FACTOR = "%s='%s' has a historical return rate of %.2f%%, above the overall training average of %.2f%%."
QUARTILE_FACTOR = "%s=%s is in the top quartile of training orders (75th percentile threshold: %s)."
NO_FACTORS = (
    "No individually elevated risk factors identified for this order - "
    "its feature values are close to the overall training averages."
)


def _exponent(value: Column) -> Column:
    return F.split(F.format_string("%.12e", value), "e")[1].cast("int")


def _rounded(value: Column, size: Column) -> Column:
    ten = F.lit(10.0)
    digits = F.rint(F.when(size > 3, value / F.pow(ten, size - 3)).otherwise(value * F.pow(ten, 3 - size)))  # half-even
    return F.when(size > 3, digits * F.pow(ten, size - 3)).otherwise(digits / F.pow(ten, 3 - size))


def _shown(rounded: Column, scientific: Column) -> Column:
    power = F.split(scientific, "e")[1].cast("int")
    fixed = F.regexp_replace(rounded.cast("decimal(20,8)").cast("string"), r"\.?0+$", "")
    return F.when((power < -4) | (power >= 4), F.regexp_replace(scientific, r"\.?0+e", "e")).otherwise(fixed)


def four_digits(value: Column) -> Column:
    """Four significant digits without trailing zeros; exponent form outside 1e-4 .. 1e4."""
    rounded = _rounded(value, _exponent(value))
    return _shown(rounded, F.format_string("%.3e", rounded))


def with_four_digits(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """`df` plus `four_digits` of every entry of `values`, NULL for NULL; each step is a column, so that none is computed twice."""
    steps = {name: [f"_{step}_{name}" for step in ("value", "size", "rounded", "scientific")] for name in values}
    told = df.withColumns({steps[n][0]: v for n, v in values.items()})
    told = told.withColumns({size: F.when(F.col(value).isNotNull(), _exponent(F.col(value))) for value, size, _, _ in steps.values()})
    told = told.withColumns({rounded: _rounded(F.col(value), F.col(size)) for value, size, rounded, _ in steps.values()})
    told = told.withColumns({scientific: F.when(F.col(rounded).isNotNull(), F.format_string("%.3e", rounded)) for _, _, rounded, scientific in steps.values()})
    told = told.withColumns({n: _shown(F.col(rounded), F.col(scientific)) for n, (_, _, rounded, scientific) in steps.items()})
    return told.drop(*[c for s in steps.values() for c in s])


def explained(features: DataFrame, stats: DataFrame, margin: float = RISK_MARGIN) -> DataFrame:
    """`features` plus `contributing_factors`: risky category values first, then top-quartile numbers.

    The statistics are a few dozen rows; they reach the tasks as one row from a scalar subquery, which holds the finished
    sentence of every risky category value and the threshold of every number.
    """
    amount, value = F.col("amount"), F.col("value")
    rates = [F.collect_list(F.when((F.col("statistic") == "rate") & (F.col("feature") == c) & value.isNotNull(), F.struct(value.cast("string").alias("value"), "amount"))).alias(c) for c in CATEGORICAL]
    edges = [F.max(F.when((F.col("statistic") == "quantile") & (F.col("feature") == c) & (value == "p75"), amount)).alias(c) for c in NUMERIC]
    known = stats.agg(F.max(F.when(F.col("statistic") == "overall_rate", amount)).alias("overall"), *rates, *edges)
    overall = F.col("overall")

    def sentences(c: str) -> Column:
        risky = F.filter(F.col(c), lambda r: r["amount"] - overall >= margin)
        told = lambda r: F.struct(r["value"], F.format_string(RATE_FACTOR, F.lit(c), r["value"], r["amount"] * 100, overall * 100))
        return F.map_from_entries(F.transform(risky, told))

    edge_text = [F.when(F.col(c).isNotNull(), four_digits(F.col(c).cast("double"))).alias(f"{c}_text") for c in NUMERIC]
    lookup = known.select(F.struct(*[sentences(c).alias(c) for c in CATEGORICAL], *NUMERIC, *edge_text)).scalar()
    frame = features.withColumn("_stats", lookup)
    digits = {f"_digits_{c}": F.when(F.col(c) > F.col(f"_stats.{c}"), F.col(c).cast("double")) for c in NUMERIC}
    frame = with_four_digits(frame, digits)
    none = F.array().cast("array<string>")
    factors = []
    for c in CATEGORICAL:
        told = F.try_element_at(F.col(f"_stats.{c}"), F.col(c).cast("string"))
        factors.append(F.when(told.isNotNull(), F.array(told)).otherwise(none))
    for c, shown in zip(NUMERIC, digits, strict=True):
        told = F.format_string(QUARTILE_FACTOR, F.lit(c), shown, f"_stats.{c}_text")
        factors.append(F.when(F.col(shown).isNotNull(), F.array(told)).otherwise(none))
    frame = frame.withColumn("_found", F.concat(*factors))
    return frame.withColumn(
        "contributing_factors", F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.lit(NO_FACTORS)))
    ).drop("_stats", "_found", *digits)


def stored_stats(train: DataFrame) -> DataFrame:
    """Reference statistics written once, for repeated explaining."""
    return staged(reference_stats(train), "risk-stats")
