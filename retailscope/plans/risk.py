"""Return-risk features, metrics and models with their checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from retailscope.functions.numeric import rows
from retailscope.operators import features, metrics, models, quality, risk
from retailscope.operators.features import BINARY, CATEGORICAL, FEATURES, NUMERIC
from retailscope.plans.checks import ratio, star
from retailscope.plans.registry import add
from retailscope.session import shared_folder, staged
from retailscope.sources.standin import ITEM_ORDER

LAST_TRAIN_YEAR = 1999

HISTORY = """
, h AS (SELECT *, row_number() OVER w - 1 AS prior_orders, coalesce(sum(net_c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_c
  FROM s_orders WINDOW w AS (PARTITION BY customer_id ORDER BY order_date, order_id))"""
PRIMARY = f"""
, c AS (SELECT order_id, product_category AS primary_category FROM (SELECT i.order_id, p.product_category,
  row_number() OVER (PARTITION BY i.order_id ORDER BY i.net_c DESC, {', '.join('i.' + c for c in ITEM_ORDER)}) AS k
  FROM s_items i JOIN s_products p USING (product_id)) WHERE k = 1)"""
TABLE = (
    HISTORY
    + PRIMARY
    + f"""
, t AS (SELECT h.order_id, (ship_c::double / 100) / (gross_c::double / 100) AS shipping_ratio, sales_channel, payment_method, shipping_method, h.region,
  customer_segment, primary_category, prior_orders AS customer_prior_order_count, prior_c::double / 100 AS customer_prior_revenue,
  cast(prior_orders > 0 as int) AS is_repeat_customer_asof, cast(order_status = 'Returned' as int) AS target,
  CASE WHEN year(order_date) <= {LAST_TRAIN_YEAR} THEN 'train' ELSE 'test' END AS split
  FROM h JOIN s_customers USING (customer_id) JOIN c ON c.order_id = h.order_id WHERE gross_c > 0),
tr AS (SELECT * FROM t WHERE split = 'train')"""
)


def table(s):
    return features.feature_table(s.orders(True), s.items(*ITEM_ORDER), s.products(), s.customers(), ITEM_ORDER, LAST_TRAIN_YEAR)


def train(s):
    return table(s).where("split = 'train'")


add(
    "m1_target",
    lambda s: features.target_summary(s.orders()),
    star(f"SELECT count(*) AS orders, count(return_status) AS returned, {ratio('count(return_status)', 'count(*)', 6)} AS return_rate FROM s_orders"),
)
add(
    "m2_temporal_split",
    lambda s: features.split_summary(s.orders(), LAST_TRAIN_YEAR),
    star(
        f"""SELECT CASE WHEN year(order_date) <= {LAST_TRAIN_YEAR} THEN 'train' ELSE 'test' END AS split, count(*) AS orders,
  count(return_status) AS returned, min(order_date) AS first_date, max(order_date) AS last_date,
  {ratio('count(return_status)', 'count(*)', 6)} AS return_rate FROM s_orders GROUP BY 1"""
    ),
)
add(
    "m3_shipping_ratio",
    lambda s: s.orders().select("order_id", features.shipping_ratio().alias("shipping_ratio")).where("shipping_ratio is not null"),
    star("SELECT order_id, (ship_c::double / 100) / (gross_c::double / 100) AS shipping_ratio FROM s_orders WHERE gross_c > 0"),
)
add(
    "m4_primary_category",
    lambda s: features.primary_category(s.items(*ITEM_ORDER), s.products(), ITEM_ORDER),
    star(PRIMARY + " SELECT * FROM c"),
)
add(
    "m5_discount_exclusion",
    lambda s: features.discount_exclusion(s.orders()),
    star(
        """SELECT count(*) FILTER (disc_c > 0) AS discounted_orders, count(*) FILTER (disc_c > 0 AND order_status = 'Returned') AS discounted_returns,
  count(*) FILTER (order_status = 'Returned') AS returns, count(*) FILTER (order_status = 'Returned' AND disc_c <= 0) AS returns_without_discount,
  count(*) FILTER (gross_c <= 0) AS orders_without_gross FROM s_orders"""
    ),
)
add(
    "m6_segment_feature",
    lambda s: quality.join_validated(s.orders().select("order_id", "customer_id"), s.customers().select("customer_id", "customer_segment"), "customer_id"),
    star("SELECT order_id, customer_id, customer_segment FROM s_orders LEFT JOIN s_customers USING (customer_id)"),
)
add(
    "m7_stored_history_check",
    lambda s: features.stored_history_check(s.orders()),
    star(
        """
, g AS (SELECT customer_id, count(*) AS n, min(customer_order_count) AS lo, max(customer_order_count) AS hi, bool_or(is_repeat_customer) AS flag FROM s_orders GROUP BY 1)
SELECT count(*) AS customers, count(*) FILTER (lo = hi) AS constant_counts, count(*) FILTER (hi <> n) AS disagreeing_counts,
  count(*) FILTER (flag <> (n > 1)) AS disagreeing_flags FROM g"""
    ),
)
add(
    "m8_order_history",
    lambda s: features.order_history(s.orders().select("customer_id", "order_id", "order_date", "net_sales")).select(
        "order_id", "prior_orders", F.col("prior_revenue").cast("double").alias("prior_revenue")
    ),
    star(HISTORY + " SELECT order_id, prior_orders, prior_c::double / 100 AS prior_revenue FROM h"),
)
add("m9_feature_table", table, star(TABLE + " SELECT * FROM t"))
add(
    "m9_feature_rejects",
    lambda s: features.feature_rejects(s.orders(), s.items()),
    star("SELECT order_id, 'no items' AS reason FROM s_orders WHERE order_id NOT IN (SELECT order_id FROM s_items)"),
)


def scaled(s):
    t = staged(table(s), "features")
    return risk.robust_scaled(t.select("order_id", *NUMERIC), t.where("split = 'train'")).select(
        "order_id", *[F.round(c, 9).alias(c) for c in NUMERIC]
    )


SPREAD = ", ".join(
    f"quantile_cont({c}::double, 0.5) AS {c}_m, nullif(quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25), 0) AS {c}_s" for c in NUMERIC
)
add(
    "m10_robust_scaled",
    scaled,
    star(
        TABLE
        + f", q AS (SELECT {SPREAD} FROM tr) SELECT order_id, "
        + ", ".join(f"round(({c} - {c}_m) / coalesce({c}_s, 1), 9) AS {c}" for c in NUMERIC)
        + " FROM t, q"
    ),
)
KNOWN = ("ECONOMY", "PROMO", "STANDARD")
add(
    "m11_one_hot",
    lambda s: risk.one_hot(features.primary_category(s.items(*ITEM_ORDER), s.products(), ITEM_ORDER), "primary_category", KNOWN).drop("primary_category"),
    star(
        PRIMARY
        + " SELECT order_id, "
        + ", ".join(f"cast(primary_category = '{v}' as int) AS \"primary_category={v}\"" for v in KNOWN)
        + " FROM c"
    ),
)


def requests(s):
    """Every order as a request: customer ids run past the table, and the channel of some is new."""
    placed = s.orders(True).join(features.primary_category(s.items(*ITEM_ORDER), s.products(), ITEM_ORDER), "order_id")
    return placed.selectExpr(
        "order_id AS request_id",
        "customer_id + 100 AS customer_id",
        "gross_sales",
        "shipping_cost",
        "if(payment_method = 'PayPal' and sales_channel = 'Website', 'Telegraph', sales_channel) AS sales_channel",
        "payment_method",
        "shipping_method",
        "region",
        "primary_category",
    )


def categories(s):
    """The training vocabulary without a pass over features: values of the training orders."""
    return risk.melted_categories(train(s), CATEGORICAL).select("feature", "value").distinct()


add(
    "m12_unseen_categories",
    lambda s: quality.rejected(risk.validated_requests(requests(s), categories(s))).select("request_id", F.array_join("violations", "; ").alias("reasons")),
    star("SELECT order_id AS request_id, 'sales_channel was never seen in training' AS reasons FROM s_orders WHERE gross_c > 0 AND payment_method = 'PayPal' AND sales_channel = 'Website'"),
)
add(
    "m23_request_validation",
    lambda s: quality.rejected(
        quality.violations(
            s.orders(True).withColumn("primary_category", F.lit("Grocery")),
            quality.table_rules("score_requests", ["gross_sales", "shipping_cost", "sales_channel", "payment_method", "shipping_method"]),
        )
    ).select("order_id", F.array_join("violations", "; ").alias("reasons")),
    star("SELECT order_id, 'gross_sales > 0' AS reasons FROM s_orders WHERE gross_c <= 0"),
)
add(
    "m13_class_weights",
    lambda s: metrics.class_weights(train(s)),
    star(
        TABLE
        + """ SELECT count(*) AS n, count(*) FILTER (target = 1) AS pos, count(*) FILTER (target = 0) AS neg,
  count(*)::double / (2 * count(*) FILTER (target = 1)) AS weight_pos, count(*)::double / (2 * count(*) FILTER (target = 0)) AS weight_neg,
  (count(*) FILTER (target = 0))::double / count(*) FILTER (target = 1) AS neg_to_pos FROM tr"""
    ),
)


# --- metrics of a fixed score ---------------------------------------------------------------------


def quality_scores(s):
    """Document length as a stand-in score for the quality label."""
    joined = s.raw("labels").join(s.raw("documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return joined.selectExpr("quality AS label", "cast(n_chars as double) / 1000 AS score", "lang")


SCORED = """WITH z AS (SELECT quality AS label, n_chars::double / 1000 AS score, lang FROM labels JOIN documents USING (doc_id)),
d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM z GROUP BY 1),
k AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d WINDOW w AS (ORDER BY score DESC))"""
CONFUSION = """count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn"""
add(
    "m15_threshold_metrics",
    lambda s: metrics.threshold_metrics(quality_scores(s), "label", "score", ["lang"]),
    SCORED
    + f""", c AS (SELECT lang, {CONFUSION} FROM z GROUP BY 1)
SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::double / nullif(tp + fn, 0), 0) AS recall,
  coalesce((2 * tp)::double / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""",
)
add(
    "m16_roc_auc",
    lambda s: metrics.ranking_metrics(metrics.curve(quality_scores(s), "label", "score")).select("roc_auc"),
    SCORED + " SELECT round(sum(neg::double * (tp - pos / 2e0)) / (max(p)::double * max(n)::double), 8) AS roc_auc FROM k",
)
add(
    "m17_average_precision",
    lambda s: metrics.ranking_metrics(metrics.curve(quality_scores(s), "label", "score")).select("pr_auc"),
    SCORED + " SELECT round(sum(pos::double * (tp::double / (tp + fp))) / max(p)::double, 8) AS pr_auc FROM k",
)
add(
    "m18_curve_points",
    lambda s: metrics.curve_points(metrics.curve(quality_scores(s), "label", "score")),
    SCORED + " SELECT score, fp::double / n AS fpr, tp::double / p AS tpr, tp::double / (tp + fp) AS precision FROM k",
)
add(
    "w11_cumulative_counts",
    lambda s: metrics.curve(quality_scores(s), "label", "score").select("score", "tp", "fp"),
    SCORED + " SELECT score, cast(tp as bigint) AS tp, cast(fp as bigint) AS fp FROM k",
)


# --- statistics of the training rows --------------------------------------------------------------

RATES = "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, cast({c} as varchar) AS value, avg(target) AS rate, count(*) AS support FROM tr GROUP BY 1, 2" for c in (*CATEGORICAL, *BINARY)
)
add(
    "m20_reference_stats",
    lambda s: risk.reference_stats(staged(train(s), "train")).withColumn("amount", F.round("amount", 9)),
    star(
        TABLE
        + f", g AS ({RATES}) SELECT 'overall_rate' AS statistic, '' AS feature, '' AS value, round(avg(target), 9) AS amount FROM tr"
        + " UNION ALL SELECT 'rate', feature, value, round(rate, 9) FROM g"
        + "".join(
            f" UNION ALL SELECT 'quantile', '{c}', '{name}', round(quantile_cont({c}::double, {p}), 9) FROM tr"
            for c in NUMERIC
            for name, p in (("p25", 0.25), ("p75", 0.75))
        )
    ),
)


def deciles_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, cast(len(list_filter(e[2:], lambda x: x < v)) + 1 as varchar) AS bin, avg(target) AS rate, count(*) AS support
FROM (SELECT {c}::double AS v, target FROM tr), (SELECT list_sort(list_distinct(quantile_cont({c}::double, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM tr) GROUP BY 1, 2"""


add(
    "q14_leakage_audit",
    lambda s: risk.leakage_audit(staged(train(s), "train")).withColumn("rate", F.round("rate", 9)),
    star(
        TABLE
        + f", g AS ({RATES}), a AS (SELECT feature, value AS bin, rate, support FROM g UNION ALL {' UNION ALL '.join(deciles_sql(c) for c in NUMERIC)})"
        + " SELECT feature, bin, round(rate, 9) AS rate, support, support >= 100 AND rate IN (0, 1) AS leaks FROM a"
    ),
)
add(
    "w7_deciles",
    lambda s: risk.decile_rates(staged(train(s), "train"), ["customer_prior_order_count"]).select("feature", "bin", "support"),
    star(TABLE + f", g AS ({deciles_sql('customer_prior_order_count')}) SELECT feature, cast(bin as int) AS bin, support FROM g"),
)


def scoring_features(s):
    good = quality.accepted(risk.validated_requests(requests(s), None))
    return risk.request_features(good, s.orders(), s.customers())


add(
    "m21_request_features",
    lambda s: scoring_features(s).select("request_id", *FEATURES),
    star(
        PRIMARY
        + """
, a AS (SELECT customer_id, count(*) AS n, sum(net_c) AS net FROM s_orders GROUP BY 1)
SELECT o.order_id AS request_id, (ship_c::double / 100) / (gross_c::double / 100) AS shipping_ratio,
  CASE WHEN payment_method = 'PayPal' AND sales_channel = 'Website' THEN 'Telegraph' ELSE sales_channel END AS sales_channel, payment_method,
  shipping_method, o.region, coalesce(u.customer_segment, 'Consumer') AS customer_segment, primary_category, coalesce(a.n, 0) AS customer_prior_order_count,
  coalesce(a.net, 0)::double / 100 AS customer_prior_revenue, cast(a.n IS NOT NULL as int) AS is_repeat_customer_asof
FROM s_orders o JOIN c USING (order_id) LEFT JOIN a ON a.customer_id = o.customer_id + 100 LEFT JOIN s_customers u ON u.customer_id = o.customer_id + 100
WHERE gross_c > 0"""
    ),
)
FACTORS = " ".join(
    f"+ cast(coalesce((SELECT avg(target) FROM tr x WHERE x.{c} = t.{c}) - (SELECT avg(target) FROM tr) >= 0.003, false) as int)" for c in CATEGORICAL
) + " ".join(f" + cast({c} > (SELECT quantile_cont({c}::double, 0.75) FROM tr) as int)" for c in NUMERIC)


def factors(s):
    t = staged(table(s), "features")
    told = risk.explained(t, risk.stored_stats(t.where("split = 'train'")))
    none = F.col("contributing_factors")[0] == risk.NO_FACTORS
    return told.select("order_id", F.when(none, 0).otherwise(F.size("contributing_factors")).alias("factors"))


add("m22_contributing_factors", factors, star(TABLE + f" SELECT order_id, cast(0 {FACTORS} as int) AS factors FROM t"))


# --- models ---------------------------------------------------------------------------------------


def written_table(s):
    """The feature table, written once per query: training reads it many times."""
    return staged(table(s), "features")


def model_report(s, names):
    """Per model and split: rows and positives by its confusion counts, and whether its figures agree with one another."""
    t = written_table(s)
    fitted = {name: models.fit(t.where("split = 'train'"), name) for name in names}
    told = models.compared(fitted, t)
    hit, said, real = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    agrees = (
        (F.abs(F.col("precision") * said - hit) < 1e-6)
        & (F.abs(F.col("recall") * real - hit) < 1e-6)
        & F.col("roc_auc").between(0, 1)
        & F.col("pr_auc").between(0, 1)
    )
    return told.select("model", "split", (said + F.col("fn") + F.col("tn")).alias("rows"), real.alias("positives"), agrees.alias("figures_agree"))


def report_sql(names) -> str:
    of = ", ".join(f"('{n}')" for n in names)
    return star(TABLE + f" SELECT model, split, count(*) AS rows, sum(target)::bigint AS positives, true AS figures_agree FROM t, (VALUES {of}) AS m(model) GROUP BY 1, 2")


for name in models.FAMILIES:
    add(f"m14_{name}", lambda s, name=name: model_report(s, [name]), report_sql([name]))


def selection(s):
    """Models compared, how many are selected, and whether that one has the best test value and every gap its two ends."""
    t = written_table(s)
    fitted = {name: models.fit(t.where("split = 'train'"), name) for name in models.FAMILIES}
    told = staged(metrics.gaps(models.compared(fitted, t)), "gaps")
    best = told.agg(F.max("test_pr_auc")).scalar()
    return told.agg(
        rows().alias("models"),
        F.count_if("selected").alias("selected"),
        F.bool_and(~F.col("selected") | (F.col("test_pr_auc") == best)).alias("best_is_selected"),
        F.bool_and(F.abs(F.col("train_pr_auc") - F.col("test_pr_auc") - F.col("gap")) < 1e-7).alias("gaps_agree"),
    )


add("m19_model_selection", selection, "SELECT count(*) AS models, 1::bigint AS selected, true AS best_is_selected, true AS gaps_agree FROM (VALUES " + ", ".join(f"('{n}')" for n in models.FAMILIES) + ") AS m(model)")


def scores(s):
    """Every accepted request once, with a probability, the label that follows from it, and at least one factor or the sentence for none."""
    t = written_table(s)
    train_rows = t.where("split = 'train'")
    known = risk.melted_categories(train_rows, CATEGORICAL).select("feature", "value").distinct()
    good = quality.accepted(risk.validated_requests(requests(s), known))
    told = models.scored(models.fit(train_rows, "regularized_boosting"), risk.request_features(good, s.orders(), s.customers()))
    told = risk.explained(told, risk.stored_stats(train_rows))
    p = F.col("return_probability")
    return told.select(
        "request_id",
        p.between(0, 1).alias("is_probability"),
        (F.when(p >= 0.5, "Returned").otherwise("Not Returned") == F.col("predicted_label")).alias("label_follows"),
        (F.size("contributing_factors") > 0).alias("explained"),
    )


add(
    "m21_scored_requests",
    scores,
    star(
        PRIMARY
        + """ SELECT o.order_id AS request_id, true AS is_probability, true AS label_follows, true AS explained
FROM s_orders o JOIN c USING (order_id) WHERE gross_c > 0 AND NOT (payment_method = 'PayPal' AND sales_channel = 'Website')"""
    ),
)


def reloaded(s):
    t = written_table(s)
    fitted = models.fit(t.where("split = 'train'"), "logistic_regression")
    path = f"{shared_folder(s.spark)}/model-{uuid.uuid4().hex}"
    models.save(fitted, path)
    return models.same_scores(fitted, models.load(path), t)


add("s13_model_round_trip", reloaded, star(TABLE + " SELECT count(*) AS rows, 0 AS differing FROM t"))
