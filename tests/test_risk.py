import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retailscope.operators import features, metrics, models, quality, risk
from retailscope.operators.features import CATEGORICAL, NUMERIC
from retailscope.sources.standin import ITEM_ORDER


def scored_frame(n=800, seed=2):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.2).astype(int)
    score = np.round(np.clip(rng.normal(0.4 + 0.15 * label, 0.2), 0, 1), 2)  # ties on purpose
    return pd.DataFrame({"label": label, "score": score})


def brute(frame):
    label, score = frame["label"].to_numpy(), frame["score"].to_numpy()
    pos, neg = score[label == 1], score[label == 0]
    auc = ((pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        hit = score >= t
        recall, precision = label[hit].sum() / label.sum(), label[hit].mean()
        ap += (recall - last) * precision
        last = recall
    return auc, ap


def test_ranking_metrics_equal_brute_force(spark):
    frame = scored_frame()
    df = spark.createDataFrame(frame)
    got = metrics.ranking_metrics(metrics.curve(df, "label", "score")).first()
    auc, ap = brute(frame)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-7) and got["pr_auc"] == pytest.approx(ap, abs=1e-7)


def test_metrics_by_group_and_threshold(spark):
    parts = {name: scored_frame(300, seed) for name, seed in (("a", 4), ("b", 5))}
    df = spark.createDataFrame(pd.concat([f.assign(model=n) for n, f in parts.items()]))
    got = {r["model"]: r for r in metrics.classification_metrics(df, "label", "score", ["model"]).collect()}
    for name, frame in parts.items():
        hit = frame["score"] >= 0.5
        tp = int((hit & (frame["label"] == 1)).sum())
        assert got[name]["tp"] == tp and got[name]["precision"] == pytest.approx(tp / hit.sum())
        assert got[name]["roc_auc"] == pytest.approx(brute(frame)[0], abs=1e-7)


def test_no_positive_predictions_score_zero(spark):
    df = spark.sql("SELECT 1 AS label, 0.1D AS score UNION ALL SELECT 0, 0.2D")
    row = metrics.threshold_metrics(df, "label", "score").first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_model_selection(spark):
    df = spark.sql("SELECT * FROM VALUES ('x', 'train', 0.2D), ('x', 'test', 0.1D), ('y', 'train', 0.12D), ('y', 'test', 0.13D) AS t(model, split, pr_auc)")
    got = {r["model"]: (r["gap"], r["selected"]) for r in metrics.gaps(df).collect()}
    assert got == {"x": (0.1, False), "y": (-0.01, True)}


def history_orders(spark):
    rng = random.Random(9)
    rows = [(i, f"C{rng.choice([0] * 10 + list(range(20)))}", f"2024-01-{1 + rng.randrange(28):02d}", rng.randrange(100, 999)) for i in range(400)]
    return rows, spark.createDataFrame(rows, "order_id bigint, customer_id string, d string, n bigint").selectExpr(
        "order_id", "customer_id", "cast(d as date) AS order_date", "cast(n as decimal(12,2)) AS net_sales"
    )


def test_history_looks_only_back(spark):
    rows, df = history_orders(spark)
    got = {r["order_id"]: (r["prior_orders"], float(r["prior_revenue"])) for r in features.order_history(df).collect()}
    seen = {}
    for order_id, customer, _, net in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        count, total = seen.get(customer, (0, 0.0))
        assert got[order_id] == (count, total)
        seen[customer] = (count + 1, total + net)


def test_primary_category_takes_the_first_of_equal_items(spark):
    items = spark.sql("SELECT * FROM VALUES (1, 10, 5.00, 2), (1, 11, 5.00, 1), (1, 12, 4.00, 0), (2, 12, -1.00, 0) AS t(order_id, product_id, net_sales, pos)")
    products = spark.sql("SELECT * FROM VALUES (10, 'A'), (11, 'B'), (12, 'C') AS t(product_id, product_category)")
    assert sorted(tuple(r) for r in features.primary_category(items, products, ["pos"]).collect()) == [(1, "B"), (2, "C")]


def train_table(spark):
    rng = random.Random(11)
    rows = [
        (i, rng.random(), *[rng.choice("xyz") for _ in CATEGORICAL], rng.randrange(6), rng.random() * 500, rng.randrange(2), int(rng.random() < 0.3), rng.choice(["train", "train", "test"]))
        for i in range(600)
    ]
    names = ["order_id", "shipping_ratio", *CATEGORICAL, "customer_prior_order_count", "customer_prior_revenue", "is_repeat_customer_asof", "target", "split"]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names))


def test_decile_bins_like_merged_quantile_cuts(spark):
    df = train_table(spark)
    frame = df.toPandas()
    got = {(r["feature"], r["bin"]): r["support"] for r in risk.decile_rates(df).collect()}
    for c in NUMERIC:
        bins = pd.qcut(frame[c], 10, duplicates="drop", labels=False) + 1
        assert {k[1]: v for k, v in got.items() if k[0] == c} == bins.value_counts().to_dict()


def test_leak_is_flagged(spark):
    df = train_table(spark).withColumn("region", F.when(F.col("target") == 1, "bad").otherwise("good"))
    flagged = {(r["feature"], r["bin"]) for r in risk.leakage_audit(df).where("leaks").collect()}
    assert flagged == {("region", "bad"), ("region", "good")}


def test_robust_scaling_uses_the_reference_rows(spark):
    df = train_table(spark)
    reference = df.where("split = 'train'")
    got = risk.robust_scaled(df.select("order_id", *NUMERIC), reference).toPandas().set_index("order_id").sort_index()
    frame, train = df.toPandas().set_index("order_id").sort_index(), reference.toPandas()
    for c in NUMERIC:
        low, mid, high = np.quantile(train[c], [0.25, 0.5, 0.75])
        assert np.allclose(got[c], (frame[c] - mid) / (high - low))


def test_unknown_values(spark):
    df = spark.sql("SELECT 'a' AS c UNION ALL SELECT 'q'")
    hot = {r["c"]: (r["c=a"], r["c=b"]) for r in risk.one_hot(df, "c", ["b", "a"]).collect()}
    assert hot == {"a": (1, 0), "q": (0, 0)}


def requests(spark):
    return spark.sql(
        """SELECT * FROM VALUES ('r1', 'C1', 250.00, 12.50, 'x', 'x', 'y', 'z', 'x'), ('r2', 'NEW', 100.00, 0.00, 'x', 'x', 'y', 'z', 'x'),
        ('r3', 'C1', 0.00, 1.00, 'x', 'x', 'y', 'z', 'x'), ('r4', 'C1', 10.00, 1.00, 'Fax', 'x', 'y', 'z', 'x')
        AS t(request_id, customer_id, gross_sales, shipping_cost, sales_channel, payment_method, shipping_method, region, primary_category)"""
    )


def test_requests_are_validated_and_unknown_customers_default(spark):
    train = train_table(spark)
    known = risk.melted_categories(train, CATEGORICAL).select("feature", "value").distinct()
    checked = risk.validated_requests(requests(spark), known)
    got = {r["request_id"]: r["violations"] for r in checked.collect()}
    assert got == {"r1": [], "r2": [], "r3": ["gross_sales > 0"], "r4": ["sales_channel was never seen in training"]}
    orders = spark.sql("SELECT 'C1' AS customer_id, cast(70 as decimal(12,2)) AS net_sales UNION ALL SELECT 'C1', cast(30 as decimal(12,2))")
    people = spark.sql("SELECT 'C1' AS customer_id, 'VIP' AS customer_segment")
    rows = {r["request_id"]: r for r in risk.request_features(quality.accepted(checked), orders, people).collect()}
    assert (rows["r1"]["customer_segment"], rows["r1"]["customer_prior_order_count"], rows["r1"]["customer_prior_revenue"]) == ("VIP", 2, 100.0)
    assert (rows["r2"]["customer_segment"], rows["r2"]["customer_prior_order_count"], rows["r2"]["is_repeat_customer_asof"]) == ("Consumer", 0, 0)
    assert rows["r1"]["shipping_ratio"] == 0.05


def test_factors_name_rates_then_quartiles(spark):
    stats = spark.sql(
        """SELECT * FROM VALUES ('overall_rate', '', '', 0.07D), ('rate', 'region', 'South', 0.0735D), ('rate', 'region', 'North', 0.0715D),
        ('quantile', 'shipping_ratio', 'p75', 0.25D), ('quantile', 'customer_prior_order_count', 'p75', 4.0D), ('quantile', 'customer_prior_revenue', 'p75', 12345.6D)
        AS t(statistic, feature, value, amount)"""
    )
    blank = {c: F.lit("other") for c in CATEGORICAL}
    df = spark.sql("SELECT * FROM VALUES (1, 'South', 0.5D, 4L, 20000.0D), (2, 'North', 0.25D, 1L, 0.0D) AS t(id, r, shipping_ratio, customer_prior_order_count, customer_prior_revenue)")
    df = df.withColumns(blank).withColumn("region", F.col("r"))
    got = {r["id"]: r["contributing_factors"] for r in risk.explained(df, stats).collect()}
    assert got[1] == [
        "region='South' has a historical return rate of 7.35%, above the overall training average of 7.00%.",
        "shipping_ratio=0.5 is in the top quartile of training orders (75th percentile threshold: 0.25).",
        "customer_prior_revenue=2e+04 is in the top quartile of training orders (75th percentile threshold: 1.235e+04).",
    ]
    assert got[2] == [risk.NO_FACTORS]


def test_model_scores_reload_and_stream(spark, tmp_path):
    from retailscope.streaming.scoring import score_stream

    table = train_table(spark)
    train = table.where("split = 'train'")
    fitted = models.fit(train, "logistic_regression")
    path = str(tmp_path / "model")
    models.save(fitted, path)
    check = models.same_scores(fitted, models.load(path), table).first()
    assert check["rows"] == table.count() and check["differing"] == 0
    told = models.scored(fitted, table).toPandas()
    assert told["return_probability"].between(0, 1).all()
    assert ((told["return_probability"] >= 0.5) == (told["predicted_label"] == "Returned")).all()
    metrics_rows = models.compared({"lr": fitted}, table).collect()
    assert {(r["model"], r["split"]) for r in metrics_rows} == {("lr", "train"), ("lr", "test")}
    unseen = table.limit(1).withColumn("region", F.lit("Atlantis"))
    assert models.scored(fitted, unseen).count() == 1

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    requests(spark).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(requests(spark).schema).parquet(source)
    orders = spark.sql("SELECT 'C1' AS customer_id, cast(70 as decimal(12,2)) AS net_sales")
    people = spark.sql("SELECT 'C1' AS customer_id, 'VIP' AS customer_segment")
    known = risk.melted_categories(train, CATEGORICAL).select("feature", "value").distinct()
    query = score_stream(stream, orders, people, fitted, risk.stored_stats(train), target, str(tmp_path / "cp"), known)
    query.awaitTermination(120)
    assert query.exception() is None
    assert {r["request_id"] for r in spark.read.parquet(f"{target}/scored").collect()} == {"r1", "r2"}
    assert {r["request_id"] for r in spark.read.parquet(f"{target}/refused").collect()} == {"r3", "r4"}


def test_boosting_fits_and_single_class_is_refused(spark, star):
    table = train_table(spark).where("split = 'train'")
    with pytest.raises(ValueError):
        models.fit(table.where("target = 0"), "logistic_regression")
    with pytest.raises(ValueError):
        models.estimator("magic", 1.0)


def test_feature_table_of_the_star(star):
    table = features.feature_table(star.orders(True), star.items(*ITEM_ORDER), star.products(), star.customers(), ITEM_ORDER, 1999)
    found = table.agg(F.count_if(F.col("shipping_ratio").isNull()), F.count_if(F.col("is_repeat_customer_asof") != (F.col("customer_prior_order_count") > 0).cast("int"))).first()
    assert tuple(found) == (0, 0)
    first = table.where("customer_prior_order_count = 0").agg(F.max("customer_prior_revenue")).first()[0]
    assert first == 0.0


def test_each_number_is_put_into_words_once(spark):
    blank = {c: F.lit("other") for c in CATEGORICAL}
    df = spark.createDataFrame([(1, 0.5, 5, None), (2, 0.1, None, 1e9), (3, None, 1, 0.5)], "id int, shipping_ratio double, customer_prior_order_count long, customer_prior_revenue double").withColumns(blank).withColumn("region", F.lit(None).cast("string"))
    stats = spark.createDataFrame([("overall_rate", "", "", 0.07), ("rate", "region", None, 0.5), *[("quantile", c, "p75", 0.25) for c in ("shipping_ratio", "customer_prior_order_count", "customer_prior_revenue")]], "statistic string, feature string, value string, amount double")
    told = risk.explained(df, stats)
    got = {r["id"]: [f.split(" ")[0] for f in r["contributing_factors"]] for r in told.collect()}
    assert got == {1: ["shipping_ratio=0.5", "customer_prior_order_count=5"], 2: ["customer_prior_revenue=1e+09"], 3: ["customer_prior_order_count=1", "customer_prior_revenue=0.5"]}
    # lambdas would take the sentences of all rows out of generated code
    plan = told._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("lambdafunction" in line and "overall" not in line for line in plan)


def test_a_forest_is_the_mean_of_its_parts(spark):
    train = train_table(spark).where("split = 'train'")
    fitted = models.fit(train, "random_forest")
    parts = [s for s in fitted.stages if s.hasParam("numTrees")]
    assert len(parts) > 1 and sum(s.getNumTrees for s in parts) == 300 and {s.getMaxDepth() for s in parts} == {8}
    assert len({s.toDebugString for s in parts}) == len(parts)  # no part repeats another's trees
    rows = fitted.transform(train).withColumn("told", models.chance(fitted)).limit(20).collect()
    for r in rows:
        assert abs(r["told"] - sum(r[s.getProbabilityCol()][1] for s in parts) / len(parts)) < 1e-12
