"""Times the headline queries on `$BENCH_SF_DIR` and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "a1_top_customers",
    "a2_top_products",
    "a3_monthly_revenue",
    "a4_yearly_revenue",
    "a5_category_margin",
    "a6_region_fulfilment",
    "a7_channel_aov",
    "a8_return_rate",
    "a9_return_rate_by_category",
    "a11_returned_with_rating",
    "a12_rating_by_delivery",
    "a13_discount_profitability",
    "a14_channel_roi",
    "k1_headline",
    "k12_lifetime_value",
    "k37_top_categories_per_region",
    "k39_rating_headline",
    "z1_cross_sell_pairs",
    "z2_days_between_orders",
    "e2_describe",
    "e14_correlations",
    "p4_segment_summary",
    "p5_orders_report_stats",
    "q7_insert_batch",
    "q14_leakage_audit",
    "m9_feature_table",
    "m16_roc_auc",
    "m14_logistic_regression",
    "r1_section_chunks",
    "r6_top_k",
    "s7_atomic_load",
    "p2_rfm_scores",
    "r6_top_k_blocked",
    "r12_approximate_neighbours",
]


def main() -> None:
    from retailscope.plans.catalog import QUERIES
    from retailscope.session import drop_staged, local_session

    spark = local_session("bench", CORES, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    for name in ("a5_category_margin", "a1_top_customers"):  # start the executor and compile before the clock
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        # every row is computed and none is kept
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        drop_staged(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": FOLDER.rsplit("sf", 1)[-1], "cpus": CORES}))


if __name__ == "__main__":
    main()
