"""Run the headline queries and print one JSON line of seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ("win_velocity", "win_amounts", "win_distinct", "win_digits", "win_last_inflow", "win_switches", "live_cycles", "gr_degrees", "gr_clustering", "gr_pagerank", "rl_rules", "fus_scores", "alr_list", "ev_areas", "ev_rule_precision", "agg_corridors")


def main() -> None:
    from riskweave.plans.registry import QUERIES

    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(where.rstrip("/"))}))


if __name__ == "__main__":
    main()
