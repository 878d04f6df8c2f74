"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from driftlane import catalog

HEADLINE = ("asof_baseline_stats", "mahalanobis_2d", "cusum", "warning_starts", "future_onset_target", "warning_metrics", "operating_threshold", "rolling_std", "pr_auc")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalog.QUERIES[n] for n in HEADLINE}
    try:
        from driftlane.llm.queries import QUERIES as text

        queries |= {n: f for n, f in text.items() if n.startswith(("op3", "op4", "op5", "op10"))}
    except ImportError:
        pass
    took = {}
    for name, f in queries.items():
        start = time.perf_counter()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
