"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` the
local threads. Results are written to Spark's no-op sink, so whole results are computed.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from notewell.session import build_session
from workload import catalog

HEADLINE = (
    "opportunity_board", "opportunity_rows", "advisor_drilldown", "window_kpis", "processing_stats", "daily_series", "daily_store_metrics",
    "feedback_quality", "latency_profile", "leaderboard", "join_enrich", "user_inventory", "dedup_keep_first", "tag_lexicon", "guard_mask",
    "mask_pii", "clean_text", "extract_note", "route", "quality_score", "knn", "product_candidates", "upsert", "adjust_stock", "running_sum",
    "drift_report", "stream_step_metrics",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
