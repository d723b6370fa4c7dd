"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and
cores. Each query writes to the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalogue  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "load_filtered", "features_all", "feat_structuring_7d", "feat_fan_in_count",
    "feat_recent_inflow_24h", "rules_all", "stat_scores", "escalation", "risk_scores",
    "forest_scores", "customer_page", "ledger_customers", "threshold_aggregation",
    "eda_summary", "amount_histogram", "graph_cycles", "graph_bipartite", "graph_scatter_gather",
    "drift_report", "queue_state", "bm25_topk", "investigate_structuring",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    catalogue.QUERIES["load_filtered"](spark, sf).count()  # start the JVM's workers
    took = {}
    for name in chosen:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
