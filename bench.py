"""Headline queries, timed once each. Prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gaugebook import build_session  # noqa: E402
from gaugebook.catalog.feeds import events_store  # noqa: E402
from gaugebook.catalog.load import QUERIES  # noqa: E402

# Name, registered query. The first five do ingest work, the rest read a table set
# that `ingest_events` has built.
HEADLINE = [
    ("limit_crossings", "limit_crossings"),
    ("identified_verdicts", "flt_12_withheld"),
    ("contested_verdicts", "str_3_contested_verdicts"),
    ("late_readings", "str_4_late_readings"),
    ("ingest_events", None),
    ("site_metrics", "jn_13_site_metrics"),
    ("site_listing", "rep_8_site_listing"),
    ("reconcile", "rep_2_reconcile"),
    ("conflicts", "jn_8_value_conflicts"),
    ("month_counts", "snk_1_measurements_by_month"),
    ("running_totals", "wn_3_running_total"),
    ("event_backlog", "rep_7_event_backlog"),
    ("next_deliveries", "ord_3_next_deliveries"),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()

    seconds, extra = {}, {}
    for name, registered in HEADLINE:
        start = time.time()
        if registered is None:
            store = events_store(spark, sf_dir)
            seconds[name] = round(time.time() - start, 3)
            batches = store.read("batch_ledger").count()
            extra["ingest_batches"] = batches
            extra["ingest_batches_per_sec"] = round(batches / seconds[name], 1)
            continue
        QUERIES[registered](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").split("sf")[-1],
        **extra,
    }))


if __name__ == "__main__":
    main()
