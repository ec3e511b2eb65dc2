"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR  tables to read (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_RUNS    timed runs per query after one warm-up (default 5); the median counts
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "count_filtered",
    "hist_1h",
    "hist_hour_errors",
    "summary",
    "services",
    "page_newest",
    "trace_page",
    "field_rows_le",
    "top_messages",
    "latency_by_service",
    "anomaly_global",
    "anomaly_by_service",
    "search_count",
    "search_boolean",
    "search_page",
    "dedup_anti",
    "trace_gaps",
    "latest_per_service",
    "correlate_orders",
    "correlate_within",
    "alias_extract",
    "stamped_body",
    "syslog_parse",
    "webhook_signatures",
    "sql_surface",
    "purge_excess",
)


def run(query, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def ingest_rate(spark, sf_dir: str, cpus: int, runs: int) -> tuple[float, float]:
    """Median seconds to ingest all events from landed text files, and events per second."""
    from pyspark.sql import functions as F

    from loomlog.session import shared_dir
    from loomlog.sinks.store import ingest_batch
    from loomlog.sources.events import explode_records, read_lines
    from suite.storage import raw_events

    base = f"{shared_dir(spark)}/bench-{os.getpid()}"
    raw_events(spark, sf_dir).select(F.col("payload").alias("value")).repartition(cpus).write.text(f"{base}/in")
    lines = read_lines(spark, f"{base}/in")
    total, seconds = lines.count(), []
    for i in range(runs + 1):
        events = explode_records(lines).drop("problem")
        started = time.perf_counter()
        ingest_batch(events, f"{base}/{i}", 0)
        seconds.append(time.perf_counter() - started)
    median = statistics.median(seconds[1:])
    return median, total / median


def stored_times(spark, sf_dir: str, runs: int) -> dict[str, float]:
    """Median seconds of searches and field tests over one stored table, by index or members and by bodies."""
    from loomlog.operators.aggregates import count_search, histogram
    from loomlog.operators.pages import field_rows
    from loomlog.operators.rollups import histogram_stored
    from loomlog.operators.tokens import count_search_stored
    from loomlog.session import shared_dir
    from loomlog.sinks.postings import index_store
    from loomlog.sinks.rollups import keep_rollup
    from loomlog.sinks.store import ingest_batch, keep_fields
    from loomlog.sources.store import read_fields, read_logs
    from suite.storage import raw_events

    root = f"{shared_dir(spark)}/bench-stored-{os.getpid()}"
    index_store(spark, root)
    keep_rollup(spark, root)
    keep_fields(spark, root)
    ingest_batch(raw_events(spark, sf_dir), root, 0)
    cases = {
        "search_count_index": lambda: count_search_stored(spark, root, "error NOT s2"),
        "search_count_bodies": lambda: count_search(read_logs(spark, root), "error NOT s2"),
        "hist_rollup": lambda: histogram_stored(spark, root, "6h", by=("service",)),
        "hist_rows": lambda: histogram(read_logs(spark, root), "6h", by=("service",)),
        "field_rows_members": lambda: field_rows(read_fields(spark, root), "n", "<=", 3000).select("id"),
        "field_rows_bodies": lambda: field_rows(read_logs(spark, root), "n", "<=", 3000).select("id"),
    }
    found = {}
    for name, case in cases.items():
        times = [run(lambda *_, case=case: case(), spark, sf_dir) for _ in range(runs + 1)]
        found[name] = round(statistics.median(times[1:]), 4)
    return found


def main() -> None:
    from loomlog.session import build_session

    import suite

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    suite.load()
    queries = {}
    for name in HEADLINE:
        run(suite.QUERIES[name], spark, sf_dir)
        times = [run(suite.QUERIES[name], spark, sf_dir) for _ in range(runs)]
        queries[name] = round(statistics.median(times), 4)
    seconds, rate = ingest_rate(spark, sf_dir, int(cpus), min(runs, 3))
    queries["ingest_batch"] = round(seconds, 4)
    stored = stored_times(spark, sf_dir, runs)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 4),
                "unit": "sec",
                "queries": queries,
                "ingest_events_per_sec": round(rate),
                "stored_table": stored,
                "sf": os.path.basename(os.path.normpath(sf_dir)),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
