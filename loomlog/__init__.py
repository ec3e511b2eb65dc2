"""Log-event analytics on Spark: ingest, search, count, compare and export events at scale."""

from loomlog.operators.aggregates import (
    alert_count,
    anomaly,
    count_logs,
    count_search,
    deploy_impact,
    histogram,
    list_services,
    recent_histogram,
    summarize,
)
from loomlog.operators.counters import log_counts
from loomlog.operators.pages import (
    export_logs,
    get_log,
    query_field,
    query_logs,
    search_logs,
    tail_cursor,
    tail_logs,
    trace_logs,
)
from loomlog.operators.sqlsurface import query_sql
from loomlog.operators.tokens import search_by_tokens, token_table, write_token_table
from loomlog.operators.traces import trace_gaps
from loomlog.session import build_session, prepare
from loomlog.sinks.exports import export_csv, export_everything, export_ndjson
from loomlog.sinks.metrics import prometheus_lines
from loomlog.sinks.store import delete_where, ingest_batch, purge_before, purge_excess
from loomlog.sources.events import read_lines
from loomlog.sources.store import read_counts, read_logs
from loomlog.sources.syslog import parse_syslog
from loomlog.sources.webhooks import verify_webhooks
from loomlog.streaming.ingest import ingest_stream
from loomlog.streaming.tail import tail_stream, watch

__all__ = [
    "alert_count",
    "anomaly",
    "build_session",
    "count_logs",
    "count_search",
    "delete_where",
    "deploy_impact",
    "export_csv",
    "export_everything",
    "export_logs",
    "export_ndjson",
    "get_log",
    "histogram",
    "ingest_batch",
    "ingest_stream",
    "list_services",
    "log_counts",
    "parse_syslog",
    "prepare",
    "prometheus_lines",
    "purge_before",
    "purge_excess",
    "query_field",
    "query_logs",
    "query_sql",
    "read_counts",
    "read_lines",
    "read_logs",
    "recent_histogram",
    "search_by_tokens",
    "search_logs",
    "summarize",
    "tail_cursor",
    "tail_logs",
    "tail_stream",
    "token_table",
    "trace_gaps",
    "trace_logs",
    "verify_webhooks",
    "watch",
    "write_token_table",
]
