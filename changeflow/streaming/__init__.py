from changeflow.streaming.relay import (
    current_catalog,
    ddl_log,
    dead_letter_log,
    delivered_log,
    executed_set,
    relay_progress,
    replay,
    row_log,
    start_catalog,
    start_relay,
)
from changeflow.streaming.backlog import backlog_log, late_deltas, start_backlog
from changeflow.streaming.health import health_log, start_health
from changeflow.streaming.rate_limit import kept_log, late_log, start_throttle
from changeflow.streaming.series import kept_samples, series_log, start_series
from changeflow.streaming.stateful import throttle_stream
from changeflow.streaming.versions import late_changes, resolved_log, start_schema_as_of

__all__ = [
    "backlog_log",
    "current_catalog",
    "ddl_log",
    "dead_letter_log",
    "delivered_log",
    "executed_set",
    "health_log",
    "kept_log",
    "kept_samples",
    "late_changes",
    "late_deltas",
    "late_log",
    "relay_progress",
    "replay",
    "resolved_log",
    "row_log",
    "series_log",
    "start_backlog",
    "start_catalog",
    "start_health",
    "start_relay",
    "start_schema_as_of",
    "start_series",
    "start_throttle",
    "throttle_stream",
]
