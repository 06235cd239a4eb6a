from changeflow.sources.catalog import catalog_scan, jdbc_catalog_columns
from changeflow.sources.changes import (
    from_position,
    kafka_changes,
    malformed,
    number_changes,
    parsed_records,
    read_changes,
    skip_executed,
    stream_changes,
    well_formed,
)
from changeflow.sources.checkpoints import executed_ranges, read_checkpoint, read_checkpoints
from changeflow.sources.chunks import change_events, chunked_snapshot, keyed_rows, table_after
from changeflow.sources.positions import stream_from_position
from changeflow.sources.snapshot import bootstrap, snapshot_rows

__all__ = [
    "bootstrap",
    "catalog_scan",
    "change_events",
    "chunked_snapshot",
    "executed_ranges",
    "from_position",
    "jdbc_catalog_columns",
    "keyed_rows",
    "kafka_changes",
    "malformed",
    "number_changes",
    "parsed_records",
    "read_changes",
    "read_checkpoint",
    "read_checkpoints",
    "skip_executed",
    "snapshot_rows",
    "stream_changes",
    "stream_from_position",
    "table_after",
    "well_formed",
]
