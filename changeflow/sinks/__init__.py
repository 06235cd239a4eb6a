from changeflow.sinks.committed import committed_batches, committed_log, remove_unlisted, start_committed
from changeflow.sinks.tables import (
    append_checkpoints,
    batch_path,
    landed,
    write_batch,
    write_change_log,
    write_kafka,
)

__all__ = [
    "append_checkpoints",
    "batch_path",
    "committed_batches",
    "committed_log",
    "landed",
    "remove_unlisted",
    "start_committed",
    "write_batch",
    "write_change_log",
    "write_kafka",
]
