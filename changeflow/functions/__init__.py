from changeflow.functions.bodies import canonical_body
from changeflow.functions.gtid import gtid_text, resume_gtid_set, set_ranges, trim_space
from changeflow.functions.partitions import key_partition, murmur2, spread_partition
from changeflow.functions.values import (
    body_bytes,
    bytes_to_text,
    named_values,
    table_key,
)

__all__ = [
    "body_bytes",
    "bytes_to_text",
    "canonical_body",
    "gtid_text",
    "key_partition",
    "murmur2",
    "named_values",
    "resume_gtid_set",
    "set_ranges",
    "spread_partition",
    "table_key",
    "trim_space",
]
