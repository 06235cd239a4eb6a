"""JSON envelopes, outcomes and queue records."""

from pyspark.sql import functions as F

from changeflow.functions import body_bytes, canonical_body, key_partition, spread_partition
from changeflow.operators.catalog import TABLE, arity_ok, prepare_catalog

#: Fixed value: largest message body in bytes that is still sent.
MESSAGE_LIMIT = 1_000_000

_JSON = {"ignoreNullFields": "false"}


def _values_by_name(row):
    values = F.transform("sorted_at", lambda i: F.get(F.col(row), i))
    return F.map_from_arrays("sorted_columns", values)


def _body(fields, exact):
    json = F.to_json(fields, _JSON)
    return canonical_body(json) if exact else json


def row_envelope(resolved, exact=False):
    """Add ``value``, the JSON body of a row message.

    ``resolved`` comes from a join with ``prepare_catalog``. ``oldvalues`` is
    always there, null unless the row is an update; columns come in name order.
    The body is null for a row that does not fit its table. With ``exact`` it has
    the escapes of the relay being rebuilt, byte for byte; else it is equal as JSON.
    """
    body = F.struct(
        F.col("action"),
        F.col("ts_s").alias("timestamp"),
        F.col("schema_name").alias("schema"),
        F.col("table_name").alias("table"),
        _values_by_name("new_row").alias("values"),
        F.when(F.col("action") == "update", _values_by_name("old_row")).alias("oldvalues"),
    )
    return resolved.withColumn("value", F.when(arity_ok(), _body(body, exact)))


def ddl_envelope(ddl_events, exact=False):
    """Add ``value``, the JSON body of a DDL message; JSON shows bytes as base64. ``exact`` as in ``row_envelope``."""
    body = F.struct(
        F.col("action").alias("Action"),
        F.col("schema_name").alias("Schema"),
        F.col("query").alias("Query"),
        F.col("error_code").alias("ErrorCode"),
        F.col("execution_time").alias("ExecutionTime"),
        F.col("status_vars").alias("StatusVars"),
    )
    return ddl_events.withColumn("value", _body(body, exact))


def fits_message(body, limit=MESSAGE_LIMIT):
    return body_bytes(body) <= limit


def outcome(limit=MESSAGE_LIMIT, count_oversize=False):
    """What happens to a row message left-joined with its catalog entry.

    A message too large to send is its own outcome. With ``count_oversize`` it
    counts as delivered, and the body need not be built at all.
    """
    chain = F.when(F.col("n_cols").isNull(), "unknown_table").when(
        ~arity_ok(), "arity_mismatch"
    )
    if not count_oversize:
        chain = chain.when(~fits_message(F.col("value"), limit), "oversize")
    return chain.otherwise("delivered")


def audit(rows, catalog, limit=MESSAGE_LIMIT, count_oversize=False, exact=False):
    """Every row message with its body and its outcome; ``count_oversize`` as in ``outcome``.

    With ``exact``, as in ``row_envelope``, the limit decides as the relay being rebuilt does.
    """
    resolved = rows.join(prepare_catalog(catalog), TABLE, "left")
    return (
        row_envelope(resolved, exact)
        .withColumn("outcome", outcome(limit, count_oversize))
        .drop("sorted_columns", "sorted_at")
    )


def delivered(audited):
    return audited.filter("outcome = 'delivered'")


def dead_letters(audited):
    """Rows that were not sent, kept for a replay once the catalog is mended."""
    return audited.filter("outcome <> 'delivered'").select(
        "outcome", "seq", "row_index", *TABLE, "action", "ts_s", "old_row", "new_row"
    )


def queue_records(messages, topic, key_mode="sequence", partitions=None, partitioner="spread"):
    """Messages as records of a Kafka topic.

    ``sequence`` keys spread over all partitions; ``table`` keys keep a table's
    messages in one partition, in order.

    With ``partitions``, their number, records also say their ``partition``: ``spread`` deals them evenly whatever
    their key, ``key`` takes the hash of the key as queue clients do. A record without a key is spread. Without
    ``partitions`` the queue's client decides. A retried batch gives the same partitions.
    """
    if key_mode == "sequence":
        key = F.col("seq").cast("string")
    elif key_mode == "table":
        key = F.concat_ws(".", *TABLE)
    else:
        raise ValueError(f"unknown key mode {key_mode!r}")
    if partitioner not in ("spread", "key"):
        raise ValueError(f"unknown partitioner {partitioner!r}")
    columns = [
        F.lit(topic).alias("topic"),
        key.alias("key"),
        F.col("value"),
        F.timestamp_seconds("ts_s").alias("timestamp"),
    ]
    if partitions is not None:
        spread = spread_partition([c for c in ("seq", "row_index") if c in messages.columns], partitions)
        place = F.coalesce(key_partition(key, partitions), spread) if partitioner == "key" else spread
        columns.append(place.alias("partition"))
    return messages.select(*columns)
