"""From change events to row messages, values and control messages."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import gtid_text, named_values, table_key
from changeflow.schemas import ROW_ACTIONS


def single_images(images):
    """Insert and delete events: every image is a new row.

    The old row is a null of the image's own type, be its values text or VARIANT.
    """
    return F.transform(
        images,
        lambda image: F.struct(
            F.when(F.lit(False), image).alias("old_row"), image.alias("new_row")
        ),
    )


def paired_images(images):
    """Update events: images ``2i`` and ``2i+1`` are old and new row.

    A last image without a partner is ignored.
    """
    n_pairs = F.floor(F.size(images) / 2).cast("int")
    indexes = F.when(n_pairs > 0, F.sequence(F.lit(0), n_pairs - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        indexes,
        lambda i: F.struct(
            F.get(images, i * 2).alias("old_row"), F.get(images, i * 2 + 1).alias("new_row")
        ),
    )


def event_rows(images="row_images"):
    """All ``(old_row, new_row)`` structs of an event, as an array."""
    col = F.col(images)
    return F.when(F.col("action") == "update", paired_images(col)).otherwise(
        single_images(col)
    )


def row_messages(changes):
    """One row per row message, numbered by ``row_index`` inside its event."""
    kept = [c for c in changes.columns if c != "row_images"]
    return (
        changes.filter(F.col("action").isin(*ROW_ACTIONS))
        .select(*kept, F.posexplode(event_rows()).alias("row_index", "_row"))
        .select(
            *kept,
            table_key().alias("key"),
            "row_index",
            F.col("_row.old_row").alias("old_row"),
            F.col("_row.new_row").alias("new_row"),
        )
    )


def with_values(resolved):
    """Add ``values`` and, for updates only, ``oldvalues`` as name-value maps."""
    return resolved.withColumn(
        "values", named_values(F.col("columns"), F.col("new_row"))
    ).withColumn(
        "oldvalues",
        F.when(
            F.col("action") == "update", named_values(F.col("columns"), F.col("old_row"))
        ),
    )


def explode_values(valued, which="values"):
    """One row per column value of the chosen map."""
    return valued.select(
        "seq", "row_index", F.explode(which).alias("column_name", "value")
    )


def changed_columns(resolved):
    """The columns of an update whose value differs between old and new row.

    VARIANT values, which have no equality, are compared as their JSON text.
    """
    value_type = resolved.schema["new_row"].dataType.elementType
    text = F.to_json if isinstance(value_type, T.VariantType) else F.col
    entry = F.explode(F.arrays_zip("columns", "old_row", "new_row")).alias("_c")
    return (
        resolved.filter(F.col("action") == "update")
        .select("seq", "row_index", entry)
        .filter(~text("_c.old_row").eqNullSafe(text("_c.new_row")))
        .select(
            "seq",
            "row_index",
            F.col("_c.columns").alias("column_name"),
            F.col("_c.old_row").alias("old_value"),
            F.col("_c.new_row").alias("new_value"),
        )
    )


def _position_payload():
    return F.concat_ws(":", F.col("binlog_file"), F.col("binlog_pos").cast("string"))


def _message(kind, payload):
    return F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))


def ddl_messages(ddl_changes):
    """A DDL event as position, DDL and GTID message, in that order."""
    messages = F.array(
        _message("position", _position_payload()),
        _message("ddl", F.col("query")),
        _message("gtid", gtid_text("server_uuid", "gno")),
    )
    return ddl_changes.select(
        "seq", F.posexplode(messages).alias("ordinal", "_m")
    ).select("seq", "ordinal", "_m.kind", "_m.payload")


def queue_messages(changes):
    """Every message the events put on the queue, in order ``(seq, ordinal)``.

    A row transaction sends its GTID, its rows as one message, and the commit
    position; a DDL event sends what ``ddl_messages`` says.
    """
    gtid = _message("gtid", gtid_text("server_uuid", "gno"))
    position = _message("position", _position_payload())
    messages = F.when(
        F.col("action") == "ddl", F.array(position, _message("ddl", F.col("query")), gtid)
    ).otherwise(F.array(gtid, _message("rows", table_key()), position))
    return changes.select("seq", F.posexplode(messages).alias("ordinal", "_m")).select(
        "seq", "ordinal", "_m.kind", "_m.payload"
    )


def commit_positions(changes):
    """The position after each event; a commit always asks to be saved."""
    return changes.select(
        "seq",
        F.when(F.col("action") == "ddl", "ddl").otherwise("xid").alias("origin"),
        "binlog_file",
        "binlog_pos",
        F.lit(True).alias("force"),
    )


def rotate_positions(changes, first_pos=4):
    """A rotate at the first event of each log file, naming that file."""
    return (
        changes.groupBy("binlog_file")
        .agg(F.min("seq").alias("seq"))
        .select(
            "seq",
            F.lit("rotate").alias("origin"),
            "binlog_file",
            F.lit(first_pos).cast("bigint").alias("binlog_pos"),
            F.lit(True).alias("force"),
        )
    )


def position_events(changes):
    return commit_positions(changes).unionByName(rotate_positions(changes))


def gtid_events(changes, force=None):
    """The transaction id of each event as a progress row."""
    return changes.select(
        "seq",
        "ts_s",
        "server_uuid",
        gtid_text("server_uuid", "gno").alias("gtid_set"),
        (F.lit(False) if force is None else force).alias("force"),
    )
