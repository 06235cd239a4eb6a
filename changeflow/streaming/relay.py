"""The relay as a stream: select, shape, resolve, envelope, write, save progress."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import gtid_text, table_key
from changeflow.operators.catalog import upsert_catalog
from changeflow.operators.envelope import MESSAGE_LIMIT, audit, ddl_envelope, fits_message
from changeflow.operators.filters import allow_ddl, allow_rows
from changeflow.operators.rows import row_messages
from changeflow.operators.transaction_sets import coalesced, observed_set
from changeflow.schemas import CATALOG_SCHEMA, CHANGE_SCHEMA, CHECKPOINT_SCHEMA, ROW_LOG_SCHEMA
from changeflow.session import passing_tables
from changeflow.sinks import append_checkpoints, batch_path, landed, write_batch
from changeflow.sources.changes import MALFORMED, malformed, well_formed
from changeflow.streaming.folding import FOLD_EVERY, add_batch, folded_rows
from changeflow.streaming.runs import run_of


def start_relay(
    changes, catalog, path, checkpoint_location, schemas=(), tables=(),
    ddl_ignores_table_list=False, limit=MESSAGE_LIMIT, interval=None, publish=None,
):
    """Start the relay on a stream of changes; returns the streaming query.

    Each micro-batch writes its row messages under ``path/rows``, split by
    outcome, its DDL messages under ``path/ddl``, records that could not be read under
    ``path/malformed``, hands what is to be sent to ``publish(rows, ddl, batch_id)``, and
    last of all saves the newest transaction id and log position of each server under
    ``path/checkpoints``. Folders carry the stream's own id and the batch number, so a
    batch that is retried after a failure replaces its own files, and a relay started with
    a new checkpoint location adds to what an older one wrote; a queue behind
    ``publish`` sees a retried batch again (at least once). The transactions of each batch are saved as
    intervals under ``path/executed``, right before; ``executed_set`` reads them as one set.

    Delivered rows are stored as their body, others with their images for a replay.

    ``catalog`` is a table, or a function of the session that gives the current
    one, called for each batch.

    ``interval`` is the flush interval, such as ``"1 second"``; without one the
    stream handles all there is and stops. ``maxFilesPerTrigger`` or
    ``maxOffsetsPerTrigger`` on the source bound a batch.
    """

    def flush(batch, batch_id):
        # Read once from the source, used for rows, DDL and progress.
        batch = batch.persist()
        try:
            with passing_tables(batch.sparkSession):
                write_all(batch, batch_id)
        finally:
            batch.unpersist()

    def write_all(batch, batch_id):
        spark, run = batch.sparkSession, run_of(batch, checkpoint_location)
        current = catalog(spark) if callable(catalog) else catalog
        if MALFORMED in batch.columns:
            write_batch(malformed(batch), f"{path}/malformed", batch_id, run=run)
            batch = well_formed(batch)
        shaped = row_messages(allow_rows(batch, schemas, tables))
        messages = {"rows": stored_rows(audit(shaped, current, limit))}
        ddl = allow_ddl(batch, schemas, tables, ddl_ignores_table_list).select(
            "seq", "ts_s", "schema_name", "action", "query",
            *[
                F.col(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in CHANGE_SCHEMA
                if f.name in ("error_code", "execution_time", "status_vars")
            ],
        )
        messages["ddl"] = ddl_envelope(ddl).withColumn(
            "outcome",
            F.when(fits_message(F.col("value"), limit), "delivered").otherwise("oversize"),
        )
        for name, audited in messages.items():
            write_batch(audited, f"{path}/{name}", batch_id, ["outcome"], run=run)
        if publish is not None:
            # What was written, with a schema: a batch may have no messages of a kind.
            sent = [
                spark.read.schema(audited.schema)
                .parquet(batch_path(f"{path}/{name}", batch_id, run))
                .filter("outcome = 'delivered'")
                for name, audited in messages.items()
            ]
            publish(*sent, batch_id)
        write_batch(observed_set(batch), f"{path}/executed", batch_id, run=run)
        newest = (
            batch.groupBy("server_uuid")
            .agg(
                F.max("seq").alias("seq"),
                F.max_by("ts_s", "seq").alias("ts_s"),
                F.max_by("gno", "seq").alias("gno"),
                F.max_by("binlog_file", "seq").alias("binlog_file"),
                F.max_by("binlog_pos", "seq").alias("binlog_pos"),
            )
            .withColumn("gtid_set", gtid_text("server_uuid", "gno"))
        )
        append_checkpoints(newest, f"{path}/checkpoints", batch_id, run)

    writer = changes.writeStream.foreachBatch(flush).option(
        "checkpointLocation", checkpoint_location
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def stored_rows(audited):
    """Row messages as they are stored: the images only where a replay may need them."""
    image = {c: F.when(F.col("outcome") != "delivered", F.col(c)).alias(c) for c in ("old_row", "new_row")}
    names = [*ROW_LOG_SCHEMA.fieldNames(), "outcome"]
    return audited.select(*[image.get(c, F.col(c)) for c in names])


def row_log(spark, path, schema=ROW_LOG_SCHEMA):
    """All row messages with their outcome; no rows from a relay that saw none."""
    outcome = T.StructType([*schema.fields, T.StructField("outcome", T.StringType())])
    return landed(spark, f"{path}/rows", outcome)


def delivered_log(spark, path, schema=ROW_LOG_SCHEMA):
    """All row messages delivered so far; other outcomes are pruned by folder.

    ``typed(ROW_LOG_SCHEMA)`` reads a log of typed values.
    """
    return row_log(spark, path, schema).filter("outcome = 'delivered'")


def dead_letter_log(spark, path, schema=ROW_LOG_SCHEMA):
    """All row messages that were not delivered when they came."""
    return row_log(spark, path, schema).filter("outcome <> 'delivered'")


def ddl_log(spark, path):
    """All DDL messages with their outcome."""
    schema = "seq long, ts_s long, schema_name string, action string, query string, error_code int, execution_time long, status_vars binary, value string, outcome string"
    return landed(spark, f"{path}/ddl", schema)


def relay_progress(spark, path):
    """Where the relay stands on each server: log file, position and transaction id."""
    saved = landed(spark, f"{path}/checkpoints", CHECKPOINT_SCHEMA)
    return saved.groupBy("server_uuid").agg(
        *[F.max_by(c, "saved_seq").alias(c) for c in ("binlog_file", "binlog_pos", "gtid_set")]
    )


def executed_set(spark, path):
    """All transactions the relay has handled, in the fewest intervals, as ``skip_executed`` takes them.

    Unlike the newest id of a server it has holes where transactions came out of order or were never seen.
    """
    return coalesced(landed(spark, f"{path}/executed", "server_uuid string, gno_start long, gno_end long"))


def start_catalog(
    versions, path, checkpoint_location, schemas=(), tables=(), interval=None, fold_every=FOLD_EVERY
):
    """Keep the catalog of the allowed tables from a stream of schema versions.

    Each batch adds the newest of its versions per table; after ``fold_every`` batches they are folded into a
    snapshot with one row per table. ``current_catalog`` reads the snapshot and the batches since, so its
    cost is bounded by the number of tables. Older versions are not kept.
    """

    def add(batch, batch_id):
        add_batch(
            upsert_catalog(batch, schemas, tables), path, batch_id, run_of(batch, checkpoint_location),
            CATALOG_SCHEMA, upsert_catalog, fold_every,
        )

    writer = versions.writeStream.foreachBatch(add).option(
        "checkpointLocation", checkpoint_location
    )
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def current_catalog(spark, path):
    """The newest version of each table that ``start_catalog`` has seen."""
    return upsert_catalog(folded_rows(spark, path, CATALOG_SCHEMA))


def replay(dead_letters, catalog, limit=MESSAGE_LIMIT):
    """Dead letters once more, against a catalog that may have been mended."""
    return audit(
        dead_letters.select(
            "seq", "row_index", "ts_s", "schema_name", "table_name", table_key().alias("key"), "action",
            "old_row", "new_row",
        ),
        catalog,
        limit,
    )
