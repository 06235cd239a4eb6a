"""The registered queries on a stream: the events table read as a change stream."""

from pyspark.sql import functions as F

from changeflow.operators import catalog, envelope, filters, reports, rows
from changeflow.operators.alerts import fan_out, health_alerts
from changeflow.operators.throttle import SILENCE_GAP
from changeflow.plans import inputs
from changeflow.plans.queries import SCHEMAS, ddl_fields, envelope_fields, query, version_fields
from changeflow.session import scratch_path
from changeflow.sinks import committed_log, start_committed, write_change_log
from changeflow.sources import stream_changes, stream_from_position
from changeflow.streaming import (
    backlog_log,
    current_catalog,
    ddl_log,
    delivered_log,
    executed_set,
    health_log,
    kept_log,
    relay_progress,
    resolved_log,
    series_log,
    start_backlog,
    start_catalog,
    start_health,
    start_relay,
    start_schema_as_of,
    start_series,
    start_throttle,
)


def _events(spark, sf_dir):
    schema = inputs.table(spark, sf_dir, "events").schema
    return stream_changes(spark, sf_dir, schema=schema, glob="events.parquet")


def _changes(spark, sf_dir):
    """The change stream. A stream cannot number transactions per server, so the
    event's own number stands for its transaction."""
    return inputs.changes_of(_events(spark, sf_dir)).withColumn("gno", F.col("seq"))


def _throttled(stream, name, **limit):
    """Run a rate limit over the stream to its end and read what it kept."""
    path = scratch_path(stream.sparkSession, name)
    start_throttle(stream, path, f"{path}/progress", **limit).awaitTermination()
    return kept_log(stream.sparkSession, path, stream.schema)


def _relayed(spark, sf_dir):
    path = scratch_path(spark, "relay")
    start_relay(
        _changes(spark, sf_dir), inputs.catalog(spark), path, f"{path}/progress", SCHEMAS
    ).awaitTermination()
    return path


@query
def q_stream_relay(spark, sf_dir):
    return envelope_fields(delivered_log(spark, _relayed(spark, sf_dir)))


@query
def q_stream_ddl(spark, sf_dir):
    """The relay's DDL messages, with the fields their events carry."""
    return ddl_fields(ddl_log(spark, _relayed(spark, sf_dir)))


@query
def q_stream_progress(spark, sf_dir):
    """Position and transaction id as the relay itself has saved them."""
    return relay_progress(spark, _relayed(spark, sf_dir))


@query
def q_stream_dml_counts(spark, sf_dir):
    log = inputs.rows_only(filters.allow_rows(_changes(spark, sf_dir), SCHEMAS))
    fitting = catalog.catalog_lookup(rows.row_messages(log), inputs.catalog(spark)).filter(
        catalog.arity_ok()
    )
    path = scratch_path(spark, "counts")

    def replace(counts, _):
        counts.write.mode("overwrite").parquet(f"{path}/current")

    (
        reports.dml_counts(fitting)
        .writeStream.outputMode("complete")
        .foreachBatch(replace)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{path}/current")


@query
def q_stream_checkpoints(spark, sf_dir):
    gtids = rows.gtid_events(_changes(spark, sf_dir), F.col("seq") % 500 == 0)
    return _throttled(
        gtids, "stream-checkpoints", keys=["server_uuid"], time="ts_s", order="seq",
        gap=inputs.CHECKPOINT_GAP_S, strict=True, delay=0, start="first", force="force",
    )


@query
def q_stream_silence(spark, sf_dir):
    alerts = _events(spark, sf_dir).select(
        "event_id", "event_type", inputs.epoch_seconds(F.col("ts")).alias("ts_s")
    )
    return _throttled(
        alerts, "stream-silence", keys=["event_type"], time="ts_s", order="event_id",
        gap=SILENCE_GAP, strict=False, delay=0,
    )


@query
def q_stream_sends(spark, sf_dir):
    """Alerts sent from a stream of alerts; failed ones start no silence."""
    path = scratch_path(spark, "alerts")
    sends = fan_out(health_alerts(inputs.state_changes(spark, sf_dir), inputs.HEALTH_PERIOD_S)).select(
        "channel", "ts_s", (F.col("ts_s") % 11 != 0).alias("send_ok")
    )
    sends.write.parquet(path)
    stream = stream_changes(spark, path, schema=sends.schema)
    return _throttled(
        stream.withColumn("order", F.col("ts_s")), "stream-sends", keys=["channel"], time="ts_s",
        order="order", gap=SILENCE_GAP, strict=False, delay=0, succeeded="send_ok",
    ).drop("order")


@query
def q_stream_executed(spark, sf_dir):
    """The set of transactions that the relay itself has saved."""
    return executed_set(spark, _relayed(spark, sf_dir))


@query
def q_stream_schema_as_of(spark, sf_dir):
    """Changes resolved on a stream as of their own place, against versions that come as a stream too."""
    changes, path = _changes(spark, sf_dir), scratch_path(spark, "schema-stream")
    log = filters.allow_rows(changes, SCHEMAS).select(*inputs.rows_only(changes).columns)
    start_schema_as_of(
        log, inputs.versions_of(changes), path, f"{path}/progress", "ts_s",
        delay=0, base=inputs.catalog(spark), follow="changes",
    ).awaitTermination()
    return version_fields(resolved_log(spark, path, log.schema))


@query
def q_stream_health(spark, sf_dir):
    """Health checks on a stream of states, by timers."""
    states, path = inputs.states_of(_changes(spark, sf_dir)), scratch_path(spark, "health")
    start_health(states, path, f"{path}/progress", inputs.HEALTH_PERIOD_S, "0 seconds").awaitTermination()
    return health_log(spark, path)


@query
def q_stream_backlog(spark, sf_dir):
    """Queue depth per server and second on a stream of what enters and leaves."""
    queue, path = inputs.queue_of(_changes(spark, sf_dir)), scratch_path(spark, "backlog")
    start_backlog(queue, path, f"{path}/progress", ["server_uuid"]).awaitTermination()
    return backlog_log(spark, path, queue.schema, ["server_uuid"])


@query
def q_stream_catalog(spark, sf_dir):
    """The catalog as a stream of schema versions has left it."""
    versions, path = inputs.versions_of(_changes(spark, sf_dir)), scratch_path(spark, "catalog")
    start_catalog(versions, path, f"{path}/progress", SCHEMAS).awaitTermination()
    newest = current_catalog(spark, path)
    return newest.select(
        "schema_name", "table_name", F.concat_ws(",", "columns").alias("columns"), "n_cols", "valid_from"
    )


@query
def q_stream_committed(spark, sf_dir):
    """Delivered rows through the sink that commits each batch whole, read back."""
    log = inputs.rows_only(filters.allow_rows(_changes(spark, sf_dir), SCHEMAS))
    sent = envelope.delivered(envelope.audit(rows.row_messages(log), inputs.catalog(spark)))
    records, path = sent.select("seq", "row_index", "value"), scratch_path(spark, "committed")
    start_committed(records, path, f"{path}/progress").awaitTermination()
    return envelope_fields(committed_log(spark, path, records.schema))


@query
def q_stream_seek_position(spark, sf_dir):
    """The landed log as a stream from a position on; whole log files before it are not opened."""
    log = inputs.change_log(spark, sf_dir).select("seq", "binlog_file", "binlog_pos")
    path = scratch_path(spark, "positions")
    write_change_log(log, f"{path}/log")
    stream = stream_from_position(spark, f"{path}/log", "bin.000002", 40004, log.schema)
    start_committed(stream, f"{path}/read", f"{path}/progress").awaitTermination()
    return committed_log(spark, f"{path}/read", log.schema)


@query
def q_stream_metric_series(spark, sf_dir):
    """The newest samples of each server's queue depth, kept from a stream of all its samples."""
    path = scratch_path(spark, "series")
    samples = reports.sample_backlog(inputs.queue_events(spark, sf_dir), inputs.SAMPLE_INTERVAL_S, ["server_uuid"])
    samples.write.parquet(f"{path}/samples")
    stream = stream_changes(spark, f"{path}/samples", schema=samples.schema, max_files=4)
    start_series(stream, f"{path}/kept", f"{path}/progress", ["server_uuid"]).awaitTermination()
    return series_log(spark, f"{path}/kept", samples.schema, ["server_uuid"])
