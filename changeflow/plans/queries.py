"""The registered queries: every operator on inputs derived from the tables."""

from pyspark.sql import functions as F

from changeflow import sinks
from changeflow.functions import (
    body_bytes,
    canonical_body,
    bytes_to_text,
    resume_gtid_set,
    table_key,
)
from changeflow.operators import alerts, catalog, envelope, filters, progress, reports, rows, transaction_sets
from changeflow.operators.throttle import silence_alerts, throttle_checkpoints
from changeflow.plans import inputs
from changeflow.session import scratch_path, written
from changeflow.sources import (
    bootstrap,
    catalog_scan,
    change_events,
    chunked_snapshot,
    executed_ranges,
    from_position,
    keyed_rows,
    read_checkpoint,
    read_checkpoints,
    skip_executed,
    table_after,
)

SCHEMAS, TABLES = inputs.ALLOWED_SCHEMAS, inputs.ALLOWED_TABLES
OVERSIZE_LIMIT = 10_000
DUMPED_BEFORE = 500
PURGED_SET = "srv0:1-100,\nsrv1:1-50"
TOPIC = "log"
ALERT = {
    "title": "alert",
    "hostname": "host-1",
    "address": "10.0.0.1",
    "database": "db.local:3306",
    "endpoint": "kafka , version:0.10.2.2",
}

#: Partitions of the topic that records are dealt to.
PARTITIONS = 12

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _text(columns):
    return F.concat_ws(",", columns).alias("columns")


def _allowed_rows(spark, sf_dir):
    log = filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS)
    return rows.row_messages(inputs.rows_only(log))


def _resolved(spark, sf_dir):
    return catalog.catalog_lookup(_allowed_rows(spark, sf_dir), inputs.catalog(spark))


def _audited(spark, sf_dir):
    return envelope.audit(_allowed_rows(spark, sf_dir), inputs.catalog(spark))


def _checkpoints(spark, sf_dir):
    gtids = written(inputs.gtids(spark, sf_dir), "gtids")
    return throttle_checkpoints(gtids, gap=inputs.CHECKPOINT_GAP_S)


def _health(spark, sf_dir):
    return alerts.health_alerts(
        inputs.state_changes(spark, sf_dir), inputs.HEALTH_PERIOD_S
    )


def _saved_checkpoints(spark, sf_dir):
    path = scratch_path(spark, "checkpoints")
    sinks.append_checkpoints(_checkpoints(spark, sf_dir), path)
    return spark.read.parquet(path).drop("batch_id")


# Sources


@query
def q_change_events(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).select(
        "seq", "ts_s", "server_uuid", "binlog_file", "binlog_pos",
        "schema_name", "table_name", "action", F.size("row_images").alias("n_images"),
    )
    return inputs.numbered(log)


@query
def q_seek_position(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).select("seq", "binlog_file", "binlog_pos")
    return from_position(log, "bin.000002", 40004)


@query
def q_seek_gtid(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).select("seq", "server_uuid")
    return skip_executed(inputs.numbered(log), _executed_set(spark))


def _executed_set(spark):
    return spark.range(2).select(
        F.concat(F.lit("srv"), F.col("id").cast("string")).alias("server_uuid"),
        F.lit(1).cast("bigint").alias("gno_start"),
        (1000 - 500 * F.col("id")).alias("gno_end"),
    )


def _seen(spark, sf_dir, actions):
    """The transactions of the log's changes of some kinds, as intervals."""
    log = inputs.numbered(inputs.change_log(spark, sf_dir).select("seq", "server_uuid", "action"))
    return transaction_sets.observed_set(log.filter(F.col("action").isin(actions)))


@query
def q_gtid_union(spark, sf_dir):
    """What was executed before, and all row changes of the log."""
    return transaction_sets.union_sets(_executed_set(spark), _seen(spark, sf_dir, ["insert", "update", "delete"]))


@query
def q_gtid_subtract(spark, sf_dir):
    """Updates and DDL of the log that were not executed before."""
    return transaction_sets.subtract_sets(_seen(spark, sf_dir, ["update", "ddl"]), _executed_set(spark))


@query
def q_gtid_intersect(spark, sf_dir):
    """Inserts and deletes of the log that were executed before."""
    return transaction_sets.intersect_sets(_seen(spark, sf_dir, ["insert", "delete"]), _executed_set(spark))


@query
def q_gtid_contained(spark, sf_dir):
    """Whether the log holds all that was executed before, leaving out its DDL."""
    return transaction_sets.contained(_executed_set(spark), _seen(spark, sf_dir, ["insert", "update", "delete"]))


@query
def q_gtid_set_text(spark, sf_dir):
    """Per server, the row changes of the log as a transaction-set text."""
    return transaction_sets.server_texts(_seen(spark, sf_dir, ["insert", "update", "delete"]))


@query
def q_resume_gtid_set(spark, sf_dir):
    """For each log file: resume at its last id, with all earlier files purged."""
    log = inputs.numbered(
        inputs.change_log(spark, sf_dir).select("seq", "server_uuid", "binlog_file")
    )
    last = (F.col("first_gno") - 1).cast("string")
    entry = F.when(
        F.col("first_gno") > 100,
        F.concat("server_uuid", F.lit(":1-50:60-"), last),
    ).when(F.col("first_gno") > 1, F.concat("server_uuid", F.lit(":1-"), last))
    per_file = (
        log.groupBy("binlog_file", "server_uuid")
        .agg(
            F.min("gno").alias("first_gno"),
            F.max("gno").alias("last_gno"),
            F.max("seq").alias("last_seq"),
        )
        .groupBy("binlog_file")
        .agg(
            F.max_by(
                F.concat_ws(":", "server_uuid", F.col("last_gno").cast("string")), "last_seq"
            ).alias("saved_gtid"),
            F.array_join(F.array_sort(F.collect_list(entry)), ",\n").alias("purged_set"),
        )
    )
    return per_file.withColumn(
        "resume_set", resume_gtid_set(F.col("saved_gtid"), F.col("purged_set"))
    )


@query
def q_catalog_scan(spark, sf_dir):
    scanned = catalog_scan(
        inputs.catalog_columns(spark, sf_dir), SCHEMAS, ("t0", "t1", "t3")
    )
    return scanned.select("schema_name", "table_name", _text("columns"), "n_cols")


@query
def q_snapshot_bootstrap(spark, sf_dir):
    log = inputs.rows_only(filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS))
    dumped = {
        ("shop", name): inputs.table(spark, sf_dir, name)
        for name in ("orders", "nation", "region")
    }
    started = bootstrap(
        dumped, rows.row_messages(log), databases=("shop",), tables=("orders", "nation"),
        from_seq=DUMPED_BEFORE,
    )
    shown = F.transform("new_row", lambda value: F.coalesce(value, F.lit("NULL")))
    return started.select(
        "phase", "key", "action", "seq", F.array_join(shown, "|").alias("image")
    )


@query
def q_snapshot_chunks(spark, sf_dir):
    """The tables once a dump in chunks and the changes since it began are applied.

    The dump is what each chunk's rows were while it was read, with earlier changes in it only.
    """
    keys = ["schema_name", "table_name", "id"]
    log = inputs.rows_only(filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS))
    changed = keyed_rows(rows.row_messages(log), {"id": 0}).withColumn("chunk", inputs.chunk_of("id"))
    marks = inputs.chunk_marks(changed)
    before = changed.join(marks, "chunk").filter("seq <= read_at").drop("low", "high", "read_at")
    dump = table_after(change_events(before, keys), keys)
    events = chunked_snapshot(
        dump.withColumn("chunk", inputs.chunk_of("id")), changed.filter(F.col("seq") > inputs.DUMP_BEGINS), marks, keys
    )
    return table_after(events, keys).select(
        *keys, F.col("new_row")[1].alias("kind"), F.col("new_row")[2].cast("bigint").alias("cents"),
        F.col("new_row")[3].alias("props"),
    )


@query
def q_read_checkpoint(spark, sf_dir):
    return read_checkpoint(_saved_checkpoints(spark, sf_dir))


@query
def q_resume_from_checkpoint(spark, sf_dir):
    """Saved ids, merged into the purged set, as ranges, and what is left of the log."""
    saved = read_checkpoints(_saved_checkpoints(spark, sf_dir))
    sets = saved.select(resume_gtid_set(F.col("gtid_set"), F.lit(PURGED_SET)).alias("gtid_set"))
    log = inputs.numbered(inputs.change_log(spark, sf_dir).select("seq", "server_uuid"))
    return skip_executed(log, executed_ranges(sets))


# Filters and routing


@query
def q_allow_rows(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir)
    return filters.allow_rows(log, SCHEMAS, TABLES).select(
        "seq", "schema_name", "table_name", "action"
    )


@query
def q_allow_ddl(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir)
    return filters.allow_ddl(log, SCHEMAS).select("seq", "schema_name", "query")


@query
def q_allow_ddl_relaxed(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir)
    strict = filters.allow_ddl(log, SCHEMAS, TABLES).withColumn("mode", F.lit("strict"))
    relaxed = filters.allow_ddl(
        log, SCHEMAS, TABLES, ddl_ignores_table_list=True
    ).withColumn("mode", F.lit("relaxed"))
    return strict.unionByName(relaxed).select("mode", "seq", "schema_name")


@query
def q_route_kinds(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).drop("row_images")
    messages = rows.queue_messages(inputs.numbered(log))
    branches = [filters.route(messages, kind) for kind in ("position", "gtid", "ddl", "rows")]
    routed = branches[0]
    for branch in branches[1:]:
        routed = routed.unionByName(branch)
    return routed.select("seq", "ordinal", "kind", "payload")


@query
def q_oversize(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id",
        body_bytes(F.col("text")).alias("n_bytes"),
        envelope.fits_message(F.col("text"), OVERSIZE_LIMIT).alias("fits"),
    )


@query
def q_oversize_exact(spark, sf_dir):
    """Size and digest of the bodies as they are sent, and whether they are."""
    body = canonical_body(F.to_json(F.struct("text"), {"ignoreNullFields": "false"}))
    bodies = inputs.table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return bodies.select(
        "doc_id",
        body_bytes(F.col("body")).alias("n_bytes"),
        envelope.fits_message(F.col("body"), OVERSIZE_LIMIT).alias("fits"),
        F.md5("body").alias("body_md5"),
    )


@query
def q_arity_mismatch(spark, sf_dir):
    return catalog.arity_mismatch(_resolved(spark, sf_dir)).select(
        "seq", "row_index", "key", "n_cols", F.size("new_row").alias("n_values")
    )


@query
def q_delivery_audit(spark, sf_dir):
    def cents(row):
        return F.sum(F.get(row, F.lit(2)).cast("bigint"))

    return _audited(spark, sf_dir).groupBy("outcome").agg(
        F.count("*").alias("n_rows"),
        cents("new_row").alias("new_cents"),
        cents("old_row").alias("old_cents"),
    )


@query
def q_dead_letters(spark, sf_dir):
    return envelope.dead_letters(_audited(spark, sf_dir)).select(
        "outcome", "seq", "row_index", table_key().alias("key"), "action",
        F.get("new_row", F.lit(2)).alias("new_cents"),
        F.get("old_row", F.lit(2)).alias("old_cents"),
    )


# Row shaping


def _all_rows(spark, sf_dir):
    return rows.row_messages(inputs.rows_only(inputs.change_log(spark, sf_dir)))


@query
def q_explode_rows(spark, sf_dir):
    log = inputs.rows_only(inputs.change_log(spark, sf_dir))
    exploded = rows.row_messages(log.filter(F.col("action").isin("insert", "delete")))
    return exploded.select(
        "seq", "row_index", "action",
        *[
            F.get("new_row", F.lit(i)).alias(name)
            for i, name in enumerate(inputs.BASE_COLUMNS)
        ],
    )


@query
def q_pair_updates(spark, sf_dir):
    log = inputs.rows_only(inputs.change_log(spark, sf_dir))
    paired = rows.row_messages(log.filter(F.col("action") == "update"))
    return paired.select(
        "seq", "row_index",
        F.get("old_row", F.lit(0)).alias("id"),
        F.get("old_row", F.lit(2)).alias("old_cents"),
        F.get("new_row", F.lit(2)).alias("new_cents"),
    )


@query
def q_table_key(spark, sf_dir):
    return _all_rows(spark, sf_dir).select("seq", "row_index", "key")


@query
def q_named_values(spark, sf_dir):
    return rows.explode_values(rows.with_values(_resolved(spark, sf_dir)))


@query
def q_old_values(spark, sf_dir):
    return rows.explode_values(rows.with_values(_resolved(spark, sf_dir)), "oldvalues")


@query
def q_bytes_to_text(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).select(
        "seq",
        F.encode("props", "utf-8").alias("props"),
        F.array(F.encode("event_type", "utf-8"), F.encode("table_name", "utf-8")).alias("image"),
    )
    return bytes_to_text(log).select(
        "seq", "props",
        F.get("image", F.lit(0)).alias("kind"),
        F.get("image", F.lit(1)).alias("table_name"),
    )


@query
def q_changed_columns(spark, sf_dir):
    return rows.changed_columns(
        _resolved(spark, sf_dir).filter(catalog.arity_ok())
    )


@query
def q_ddl_fanout(spark, sf_dir):
    log = inputs.numbered(inputs.change_log(spark, sf_dir).drop("row_images"))
    return rows.ddl_messages(filters.allow_ddl(log, SCHEMAS))


@query
def q_position_events(spark, sf_dir):
    return rows.position_events(inputs.change_log(spark, sf_dir))


@query
def q_gtid_events(spark, sf_dir):
    return inputs.gtids(spark, sf_dir)


# Catalog


@query
def q_catalog_lookup(spark, sf_dir):
    return _resolved(spark, sf_dir).select(
        "seq", "row_index", "key", _text("columns"), "n_cols"
    )


@query
def q_unknown_tables(spark, sf_dir):
    return catalog.unknown_tables(
        _allowed_rows(spark, sf_dir), inputs.catalog(spark)
    ).select("seq", "row_index", "key")


def version_fields(resolved):
    exploded = rows.row_messages(resolved)
    return exploded.select(
        "seq", "row_index", "key", "valid_from", "n_cols", catalog.arity_ok().alias("fits")
    )


@query
def q_schema_latest(spark, sf_dir):
    log = inputs.rows_only(filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS))
    return version_fields(catalog.resolve_latest(log, inputs.catalog_versions(spark, sf_dir)))


@query
def q_schema_as_of(spark, sf_dir):
    log = inputs.rows_only(filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS))
    return version_fields(catalog.resolve_as_of(log, inputs.catalog_versions(spark, sf_dir)))


@query
def q_catalog_upsert(spark, sf_dir):
    newest = catalog.upsert_catalog(inputs.catalog_versions(spark, sf_dir), SCHEMAS)
    return newest.select("schema_name", "table_name", _text("columns"), "n_cols", "valid_from")


# Counters and reports


@query
def q_dml_counts(spark, sf_dir):
    return reports.dml_counts(_resolved(spark, sf_dir).filter(catalog.arity_ok()))


@query
def q_table_report(spark, sf_dir):
    log = inputs.rows_only(filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS))
    current = inputs.catalog(spark)
    return reports.table_report(current, reports.delivered_counts(log, current))


@query
def q_ddl_report(spark, sf_dir):
    ddl = filters.allow_ddl(inputs.change_log(spark, sf_dir), SCHEMAS)
    return reports.ddl_report(inputs.catalog(spark), ddl)


@query
def q_component_state(spark, sf_dir):
    return reports.component_state(inputs.state_changes(spark, sf_dir))


@query
def q_metric_series(spark, sf_dir):
    samples = reports.sample_backlog(
        inputs.queue_events(spark, sf_dir), inputs.SAMPLE_INTERVAL_S, ["server_uuid"],
        keep=reports.RETAINED_SAMPLES,
    )
    return reports.newest_samples(samples, ["server_uuid"])


# Progress


@query
def q_latest_position(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir)
    return progress.latest_position(log)


@query
def q_latest_gtid(spark, sf_dir):
    return progress.latest_gtid(_checkpoints(spark, sf_dir))


@query
def q_progress_info(spark, sf_dir):
    return progress.progress_info(
        inputs.change_log(spark, sf_dir), _checkpoints(spark, sf_dir)
    )


@query
def q_backlog(spark, sf_dir):
    return progress.backlog(inputs.queue_events(spark, sf_dir)).drop("server_uuid")


@query
def q_micro_batches(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).filter("action <> 'ddl'")
    return progress.micro_batches(log, "n_rows", tick=inputs.BATCH_TICK_S)


@query
def q_micro_batches_saved(spark, sf_dir):
    log = inputs.change_log(spark, sf_dir).filter("action <> 'ddl'")
    return progress.micro_batches(
        log, "n_rows", ["server_uuid"], tick=inputs.BATCH_TICK_S,
        checkpoints=written(_checkpoints(spark, sf_dir), "saved"),
    )


@query
def q_checkpoint_throttle(spark, sf_dir):
    return _checkpoints(spark, sf_dir)


@query
def q_checkpoint_log(spark, sf_dir):
    return _saved_checkpoints(spark, sf_dir)


# Alerts


@query
def q_health_alerts(spark, sf_dir):
    return _health(spark, sf_dir)


@query
def q_alert_fanout(spark, sf_dir):
    return alerts.fan_out(_health(spark, sf_dir))


@query
def q_alert_silence(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select(
        "event_id", "event_type", inputs.epoch_seconds(F.col("ts")).alias("ts_s")
    )
    return silence_alerts(events, ["event_type"], order="event_id")


@query
def q_alert_sends(spark, sf_dir):
    sends = alerts.fan_out(_health(spark, sf_dir)).select(
        "channel", "ts_s", (F.col("ts_s") % 11 != 0).alias("send_ok")
    )
    return silence_alerts(written(sends, "sends"), order="ts_s", succeeded="send_ok")


@query
def q_alert_render(spark, sf_dir):
    return alerts.render_alerts(alerts.fan_out(_health(spark, sf_dir)), **ALERT)


# Envelopes and sinks


BODY = (
    "action string, timestamp bigint, schema string, table string, "
    "values struct<id string, kind string, cents string, props string>, "
    "oldvalues struct<cents string>"
)


def envelope_fields(messages):
    """The fields of row bodies, each parsed once."""
    parsed = messages.select("seq", "row_index", "value", F.from_json("value", BODY).alias("b"))
    return parsed.select(
        "seq", "row_index",
        "b.action", "b.timestamp", "b.schema", "b.table",
        "b.values.id", "b.values.kind",
        F.col("b.values.cents").cast("bigint").alias("cents"),
        "b.values.props",
        F.col("b.oldvalues.cents").cast("bigint").alias("old_cents"),
        F.col("value").contains('"oldvalues":null').alias("old_is_null"),
    )


@query
def q_row_envelope(spark, sf_dir):
    return envelope_fields(envelope.delivered(_audited(spark, sf_dir)))


TYPED_BODY = BODY.replace("id string", "id bigint").replace("cents string", "cents bigint")


@query
def q_row_envelope_typed(spark, sf_dir):
    """Numbers stay numbers in the body and nulls stay null."""
    log = inputs.typed_images(
        inputs.rows_only(filters.allow_rows(inputs.change_log(spark, sf_dir), SCHEMAS))
    )
    sent = envelope.delivered(envelope.audit(rows.row_messages(log), inputs.catalog(spark)))
    parsed = sent.select("seq", "row_index", "value", F.from_json("value", TYPED_BODY).alias("b"))
    return parsed.select(
        "seq", "row_index", "b.action", "b.values.id", "b.values.kind", "b.values.cents",
        "b.values.props",
        F.col("value").rlike('"id":[0-9]+,').alias("id_is_number"),
        F.col("b.oldvalues.cents").alias("old_cents"),
    )


def ddl_fields(enveloped):
    """The fields of DDL bodies."""

    def field(name):
        return F.get_json_object("value", f"$.{name}").alias(name)

    return enveloped.select(
        "seq", field("Action"), field("Schema"), field("Query"),
        field("ErrorCode"), field("ExecutionTime"), field("StatusVars"),
    )


@query
def q_ddl_envelope(spark, sf_dir):
    return ddl_fields(envelope.ddl_envelope(inputs.ddl_events(spark, sf_dir)))


@query
def q_kafka_records(spark, sf_dir):
    sent = envelope.delivered(_audited(spark, sf_dir))
    records = envelope.queue_records(sent, TOPIC)
    return records.select(
        "topic", "key",
        F.unix_seconds("timestamp").alias("sent_s"),
        F.get_json_object("value", "$.values.cents").alias("cents"),
    )


@query
def q_kafka_partitions(spark, sf_dir):
    """Messages per partition, where a record's key decides its partition."""
    sent = envelope.delivered(_audited(spark, sf_dir))
    records = envelope.queue_records(sent, TOPIC, partitions=PARTITIONS, partitioner="key")
    return records.select("key", "partition").groupBy("partition").agg(
        F.count("*").alias("n_records"),
        F.sum(F.col("key").cast("bigint")).alias("key_sum"),
    )


@query
def q_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "delivered")
    sent = envelope.delivered(_audited(spark, sf_dir)).select("seq", "row_index", "value")
    sinks.write_batch(sent, path, 0)
    return envelope_fields(spark.read.parquet(path))
