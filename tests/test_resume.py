"""Positions, transaction sets, late rows, restarts and records that cannot be read."""

import json

import pytest
from pyspark.sql import functions as F

from changeflow.operators import catalog, envelope, reports, rows
from changeflow.operators.throttle import silence_alerts, throttle_checkpoints
from changeflow.plans import inputs
from changeflow.schemas import CHANGE_SCHEMA, ROW_LOG_SCHEMA, typed
from changeflow.session import scratch_path, shared_dir
from changeflow.sinks import append_checkpoints
from changeflow.sources import (
    executed_ranges,
    from_position,
    malformed,
    number_changes,
    parsed_records,
    read_checkpoints,
    skip_executed,
    stream_changes,
    well_formed,
)
from changeflow.streaming import (
    dead_letter_log,
    delivered_log,
    kept_log,
    late_log,
    relay_progress,
    replay,
    start_relay,
    start_throttle,
)

SF_DIR = "/root/testdata/sf0.001"


# Transaction sets


def test_set_texts_become_ranges(spark):
    texts = ["a:1-5:7:9-12,\nb:3", "", None, "c", "d:x-2,e:4-", " f : 1 - 2 ", "g:5-3"]
    frame = spark.createDataFrame([(t,) for t in texts], "gtid_set string")
    found = {tuple(r) for r in executed_ranges(frame).collect()}
    assert found == {("a", 1, 5), ("a", 7, 7), ("a", 9, 12), ("b", 3, 3), ("f", 1, 2)}


def test_large_intervals_are_cut_by_block(spark):
    log = spark.createDataFrame([("a", 5), ("a", 4_999_999_999), ("a", 5_000_000_001), ("b", 5)], "server_uuid string, gno long")
    executed = spark.createDataFrame([("a", 1, 5_000_000_000)], "server_uuid string, gno_start long, gno_end long")
    left = {tuple(r) for r in skip_executed(log, executed).collect()}
    assert left == {("a", 5_000_000_001), ("b", 5)}


def test_every_server_has_its_checkpoint(spark):
    path = scratch_path(spark, "two-servers")
    saved = spark.createDataFrame([("a", 1, 1, "a:9"), ("a", 4, 2, "a:10"), ("b", 3, 2, "b:7\n")], "server_uuid string, seq long, ts_s long, gtid_set string")
    append_checkpoints(saved, path)
    found = {(r.server_uuid, r.gtid_set, r.saved_seq) for r in read_checkpoints(spark.read.parquet(path)).collect()}
    assert found == {("a", "a:10", 4), ("b", "b:7", 3)}


def test_positions_beyond_the_padding(spark):
    log = spark.createDataFrame([("bin.999999", 8), ("bin.999999", 4), ("bin.1000000", 4), ("bin.000001", 90)], "binlog_file string, binlog_pos long")
    kept = {tuple(r) for r in from_position(log, "bin.999999", 5).collect()}
    assert kept == {("bin.999999", 8), ("bin.1000000", 4)}


def test_numbers_are_dense_and_in_log_order(spark):
    places = [(f"bin.{f:06d}", 4 + 37 * p) for f in (1, 2, 999999, 1000000) for p in range(50)]
    shuffled = spark.createDataFrame(sorted(places, key=lambda x: hash(x)), "binlog_file string, binlog_pos long")
    found = {(r.binlog_file, r.binlog_pos): r.seq for r in number_changes(shuffled, width=256).collect()}
    order = sorted(places, key=lambda x: (len(x[0]), x))
    assert found == {place: i for i, place in enumerate(order)}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


# Images and records


def test_missing_images_are_not_delivered(spark):
    fields = ["seq", "ts_s", "schema_name", "table_name", "action", "row_images"]
    made = [
        (1, 1, "db0", "t0", "insert", [["1", "2", "3", "4"], None]),
        (2, 1, "db0", "t0", "update", [None, ["1", "2", "3", "4"]]),
        (3, 1, "db0", "t0", "update", [["1", "2", "3", "4"], None]),
        (4, 1, "db0", "t0", "update", [["1", "2", "3", "4"], ["1", "2", "3", "5"]]),
    ]
    log = spark.createDataFrame(made, "seq long, ts_s long, schema_name string, table_name string, action string, row_images array<array<string>>")
    assert log.columns == fields
    current = inputs.catalog(spark)
    audited = envelope.audit(rows.row_messages(log), current)
    outcomes = sorted((r.seq, r.row_index, r.outcome, r.value is None) for r in audited.collect())
    assert outcomes == [
        (1, 0, "delivered", False), (1, 1, "arity_mismatch", True), (2, 0, "arity_mismatch", True),
        (3, 0, "arity_mismatch", True), (4, 0, "delivered", False),
    ]
    resolved = catalog.catalog_lookup(rows.row_messages(log), current)
    assert catalog.arity_mismatch(resolved).count() == 3
    counts = reports.delivered_counts(log, current).first()
    assert (counts.insert_count, counts.update_count, counts.delete_count) == (1, 1, 0)
    again = replay(envelope.dead_letters(audited), current)
    assert {r.outcome for r in again.collect()} == {"arity_mismatch"}


def test_oversize_can_count_as_delivered(spark):
    log = inputs.change_log(spark, SF_DIR)
    shaped = rows.row_messages(inputs.rows_only(log))
    counted = envelope.audit(shaped, inputs.catalog(spark), limit=10, count_oversize=True)
    assert counted.filter("outcome = 'oversize'").isEmpty()
    strict = envelope.audit(shaped, inputs.catalog(spark), limit=10)
    assert strict.filter("outcome = 'oversize'").count() == counted.filter("outcome = 'delivered'").count() > 0


def test_records_that_cannot_be_read_are_set_aside(spark):
    good = {"seq": 1, "action": "ddl", "query": "x", "error_code": 3, "execution_time": 9}
    texts = [json.dumps(good), "{broken", "", "[]", json.dumps({"seq": "no number"}), None]
    records = spark.createDataFrame([(t,) for t in texts], "value string")
    parsed = parsed_records(records)
    fine = well_formed(parsed).collect()
    assert [(r.seq, r.error_code, r.execution_time) for r in fine] == [(1, 3, 9)]
    assert malformed(parsed).count() == 5
    assert well_formed(parsed).columns == CHANGE_SCHEMA.fieldNames()


# Streams


def relay(spark, log, path, name, **more):
    log.coalesce(1).write.parquet(f"{path}/{name}")
    start_relay(
        stream_changes(spark, f"{path}/{name}", schema=log.schema), inputs.catalog(spark), path,
        f"{path}/progress-{name}", **more,
    ).awaitTermination()


def test_a_new_checkpoint_location_keeps_what_was_written(spark):
    path = scratch_path(spark, "two-runs")
    log = inputs.change_log(spark, SF_DIR).withColumn("gno", F.col("seq"))
    relay(spark, log.filter("seq < 300"), path, "one")
    before = delivered_log(spark, path).count()
    relay(spark, log.filter("seq >= 300"), path, "two")
    whole = envelope.delivered(envelope.audit(rows.row_messages(log), inputs.catalog(spark)))
    after = delivered_log(spark, path)
    assert after.count() == whole.count() > before > 0
    assert after.filter("new_row IS NOT NULL OR old_row IS NOT NULL").isEmpty()
    last = log.filter("server_uuid = 'srv0'").agg(F.max(F.struct("seq", "binlog_file", "binlog_pos"))).first()[0]
    stands = {r.server_uuid: r for r in relay_progress(spark, path).collect()}["srv0"]
    assert (stands.binlog_file, stands.binlog_pos) == (last.binlog_file, last.binlog_pos)


def test_a_relay_without_rows_reads_back_empty(spark):
    path = scratch_path(spark, "ddl-only")
    log = inputs.change_log(spark, SF_DIR).withColumn("gno", F.col("seq"))
    relay(spark, log.filter("action = 'ddl'"), path, "log")
    assert delivered_log(spark, path).count() == dead_letter_log(spark, path).count() == 0


def test_relay_sets_malformed_records_aside(spark):
    path = scratch_path(spark, "malformed")
    log = inputs.change_log(spark, SF_DIR).withColumn("gno", F.col("seq")).select(*CHANGE_SCHEMA.fieldNames())
    texts = log.limit(50).select(F.to_json(F.struct("*")).alias("value"))
    texts.unionByName(spark.createDataFrame([("{oops",), ("null",)], "value string")).coalesce(1).write.parquet(f"{path}/in")
    stream = parsed_records(stream_changes(spark, f"{path}/in", schema=texts.schema))
    start_relay(stream, inputs.catalog(spark), path, f"{path}/progress").awaitTermination()
    assert sorted(r.malformed for r in spark.read.parquet(f"{path}/malformed").collect()) == ["null", "{oops"]
    expected = envelope.delivered(envelope.audit(rows.row_messages(log.filter("seq < 50")), inputs.catalog(spark)))
    assert delivered_log(spark, path).count() <= expected.count() + 50


def test_relay_of_typed_values(spark):
    path = scratch_path(spark, "typed")
    log = inputs.typed_images(inputs.change_log(spark, SF_DIR).withColumn("gno", F.col("seq"))).filter("seq < 100")
    relay(spark, log, path, "log")
    bodies = [json.loads(r.value) for r in delivered_log(spark, path, typed(ROW_LOG_SCHEMA)).collect()]
    assert bodies and all(isinstance(b["values"]["cents"], int) for b in bodies)
    dead = dead_letter_log(spark, path, typed(ROW_LOG_SCHEMA))
    assert dict(dead.dtypes)["new_row"] == "array<variant>" and dead.count() > 0


def throttled(spark, parts, path, **limit):
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = stream_changes(spark, f"{path}/in", schema=part.schema, max_files=1)
        start_throttle(stream, f"{path}/out", f"{path}/progress", **limit).awaitTermination()
    schema = parts[0].schema
    return kept_log(spark, f"{path}/out", schema), late_log(spark, f"{path}/out", schema)


def test_late_rows_are_kept_apart_and_decide_nothing(spark):
    """Three batches, the third with the first row of a new key a few seconds back."""
    make = lambda made: spark.createDataFrame(made, "k string, ts_s long, seq long, ok boolean, force boolean")
    parts = [
        make([("a", 100, 1, True, False), ("a", 105, 2, True, False)]),
        make([("a", 120, 3, False, False), ("a", 121, 4, True, False)]),
        make([("b", 118, 5, True, True), ("a", 140, 6, True, False), ("a", 121, 7, True, True)]),
    ]
    path = scratch_path(spark, "late")
    limit = {"keys": ["k"], "time": "ts_s", "order": "seq", "gap": 10, "strict": False}
    kept, late = throttled(spark, parts, path, delay=0, **limit)
    assert sorted(r.seq for r in late.collect()) == [5, 7]
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 6]
    waits, late = throttled(spark, parts, scratch_path(spark, "waits"), delay=5, **limit)
    assert late.count() == 0
    assert sorted(r.seq for r in waits.collect()) == [1, 3, 5]
    sends, _ = throttled(spark, parts, scratch_path(spark, "sends"), delay=0, succeeded="ok", **limit)
    assert sorted(r.seq for r in sends.collect()) == [1, 3, 4, 6]
    forced, _ = throttled(spark, parts, scratch_path(spark, "forced"), delay=5, force="force", **limit)
    assert sorted(r.seq for r in forced.collect()) == [1, 3, 5, 7]


@pytest.mark.parametrize("kind", ["checkpoints", "alerts"])
def test_batches_agree_with_the_whole(spark, kind):
    log = inputs.change_log(spark, SF_DIR).withColumn("gno", F.col("seq"))
    if kind == "checkpoints":
        events = rows.gtid_events(log, F.col("seq") % 90 == 0)
        limit = {"keys": ["server_uuid"], "order": "seq", "gap": 3600, "strict": True, "start": "first", "force": "force"}
        expected = throttle_checkpoints(events, gap=3600)
    else:
        events = log.select("seq", "ts_s", F.col("action").alias("channel"), (F.col("ts_s") % 3 != 0).alias("ok"))
        limit = {"keys": ["channel"], "order": "seq", "gap": 1800, "strict": False, "succeeded": "ok"}
        expected = silence_alerts(events, order="seq", succeeded="ok")
    bounds = [(0, 200), (200, 201), (201, 650), (650, 10_000)]
    parts = [events.filter((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in bounds]
    kept, late = throttled(spark, parts, scratch_path(spark, kind), time="ts_s", delay=0, **limit)
    late_seqs = {r.seq for r in late.collect()}
    same_second = events.groupBy("ts_s").count().filter("count > 1").count()
    assert len(late_seqs) <= same_second
    got = {r.seq for r in kept.collect()}
    assert got ^ {r.seq for r in expected.collect()} <= late_seqs
    assert len(got) > 50


def test_schema_history_is_joined_where_the_log_lies(spark):
    """A short history is broadcast: no exchange carries the rows' images."""
    log = inputs.rows_only(inputs.change_log(spark, SF_DIR))
    resolved = catalog.resolve_as_of(log, inputs.catalog_versions(spark, SF_DIR))
    resolved.count()
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    versions = inputs.catalog_versions(spark, SF_DIR).collect()
    found = {(r.seq): r.valid_from for r in resolved.collect()}
    for r in log.limit(200).collect():
        earlier = [
            v.valid_from for v in versions
            if (v.schema_name, v.table_name) == (r.schema_name, r.table_name) and v.valid_from <= r.seq
        ]
        assert found[r.seq] == max(earlier, default=None)
    narrow = catalog.resolve_as_of(log, inputs.catalog_versions(spark, SF_DIR), width=64)
    assert {(r.seq): r.valid_from for r in narrow.collect()} == found
