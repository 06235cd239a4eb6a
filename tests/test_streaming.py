"""Batch and stream agree, also after a restart."""

import pytest
from pyspark.sql import functions as F

from changeflow.operators import rows
from changeflow.operators.envelope import audit, queue_records
from changeflow.operators.filters import allow_rows
from changeflow.operators.throttle import throttle_checkpoints
from changeflow.plans import inputs
from changeflow.schemas import CATALOG_SCHEMA, CHANGE_SCHEMA
from changeflow.session import scratch_path
from changeflow.sources import read_changes, read_checkpoint, stream_changes
from changeflow.streaming import (
    current_catalog,
    dead_letter_log,
    delivered_log,
    replay,
    start_catalog,
    start_relay,
    throttle_stream,
)

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture()
def log(spark):
    return inputs.change_log(spark, SF_DIR).withColumn("gno", F.col("seq"))


def land(df, path, low, high):
    part = df.filter((F.col("seq") >= low) & (F.col("seq") < high))
    part.coalesce(1).write.mode("append").parquet(path)


def test_relay_restarts_where_it_stopped(spark, log):
    path = scratch_path(spark, "relay-test")
    sent = []

    def publish(row_messages, ddl_messages, batch_id):
        sent.append((batch_id, row_messages.count(), ddl_messages.count()))

    def run():
        stream = stream_changes(spark, f"{path}/log", schema=log.schema, max_files=1)
        start_relay(
            stream, inputs.catalog(spark), path, f"{path}/progress",
            inputs.ALLOWED_SCHEMAS, limit=150, publish=publish,
        ).awaitTermination()

    land(log, f"{path}/log", 0, 300)
    land(log, f"{path}/log", 300, 600)
    run()
    assert read_checkpoint(spark.read.parquet(f"{path}/checkpoints")).first().saved_seq == 599
    land(log, f"{path}/log", 600, 10_000)
    run()

    batch = audit(
        rows.row_messages(allow_rows(log, inputs.ALLOWED_SCHEMAS)), inputs.catalog(spark), 150
    )
    columns = ["seq", "row_index", "value", "outcome"]
    stored = spark.read.parquet(f"{path}/rows").select(columns)
    assert stored.exceptAll(batch.select(columns)).isEmpty()
    assert batch.select(columns).exceptAll(stored).isEmpty()
    n_delivered = delivered_log(spark, path).count()
    assert n_delivered + dead_letter_log(spark, path).count() == batch.count()
    assert {r.outcome for r in dead_letter_log(spark, path).select("outcome").distinct().collect()} == {
        "unknown_table", "arity_mismatch", "oversize"
    }
    assert [b for b, _, _ in sent] == [0, 1, 2]
    assert sum(n for _, n, _ in sent) == n_delivered
    ddl = log.filter("action = 'ddl' AND schema_name IN ('db0', 'db1')").count()
    assert sum(n for _, _, n in sent) == ddl
    assert read_checkpoint(spark.read.parquet(f"{path}/checkpoints")).first().saved_seq == 999


def test_batch_without_ddl_and_oversize_ddl(spark, log):
    path = scratch_path(spark, "ddl-test")
    sent = []

    def publish(row_messages, ddl_messages, batch_id):
        records = queue_records(ddl_messages, "log")
        sent.append((row_messages.count(), records.count()))

    land(log.filter("action <> 'ddl'"), f"{path}/log", 0, 50)
    land(log.filter("action = 'ddl'"), f"{path}/log", 50, 100)
    stream = stream_changes(spark, f"{path}/log", schema=log.schema, max_files=1)
    n_ddl = log.filter("action = 'ddl' AND seq BETWEEN 50 AND 99").count()
    for limit, expected in ((1000, n_ddl), (60, 0)):
        sent.clear()
        start_relay(
            stream, inputs.catalog(spark), f"{path}/{limit}", f"{path}/progress{limit}",
            limit=limit, publish=publish,
        ).awaitTermination()
        assert [n for _, n in sent] == [0, expected]
        assert sent[1][0] == 0
        stored = spark.read.parquet(f"{path}/{limit}/ddl")
        assert stored.count() == n_ddl


def test_json_log_streams_like_parquet(spark, log):
    path = scratch_path(spark, "json-test")
    landed = log.select(*CHANGE_SCHEMA.fieldNames())
    landed.write.json(f"{path}/log")
    assert read_changes(spark, f"{path}/log", "json").exceptAll(landed).isEmpty()
    start_relay(
        stream_changes(spark, f"{path}/log", "json"), inputs.catalog(spark), path,
        f"{path}/progress",
    ).awaitTermination()
    batch = audit(rows.row_messages(landed), inputs.catalog(spark)).filter("outcome = 'delivered'")
    assert delivered_log(spark, path).count() == batch.count() > 0


def test_mended_catalog_reaches_the_relay_and_the_dead_letters(spark, log):
    path = scratch_path(spark, "catalog-test")
    versions = inputs.catalog(spark).select(*CATALOG_SCHEMA.fieldNames())

    def run():
        for name, table in (("catalog", CATALOG_SCHEMA), ("log", log.schema)):
            stream = stream_changes(spark, f"{path}/in/{name}", schema=table)
            if name == "catalog":
                query = start_catalog(
                    stream, f"{path}/{name}", f"{path}/progress-{name}", tables=["t0", "t3"]
                )
            else:
                query = start_relay(
                    stream, lambda s: current_catalog(s, f"{path}/catalog"), path,
                    f"{path}/progress-{name}", ["db0"], ["t0", "t3"],
                )
            query.awaitTermination()

    def outcomes(audited):
        return {
            (r.table_name, r.outcome): r["count"]
            for r in audited.groupBy("table_name", "outcome").count().collect()
        }

    versions.write.parquet(f"{path}/in/catalog")
    land(log, f"{path}/in/log", 0, 500)
    run()
    before = outcomes(spark.read.parquet(f"{path}/rows"))
    assert set(before) == {("t0", "delivered"), ("t3", "arity_mismatch")}

    mended = versions.filter("table_name = 't3'").withColumns(
        {
            "columns": F.slice("columns", 1, 4),
            "n_cols": F.lit(4),
            "valid_from": F.lit(500).cast("long"),
        }
    )
    mended.write.mode("append").parquet(f"{path}/in/catalog")
    land(log, f"{path}/in/log", 500, 1000)
    run()
    assert current_catalog(spark, f"{path}/catalog").count() == 6
    after = outcomes(spark.read.parquet(f"{path}/rows"))
    assert after[("t3", "arity_mismatch")] == before[("t3", "arity_mismatch")]
    assert after[("t3", "delivered")] > 0
    replayed = replay(dead_letter_log(spark, path), current_catalog(spark, f"{path}/catalog"))
    assert outcomes(replayed) == {("t3", "delivered"): before[("t3", "arity_mismatch")]}


def test_throttle_restarts_with_its_state(spark, log):
    path = scratch_path(spark, "throttle-test")
    gtids = rows.gtid_events(log, F.col("seq") % 90 == 0)

    def run():
        stream = stream_changes(spark, f"{path}/log", schema=gtids.schema, max_files=1)
        kept = throttle_stream(
            gtids_in(stream), ["server_uuid"], "ts_s", "seq", 3600, strict=True,
            start="first", force="force", delay="1 day",
        )
        (
            kept.writeStream.format("parquet")
            .option("path", f"{path}/kept")
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    def gtids_in(stream):
        return stream.select(*gtids.columns)

    # Even and odd events land in turn, so every second file brings older rows.
    for low in (0, 20, 40):
        for odd in (0, 1):
            land(gtids.filter(F.col("seq") % 2 == odd), f"{path}/log", low, low + 20)
    run()
    land(gtids, f"{path}/log", 60, 10_000)
    run()

    until = gtids.agg(F.max("ts_s")).first()[0] - 86_400
    expected = throttle_checkpoints(gtids, gap=3600)
    got = spark.read.parquet(f"{path}/kept").select(*expected.columns)
    decided = f"ts_s <= {until} OR force"
    assert got.exceptAll(expected.filter(decided)).isEmpty()
    assert expected.filter(decided).exceptAll(got).isEmpty()
    assert got.count() > 100
