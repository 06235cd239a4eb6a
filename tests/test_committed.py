"""The sink with a commit of its own: lost tasks, repeated batches, restarts, shared paths."""

import os

import pyarrow as pa
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from changeflow.session import scratch_path
from changeflow.sinks import committed_batches, committed_log, remove_unlisted, start_committed
from changeflow.sinks.committed import CommittedWriter, file_system

ROWS = "seq long, value string"


def land(spark, rows, path):
    spark.createDataFrame(rows, ROWS).repartition(4).write.mode("append").parquet(path)


class Sink:
    def __init__(self, spark):
        self.spark, self.path = spark, scratch_path(spark, "sink")

    def run(self, rows=(), progress="progress", change=lambda stream: stream):
        if rows:
            land(self.spark, rows, f"{self.path}-in")
        stream = change(self.spark.readStream.schema(ROWS).parquet(f"{self.path}-in"))
        start_committed(stream, self.path, f"{self.path}-{progress}").awaitTermination()

    def seqs(self):
        return sorted(r.seq for r in committed_log(self.spark, self.path, rows_schema(self.spark)).collect())

    def files(self):
        return [n for n in os.listdir(f"{self.path}/data") if n.endswith(".parquet")]


def rows_schema(spark):
    return spark.createDataFrame([], ROWS).schema


def numbered(low, high):
    return [(i, f"v{i}") for i in range(low, high)]


def test_batches_across_restarts(spark):
    sink = Sink(spark)
    assert sink.seqs() == []
    sink.run(numbered(0, 100))
    sink.run(numbered(100, 130))
    sink.run()
    assert sink.seqs() == list(range(130))
    listed = committed_batches(spark, sink.path).agg(F.sum("n_rows"), F.max("batch_id")).first()
    assert tuple(listed) == (130, 1)


def test_a_task_killed_in_mid_batch_leaves_no_row_twice(spark):
    sink = Sink(spark)

    def fail(stream):
        # The task of one row fails; others of its batch have written by then or will be stopped.
        broken = F.when(F.col("seq") == 57, F.raise_error(F.lit("lost"))).otherwise(F.col("value"))
        return stream.withColumn("value", broken.cast("string"))

    with pytest.raises(StreamingQueryException):
        sink.run(numbered(0, 100), change=fail)
    assert sink.seqs() == []
    sink.run()
    assert sink.seqs() == list(range(100))


def test_a_second_attempt_is_not_seen_and_can_be_removed(spark):
    sink = Sink(spark)
    sink.run(numbered(0, 10))
    writer = CommittedWriter(sink.path, f"{sink.path}-progress")
    batch = pa.RecordBatch.from_pydict({"seq": [10, 11], "value": ["a", "b"]})
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), writer.write(iter([]))], 1)
    assert sink.seqs() == list(range(12))
    before = len(sink.files())
    assert remove_unlisted(spark, sink.path, 3600) == 0
    assert remove_unlisted(spark, sink.path, -1) == 1
    assert len(sink.files()) == before - 1 and sink.seqs() == list(range(12))


def test_a_batch_repeated_after_its_commit_is_dropped(spark):
    """The driver is lost between the sink's commit and Spark's own note of it."""
    sink = Sink(spark)
    sink.run(numbered(0, 40))
    before = sorted(sink.files())
    commits = f"{sink.path}-progress/commits"
    for name in os.listdir(commits):
        os.remove(f"{commits}/{name}")
    sink.run()
    assert sink.seqs() == list(range(40)) and sorted(sink.files()) == before


def test_abort_removes_files_and_bears_tasks_without_a_message(spark):
    sink = Sink(spark)
    sink.run(numbered(0, 5))
    before = sorted(sink.files())
    writer = CommittedWriter(sink.path, f"{sink.path}-progress")
    message = writer.write(iter([pa.RecordBatch.from_pydict({"seq": [9], "value": [None]})]))
    writer.abort([message, None], 1)
    writer.abort([message, None], 1)
    assert sorted(sink.files()) == before


def test_two_streams_share_a_path(spark):
    sink = Sink(spark)
    sink.run(numbered(0, 20))
    sink.run(progress="other")
    assert sink.seqs() == sorted([*range(20), *range(20)])


def test_filters_and_columns_reach_the_scan(spark):
    sink = Sink(spark)
    sink.run(numbered(0, 20))
    log = committed_log(spark, sink.path, rows_schema(spark)).filter("seq > 15").select("seq")
    plan = log._jdf.queryExecution().toString()
    assert "GreaterThan(seq,15)" in plan and "ReadSchema: struct<seq:bigint>" in plan
    assert log.count() == 4


def test_paths_and_uris_name_the_same_file(tmp_path):
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert file_system(path)[1] == str(tmp_path)
