"""Queue depth and catalog kept by streams: late rows, closed blocks, folded batches, retries, restarts."""

import os
import random
from collections import defaultdict

import pytest

from changeflow.operators.catalog import upsert_catalog
from changeflow.operators.progress import backlog_by_second
from changeflow.schemas import CATALOG_SCHEMA
from changeflow.session import scratch_path, shared_dir
from changeflow.streaming import backlog_log, current_catalog, late_deltas, start_backlog, start_catalog
from changeflow.streaming.folding import add_batch, folded_rows, manifest

QUEUE = "server string, ts_s long, seq long, delta int"


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


class Queue:
    def __init__(self, spark, keys=("server",), **options):
        self.spark, self.path, self.keys, self.options = spark, scratch_path(spark, "queue"), list(keys), options

    def run(self, *rows):
        land(self.spark, list(rows), QUEUE, f"{self.path}/in")
        stream = self.spark.readStream.schema(QUEUE).parquet(f"{self.path}/in")
        self.schema = stream.schema
        start_backlog(stream, self.path, f"{self.path}/progress", self.keys, **self.options).awaitTermination()

    def depths(self):
        return {tuple(r) for r in backlog_log(self.spark, self.path, self.schema, self.keys).collect()}

    def late(self):
        return sorted((tuple(r) for r in late_deltas(self.spark, self.path, self.schema, self.keys).collect()), key=repr)

    def written(self, name, batch):
        (run,) = [f for f in os.listdir(f"{self.path}/{name}") if f.startswith("run=")]
        return self.spark.read.parquet(f"{self.path}/{name}/{run}/batch_id={batch}").count()


def row(ts, delta=1, server="a"):
    return (server, ts, 0, delta)


def test_an_older_second_corrects_the_depths_after_it(spark):
    queue = Queue(spark, delay=1000, span=10)
    queue.run(row(5), row(7), row(12), row(13), row(31), row(12, server="b"))
    assert queue.depths() == {("a", 5, 1), ("a", 7, 2), ("a", 12, 3), ("a", 13, 4), ("a", 31, 5), ("b", 12, 1)}
    queue.run(row(6, 10))
    assert queue.depths() == {
        ("a", 5, 1), ("a", 6, 11), ("a", 7, 12), ("a", 12, 13), ("a", 13, 14), ("a", 31, 15), ("b", 12, 1)
    }
    # Two seconds of the block itself, one number for each later block, nothing for the other server.
    assert (queue.written("within", 1), queue.written("before", 1)) == (2, 2)
    assert queue.late() == []


def test_late_rows_count_from_the_first_open_block(spark):
    queue = Queue(spark, delay=10, span=10)
    queue.run(row(5), row(25))
    queue.run(row(6, -1), row(None, 4), row(26))
    assert queue.depths() == {("a", 5, 1), ("a", 25, 5), ("a", 26, 6)}
    assert queue.late() == [("a", 6, -1), ("a", None, 4)]
    queue.run(row(60, 0))
    queue.run(row(61, None), row(1, 2, "new"), (None, 61, 0, 3))
    assert queue.depths() == {
        ("a", 5, 1), ("a", 25, 5), ("a", 26, 6), ("a", 60, 6), ("a", 61, 6), (None, 61, 3)
    }
    queue.run(row(62, 1, "new"))
    assert ("new", 62, 3) in queue.depths()


@pytest.mark.parametrize("keys", [(), ("server",)])
def test_stream_agrees_with_batch_and_with_plain_sums(spark, keys):
    rng = random.Random(len(keys))
    rows = [row(rng.randrange(4000) - 300, rng.choice([-2, 1, 1, 3]), rng.choice("aab")) for _ in range(600)]
    rows.sort(key=lambda r: r[1] + rng.randrange(300))
    queue = Queue(spark, keys, delay=400, span=60)
    for i in range(6):
        queue.run(*rows[i * 100 : i * 100 + 100])
    assert queue.late() == []
    whole = backlog_by_second(spark.createDataFrame(rows, QUEUE), list(keys), span=60)
    assert queue.depths() == {tuple(r) for r in whole.select(*keys, "ts_s", "backlog").collect()}
    sums, expected = defaultdict(int), set()
    for server, ts, _, delta in rows:
        sums[(server,) * len(keys) + (ts,)] += delta
    depth = defaultdict(int)
    for place in sorted(sums):
        depth[place[:-1]] += sums[place]
        expected.add((*place, depth[place[:-1]]))
    assert queue.depths() == expected


def test_state_of_the_backlog_does_not_grow(spark):
    before = set(os.listdir(shared_dir(spark)))
    queue = Queue(spark, delay=20, span=10)
    for i in range(5):
        queue.run(*[row(100 * i + j) for j in range(30)])
    for name in ("seconds", "settled", "before", "mark"):
        (run,) = [f for f in os.listdir(f"{queue.path}/state/{name}") if f.startswith("run=")]
        folder = f"{queue.path}/state/{name}/{run}"
        assert sorted(f for f in os.listdir(folder) if f.startswith("batch")) == ["batch_id=3", "batch_id=4"]
        assert spark.read.parquet(f"{folder}/batch_id=4").count() <= 30
    assert ("a", 429, 150) in queue.depths() and len(queue.depths()) == 150
    assert set(os.listdir(shared_dir(spark))) <= before | {os.path.basename(queue.path)}


def test_nothing_has_come_yet(spark):
    queue = Queue(spark)
    queue.run()
    assert queue.depths() == set() and queue.late() == []
    queue.run(row(None), row(4))
    assert queue.depths() == {("a", 4, 2)}


# --- folded batches ------------------------------------------------------------------------------


def version(table, at, n=1):
    return ("s", table, ["c"] * n, n, at)


def catalog_of(spark, path):
    return {r.table_name: r.valid_from for r in current_catalog(spark, path).collect()}


def folders(path):
    return [f for f in os.listdir(path) if not f.startswith(".")] if os.path.exists(path) else []


def test_catalog_is_folded_while_the_stream_runs(spark):
    path = scratch_path(spark, "folded")
    for i in range(8):
        land(spark, [version("hot", i), version(f"t{i % 3}", i), version(f"t{i % 3}", i - 1)], CATALOG_SCHEMA, f"{path}/in")
        stream = spark.readStream.schema(CATALOG_SCHEMA).parquet(f"{path}/in")
        start_catalog(stream, f"{path}/catalog", f"{path}/progress", fold_every=3).awaitTermination()
        everything = upsert_catalog(spark.read.schema(CATALOG_SCHEMA).parquet(f"{path}/in"))
        assert catalog_of(spark, f"{path}/catalog") == {r.table_name: r.valid_from for r in everything.collect()}
    named = manifest(spark, f"{path}/catalog")
    assert len(named["batches"]) <= 3
    assert folded_rows(spark, f"{path}/catalog", CATALOG_SCHEMA).count() <= 4 + 3 * 2
    (run,) = [f for f in folders(f"{path}/catalog") if f.startswith("run=")]
    assert len(folders(f"{path}/catalog/{run}")) <= 6
    assert len(folders(f"{path}/catalog/_snapshots")) <= 2


def test_a_batch_shows_once_the_manifest_names_it(spark):
    path = scratch_path(spark, "named")

    def add(rows, batch, every=100):
        add_batch(spark.createDataFrame(rows, CATALOG_SCHEMA), path, batch, "r", CATALOG_SCHEMA, upsert_catalog, every)

    add([version("a", 1)], 0)
    # A batch that has been written in part, or whole, but is not named.
    spark.createDataFrame([version("a", 9)], CATALOG_SCHEMA).write.parquet(f"{path}/run=r/batch_id=1")
    assert catalog_of(spark, path) == {"a": 1}
    add([version("a", 2)], 1)
    assert catalog_of(spark, path) == {"a": 2}
    # The same batch once more: it replaces itself.
    add([version("b", 3)], 1)
    assert catalog_of(spark, path) == {"a": 1, "b": 3}
    add([version("b", 4)], 2, every=2)
    add([version("b", 4)], 2, every=1)
    assert catalog_of(spark, path) == {"a": 1, "b": 4}
    assert manifest(spark, path)["batches"] == ["run=r/batch_id=2"]


def test_a_reader_of_the_older_manifest_still_finds_its_files(spark):
    path = scratch_path(spark, "reader")

    def add(batch):
        rows = spark.createDataFrame([version("a", batch)], CATALOG_SCHEMA)
        add_batch(rows, path, batch, "r", CATALOG_SCHEMA, upsert_catalog, 2)

    add(0), add(1)
    reader = folded_rows(spark, path, CATALOG_SCHEMA)
    add(2), add(3)
    assert sorted(r.valid_from for r in reader.collect()) == [0, 1]
    assert catalog_of(spark, path) == {"a": 3}


def test_batches_from_before_there_were_manifests_stay(spark):
    path = scratch_path(spark, "older")
    for batch in range(2):
        spark.createDataFrame([version(f"t{batch}", 1)], CATALOG_SCHEMA).write.parquet(f"{path}/run=x/batch_id={batch}")
    assert catalog_of(spark, path) == {"t0": 1, "t1": 1}
    add_batch(spark.createDataFrame([version("t2", 1)], CATALOG_SCHEMA), path, 0, "y", CATALOG_SCHEMA, upsert_catalog)
    assert catalog_of(spark, path) == {"t0": 1, "t1": 1, "t2": 1}
