"""Metric series kept by a stream: bounded, across batches, restarts, late and repeated samples."""

import os
import random

from changeflow.session import scratch_path
from changeflow.streaming import kept_samples, series_log, start_series
from changeflow.streaming.folding import manifest

SAMPLES = "relay string, ts_s long, depth long"


class Series:
    def __init__(self, spark, **options):
        self.spark, self.path, self.options = spark, scratch_path(spark, "series"), options
        self.schema = spark.createDataFrame([], SAMPLES).schema

    def run(self, *rows, **more):
        self.spark.createDataFrame(list(rows), SAMPLES).coalesce(1).write.mode("append").parquet(f"{self.path}-in")
        stream = self.spark.readStream.schema(SAMPLES).parquet(f"{self.path}-in")
        start_series(stream, self.path, f"{self.path}-progress", ["relay"], **self.options, **more).awaitTermination()

    def kept(self):
        limits = {k: v for k, v in self.options.items() if k in ("keep", "live_s")}
        return {tuple(r) for r in series_log(self.spark, self.path, self.schema, ["relay"], **limits).collect()}


def plain(rows, keep, live_s=None):
    series = {}
    for relay, ts, depth in rows:
        times = series.setdefault(relay, {})
        times[ts] = max(times.get(ts, depth), depth)
    newest = max((ts for _, ts, _ in rows), default=0)
    return {
        (relay, ts, times[ts])
        for relay, times in series.items()
        for ts in sorted(times, reverse=True)[:keep] if live_s is None or ts >= newest - live_s
    }


def test_any_order_of_batches_gives_the_newest(spark):
    rng, series, seen = random.Random(5), Series(spark, keep=6, live_s=12, fold_every=3), []
    for _ in range(7):
        rows = [(rng.choice(["a", "b", None]), rng.randrange(60), rng.randrange(9)) for _ in range(15)]
        seen += rows
        series.run(*rows)
        assert series.kept() == plain(seen, 6, 12)


def test_a_series_without_samples_is_forgotten(spark):
    series = Series(spark, keep=3, live_s=50, fold_every=2)
    series.run(("old", 10, 1), ("new", 20, 1))
    assert len(series.kept()) == 2
    series.run(("new", 61, 2))
    assert series.kept() == {("new", 20, 1), ("new", 61, 2)}
    # Its old sample does not come back with it, folded or not.
    series.run(("new", 62, 3))
    series.run(("old", 63, 9))
    assert series.kept() == {("new", 20, 1), ("new", 61, 2), ("new", 62, 3), ("old", 63, 9)}


def test_storage_does_not_grow(spark):
    series = Series(spark, keep=4, fold_every=2)
    for k in range(7):
        series.run(*[("a", 10 * k + i, i) for i in range(10)])
    assert len(manifest(spark, series.path)["batches"]) <= 2
    rows = spark.read.schema(SAMPLES).option("recursiveFileLookup", "true").parquet(series.path).count()
    assert rows <= 6 * 4
    assert len(series.kept()) == 4


def test_nothing_has_come_yet_and_empty_batches(spark):
    series = Series(spark, keep=4, live_s=10)
    assert series.kept() == set()
    series.run()
    assert series.kept() == set()


def test_a_repeated_batch_changes_nothing(spark):
    series = Series(spark, keep=4)
    series.run(("a", 1, 5), ("a", 2, 6))
    commits = f"{series.path}-progress/commits"
    for name in os.listdir(commits):
        os.remove(f"{commits}/{name}")
    series.run()
    assert series.kept() == {("a", 1, 5), ("a", 2, 6)}


def test_tasks_prune_before_the_shuffle(spark):
    samples = spark.range(5000).selectExpr("CAST(id % 2 AS string) AS relay", "id AS ts_s", "id AS depth")
    kept = kept_samples(samples, ["relay"], 3)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 6
