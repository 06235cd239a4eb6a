"""Blocked windows against plain walks, with blocks of a few rows."""

import random

import pytest

from changeflow.operators.ordered import (
    asof_join,
    block_of,
    carry_forward,
    next_after,
    next_multiple,
    running_total,
)
from changeflow.operators.progress import backlog, backlog_by_second


def _rows(seed, n=300):
    rng = random.Random(seed)
    keys = ["hot", "hot", "hot", "a", None]
    return [
        (rng.choice(keys), p, rng.choice([None, rng.randrange(100)]), rng.randrange(-3, 9))
        for p in rng.sample(range(-500, 2000), n)
    ]


SCHEMA = "k string, p long, v int, w long"


@pytest.mark.parametrize("levels", [[], [8], [64, 8]])
def test_blocked_windows(spark, levels):
    rows = _rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    names = []
    for i, width in enumerate(levels):
        df = df.withColumn(f"b{i}", block_of("p", width))
        names.append(f"b{i}")
    total = running_total(df, "w", ["k"], ["p"], names, "total")
    filled = carry_forward(total, ["v"], ["k"], ["p"], names)
    done = next_after(filled, "p", ["k"], ["p"], names, "following")
    got = sorted(
        ((r.k, r.p, r.v, r.total, r.following) for r in done.collect()), key=str
    )
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        total, last = 0, None
        for i, (p, v, w) in enumerate(mine):
            total, last = total + w, v if v is not None else last
            following = mine[i + 1][0] if i + 1 < len(mine) else None
            expected.append((key, p, last, total, following))
    assert got == sorted(expected, key=str)
    assert done.schema["w"].dataType == df.schema["w"].dataType


@pytest.mark.parametrize("width", [5, 100, 1 << 20])
def test_asof_join(spark, width):
    rng = random.Random(6)
    left = [(rng.choice("aab"), rng.randrange(300), i) for i in range(200)]
    right = [("a", at, f"v{at}") for at in rng.sample(range(50, 280), 25)]
    joined = asof_join(
        spark.createDataFrame(left, "k string, seq long, i long"),
        spark.createDataFrame(right, "k string, valid_from long, name string"),
        ["k"], "seq", "valid_from", ["name"], width,
    )
    assert joined.columns == ["k", "seq", "i", "name"]
    for r in joined.collect():
        versions = [v for v in right if v[0] == r.k and v[1] <= r.seq]
        assert r.name == (max(versions, key=lambda v: v[1])[2] if versions else None)
    assert joined.count() == len(left)


def test_exact_multiples(spark):
    big = (1 << 60) + 3
    df = spark.createDataFrame([(big,), (-3,), (10,)], "p long")
    got = df.select(block_of("p", 10).alias("b"), next_multiple("p", 10).alias("n")).collect()
    assert [(r.b, r.n) for r in got] == [
        (big - big % 10, big + -big % 10), (-10, 0), (10, 10)
    ]


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_backlog_of_a_burst(spark, width):
    """A third of all events falls in one second, over many blocks."""
    rng = random.Random(7)
    events = [(i, 7300 if i % 3 == 0 else rng.randrange(20000), rng.choice([1, 1, -1]))
              for i in range(300)]
    df = spark.createDataFrame(events, "seq long, ts_s long, delta int")
    got = {(r.ts_s, r.seq): r.backlog for r in backlog(df, width=width).collect()}
    depth = 0
    by_second = {}
    for seq, ts, delta in sorted(events, key=lambda e: (e[1], e[0])):
        depth += delta
        assert got[(ts, seq)] == depth
        by_second[ts] = depth
    assert {r.ts_s: r.backlog for r in backlog_by_second(df).collect()} == by_second
