"""The interval index and the algebra of transaction sets, against plain Python sets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from changeflow.functions.gtid import set_ranges
from changeflow.operators import catalog, intervals, ordered, transaction_sets
from changeflow.sources import skip_executed

RANGES = "server_uuid string, gno_start long, gno_end long"


def pieces_of(spark, spans):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "i long, a long, b long")
    found = frame.select("i", F.explode(intervals.dyadic_pieces(F.col("a"), F.col("b"))).alias("p"))
    out = {i: [] for i in range(len(spans))}
    for r in found.collect():
        out[r.i].append((r.p.number << r.p.width, (r.p.number + 1 << r.p.width) - 1))
    return [sorted(out[i]) for i in range(len(spans))]


def test_pieces_tile_their_interval(spark):
    rng = random.Random(1)
    spans = [(0, 0), (0, 2**62 - 1), (1, 2**62 - 2), (-5, 7), (1, 10**12), (3, 10**12 - 5), (7, 7), (8, 15)]
    spans += [(a, a + rng.randrange(2 ** rng.randrange(1, 50))) for a in (rng.randrange(2**55) for _ in range(200))]
    for (a, b), pieces in zip(spans, pieces_of(spark, spans)):
        assert pieces[0][0] == a and pieces[-1][1] == b
        assert all(x[1] + 1 == y[0] for x, y in zip(pieces, pieces[1:]))
        assert all(low % (high - low + 1) == 0 for low, high in pieces)
        if b <= 10**12:
            assert len(pieces) <= 80


def test_an_empty_interval_has_no_piece(spark):
    assert pieces_of(spark, [(5, 4), (9, 1)]) == [[], []]


def test_locate(spark):
    """Nulls in keys and values, values outside, keys without intervals, rows that are settled."""
    held = spark.createDataFrame(
        [("a", 3, 9, "x"), ("a", 10, 10, "y"), ("a", 11, 40, "z"), (None, 0, 5, "n"), ("b", 7, 7, "b")],
        "k string, s long, e long, v string",
    )
    rows = [("a", n) for n in range(0, 45)] + [(None, 3), (None, 6), ("b", 7), ("b", 8), ("c", 7), ("a", None)]
    frame = spark.createDataFrame([(k, n, "other") for k, n in rows], "k string, n long, e string")
    found = intervals.locate(frame, ["k"], "n", held, "s", "e", ["v"], settled=F.col("n") == 12)

    def expected(k, n):
        if n is None or n == 12:
            return None
        return next((v for key, s, e, v in held.collect() if key == k and s <= n <= e), None)

    assert sorted(((r.k, r.n, r.v) for r in found.collect()), key=repr) == sorted(
        ((k, n, expected(k, n)) for k, n in rows), key=repr
    )
    assert found.columns == ["k", "n", "e", "v"]


def brute_as_of(changes, versions):
    best = {}
    for s, t, columns, n, at in versions:
        best[s, t, at] = max(best.get((s, t, at), ([], -1)), (columns, n))
    out = []
    for seq, s, t in changes:
        held = [at for (a, b, at) in best if (a, b) == (s, t) and at <= seq]
        columns, n = best[s, t, max(held)] if held else (None, None)
        out.append((seq, s, t, columns, n, max(held, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("plain_rows", [1 << 16, 0])
def test_schema_as_of_against_brute_force(spark, monkeypatch, plain_rows):
    monkeypatch.setattr(ordered, "PLAIN_ROWS", plain_rows)
    rng = random.Random(2)
    tables = [("s", "a"), ("s", "b"), (None, "a"), ("s", None)]
    versions = [(*rng.choice(tables), ["c"] * n, n, rng.randrange(0, 3000)) for n in (rng.randrange(1, 5) for _ in range(300))]
    changes = [(rng.randrange(-5, 4000), *rng.choice([*tables, ("s", "none")])) for _ in range(800)]
    found = catalog.resolve_as_of(
        spark.createDataFrame(changes, "seq long, schema_name string, table_name string"),
        spark.createDataFrame(versions, "schema_name string, table_name string, columns array<string>, n_cols int, valid_from long"),
        width=64,
    )
    rows = [tuple(r) for r in found.select("seq", "schema_name", "table_name", "columns", "n_cols", "valid_from").collect()]
    assert sorted(rows, key=repr) == brute_as_of(changes, versions)


def test_schema_as_of_a_long_log(spark):
    """Work grows with the versions and not with ``seq``: 5,000 tables, numbers up to 10**12."""
    versions = spark.range(15_000).select(
        F.lit("s").alias("schema_name"), F.concat(F.lit("t"), (F.col("id") % 5000).cast("string")).alias("table_name"),
        F.array(F.lit("a")).alias("columns"), F.lit(1).alias("n_cols"),
        (F.expr("id div 5000") * 333_333_333_333 + F.col("id") % 977).alias("valid_from"),
    )
    changes = spark.range(2000).select(
        (F.col("id") * 500_000_000).alias("seq"), F.lit("s").alias("schema_name"),
        F.concat(F.lit("t"), (F.col("id") % 5000).cast("string")).alias("table_name"),
    )
    began = time.time()
    found = catalog.resolve_as_of(changes, versions)
    plan = found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert time.time() - began < 60
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for r in rows:
        i = int(r.table_name[1:])
        starts = [v * 333_333_333_333 + (v * 5000 + i) % 977 for v in range(3)]
        assert r.valid_from == max((s for s in starts if s <= r.seq), default=None)


@pytest.mark.parametrize("plain_rows", [1 << 16, 0])
def test_schema_as_of_shuffles_each_change_once(spark, monkeypatch, plain_rows):
    """Where the history is too long to be broadcast, no change is multiplied before a shuffle."""
    monkeypatch.setattr(ordered, "PLAIN_ROWS", plain_rows)
    rng = random.Random(4)
    versions = [("s", rng.choice("ab"), ["c"] * n, n, rng.randrange(3000)) for n in (rng.randrange(1, 5) for _ in range(300))]
    changes = [(rng.randrange(-5, 4000), "s", rng.choice("abn")) for _ in range(500)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.resolve_as_of(
            spark.createDataFrame(changes, "seq long, schema_name string, table_name string"),
            spark.createDataFrame(versions, "schema_name string, table_name string, columns array<string>, n_cols int, valid_from long"),
        )
        assert "explode" not in found._jdf.queryExecution().executedPlan().toString().lower()
        rows = [tuple(r) for r in found.select("seq", "schema_name", "table_name", "columns", "n_cols", "valid_from").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(rows, key=repr) == brute_as_of(changes, versions)


def test_lookup_in_order_equals_lookup_by_pieces(spark):
    held = spark.createDataFrame([("a", 1, 4, "x"), ("a", 5, 5, "y"), ("a", 9, 8, "none"), (None, 2, 3, "z"), ("a", None, 7, "none")], "k string, s long, e long, v string")
    frame = spark.createDataFrame([(k, n, i) for i, k in enumerate(["a", None, "b"]) for n in [None, -1, *range(12)]], "k string, n long, i int")
    by_pieces = intervals.locate(frame, ["k"], "n", held, "s", "e", ["v"], settled=F.col("n") == 2)
    in_order = intervals._in_order(frame, ["k"], "n", held, "s", "e", ["v"], F.col("n") == 2)
    assert in_order.columns == by_pieces.columns
    assert sorted(map(tuple, in_order.collect()), key=repr) == sorted(map(tuple, by_pieces.collect()), key=repr)


@pytest.mark.parametrize("plain_rows", [1 << 16, 0])
def test_skip_executed_against_sets(spark, monkeypatch, plain_rows):
    monkeypatch.setattr(ordered, "PLAIN_ROWS", plain_rows)
    rng = random.Random(3)
    executed = [(rng.choice("ab"), a, a + rng.randrange(-2, 30)) for a in (rng.randrange(1, 900) for _ in range(60))]
    executed += [(None, 1, 5), ("c", 1, 10**12), ("a", None, 4)]
    log = [(rng.choice(["a", "b", "c", "d", None]), rng.randrange(0, 1000)) for _ in range(2000)] + [("a", None)]
    left = skip_executed(
        spark.createDataFrame(log, "server_uuid string, gno long"), spark.createDataFrame(executed, RANGES), width=64
    )

    def held(server, gno):
        return gno is not None and any(s == server and a is not None and a <= gno <= b for s, a, b in executed if s)

    assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted((x for x in log if not held(*x)), key=repr)


def test_one_long_interval_is_few_pieces(spark):
    """A set of one interval to 10**12 keeps the log where it is."""
    log = spark.createDataFrame([("a", 1), ("a", 10**12), ("a", 10**12 + 1)], "server_uuid string, gno long")
    left = skip_executed(log, spark.createDataFrame([("a", 1, 10**12)], RANGES))
    assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    assert [r.gno for r in left.collect()] == [10**12 + 1]


# --- sets ----------------------------------------------------------------------------------------


def some_ranges(seed, n=40, span=200):
    rng = random.Random(seed)
    return [(rng.choice("abc"), s, s + rng.randrange(-1, 12)) for s in (rng.randrange(1, span) for _ in range(n))]


def as_set(ranges):
    return {(s, n) for s, a, b in ranges for n in range(a, b + 1)}


def fewest(members):
    out = []
    for s, n in sorted(members):
        if out and out[-1][0] == s and out[-1][2] == n - 1:
            out[-1][2] = n
        else:
            out.append([s, n, n])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("plain_rows", [1 << 16, 0])
@pytest.mark.parametrize("seed", range(2))
def test_operations(spark, monkeypatch, seed, plain_rows):
    monkeypatch.setattr(ordered, "PLAIN_ROWS", plain_rows)
    left, right = some_ranges(seed), some_ranges(seed + 50, 25)
    a, b = (spark.createDataFrame(x, RANGES) for x in (left, right))
    x, y = as_set(left), as_set(right)
    for operation, expected in (
        (transaction_sets.union_sets, x | y),
        (transaction_sets.intersect_sets, x & y),
        (transaction_sets.subtract_sets, x - y),
    ):
        assert sorted(tuple(r) for r in operation(a, b, width=16).collect()) == fewest(expected)
    assert sorted(tuple(r) for r in transaction_sets.coalesced(a, width=16).collect()) == fewest(x)
    found = {r.server_uuid: (r.contained, r.n_missing) for r in transaction_sets.contained(a, b, width=16).collect()}
    missing = {s: sum(1 for m in x - y if m[0] == s) for s in {m[0] for m in x}}
    assert found == {s: (n == 0, n) for s, n in missing.items()}


def test_empty_sets(spark):
    none = spark.createDataFrame([], RANGES)
    some = spark.createDataFrame([("a", 1, 3), ("a", 4, 4)], RANGES)
    assert transaction_sets.union_sets(none, none).collect() == []
    assert transaction_sets.subtract_sets(none, some).collect() == []
    assert [tuple(r) for r in transaction_sets.subtract_sets(some, none).collect()] == [("a", 1, 4)]
    assert transaction_sets.contained(none, some).collect() == []
    assert [r.gtid_set for r in transaction_sets.set_text(none).collect()] == [""]


def test_observed_set(spark):
    """Repeated, missing and unordered transactions, in blocks smaller than a run."""
    rng = random.Random(5)
    log = [(rng.choice("ab"), rng.randrange(1, 300)) for _ in range(400)] + [(None, 4), ("a", None)]
    seen = transaction_sets.observed_set(spark.createDataFrame(log, "server_uuid string, gno long"), width=16)
    assert sorted(tuple(r) for r in seen.collect()) == fewest({(s, n) for s, n in log if s and n})


def test_text_and_back(spark):
    ranges = some_ranges(9)
    texts = transaction_sets.set_text(spark.createDataFrame(ranges, RANGES))
    text, = (r.gtid_set for r in texts.collect())
    assert text.startswith("a:") and text.count(",") == 2
    back = texts.select(F.explode(set_ranges(F.col("gtid_set"))).alias("r")).select("r.*")
    assert sorted(tuple(r) for r in back.collect()) == fewest(as_set(ranges))
