"""A dump in chunks against a moving log: the merged events give the table as it ends."""

import random

import pytest
from pyspark.sql import functions as F

from changeflow.sources import change_events, chunked_snapshot, keyed_rows, table_after

ROWS = "seq long, row_index int, action string, old_row array<string>, new_row array<string>"
DUMP = "id string, chunk long, new_row array<string>"
MARKS = "chunk long, low long, high long"
KEYS = 40


def history(seed, n):
    """Valid random changes of a table, one row each; now and then an update gives a row another key."""
    rng, table, rows = random.Random(seed), {}, []
    for seq in range(1, n + 1):
        key, action = str(rng.randrange(KEYS)), rng.choice(["insert", "update", "update", "delete"])
        image = [key, f"v{seq}"]
        if key not in table:
            rows.append((seq, 0, "insert", None, image))
            table[key] = image
        elif action == "delete":
            rows.append((seq, 0, "delete", None, table.pop(key)))
        else:
            free = [str(k) for k in range(KEYS) if str(k) not in table]
            target = rng.choice(free) if free and rng.random() < 0.3 else key
            rows.append((seq, 0, "update", table.pop(key), [target, f"v{seq}"]))
            table[target] = [target, f"v{seq}"]
    return rows


def applied(rows, upto):
    table = {}
    for seq, _, action, old, new in rows:
        if seq > upto:
            break
        if old is not None:
            table.pop(old[0], None)
        if action == "delete":
            table.pop(new[0], None)
        else:
            table[new[0]] = new
    return table


def chunk(key):
    return int(key) // 10


def frames(spark, rows, marks, instants, begins):
    keyed = keyed_rows(spark.createDataFrame([r for r in rows if r[0] > begins], ROWS), {"id": 0})
    dump = [
        (key, c, image)
        for c, at in instants.items() for key, image in applied(rows, at).items() if chunk(key) == c
    ]
    return (
        spark.createDataFrame(dump, DUMP),
        keyed.withColumn("chunk", F.expr("CAST(id AS BIGINT) div 10")),
        spark.createDataFrame([(c, low, high) for c, (low, high) in marks.items()], MARKS),
    )


def final(events):
    return {r.id: list(r.new_row) for r in table_after(events, ["id"]).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_merged_events_give_the_final_table(spark, seed):
    rng, rows = random.Random(seed), history(seed, 600)
    marks = {c: (low, low + rng.randrange(60)) for c in range(4) for low in [rng.randrange(100, 400)]}
    # Keys move between chunks, so all of the dump counts from its first low mark on.
    instants = {c: rng.randint(*marks[c]) for c in marks}
    dump, keyed, marked = frames(spark, rows, marks, instants, min(low for low, _ in marks.values()))
    assert final(chunked_snapshot(dump, keyed, marked, ["id"])) == applied(rows, 600)


def test_a_row_changed_while_it_was_read_is_the_logs(spark):
    """The dump read an older row than the log has by the high mark; it must not come back."""
    rows = [(1, 0, "insert", None, ["1", "old"]), (5, 0, "update", ["1", "old"], ["1", "new"]), (6, 0, "insert", None, ["2", "x"]), (7, 0, "delete", None, ["2", "x"])]
    dump, keyed, marks = frames(spark, rows, {0: (4, 9)}, {0: 6}, 4)
    stale = dump.filter("id = '2'").unionByName(spark.createDataFrame([("1", 0, ["1", "old"])], DUMP))
    assert final(chunked_snapshot(stale, keyed, marks, ["id"])) == {"1": ["1", "new"]}


def test_marks_themselves(spark):
    """A change at the low mark is in the dump, one at the high mark is the log's, a later one wins anyway."""
    rows = [(4, 0, "insert", None, ["1", "a"]), (9, 0, "update", ["1", "a"], ["1", "b"]), (10, 0, "insert", None, ["2", "c"])]
    dump, keyed, marks = frames(spark, rows, {0: (4, 9)}, {0: 4}, 4)
    events = chunked_snapshot(dump, keyed, marks, ["id"])
    assert events.filter("phase = 1").count() == 0
    assert final(events) == {"1": ["1", "b"], "2": ["2", "c"]}
    dump, keyed, marks = frames(spark, rows, {0: (4, 8)}, {0: 4}, 4)
    placed = chunked_snapshot(dump, keyed, marks, ["id"]).filter("phase = 1").collect()
    assert [(r.place, r.id) for r in placed] == [(8, "1")]


def test_an_update_of_the_key_deletes_the_old_one(spark):
    rows = [(1, 0, "insert", None, ["1", "a"]), (2, 0, "update", ["1", "a"], ["2", "a"]), (3, 0, "update", ["2", "a"], ["2", "b"])]
    keyed = keyed_rows(spark.createDataFrame(rows, ROWS), {"id": 0})
    assert sorted((r.seq, r.side, r.action, r.id) for r in keyed.collect()) == [
        (1, 1, "insert", "1"), (2, 0, "delete", "1"), (2, 1, "update", "2"), (3, 1, "update", "2"),
    ]
    assert final(change_events(keyed, ["id"])) == {"2": ["2", "b"]}


def test_empty_dump_and_empty_log(spark):
    nothing = keyed_rows(spark.createDataFrame([], ROWS), {"id": 0}).withColumn("chunk", F.lit(0).cast("long"))
    marks = spark.createDataFrame([(0, 1, 2)], MARKS)
    dump = spark.createDataFrame([("1", 0, ["1", "a"])], DUMP)
    assert final(chunked_snapshot(dump, nothing, marks, ["id"])) == {"1": ["1", "a"]}
    assert final(chunked_snapshot(dump.limit(0), nothing, marks, ["id"])) == {}


def test_a_hot_key_is_reduced_before_it_meets_the_dump(spark):
    """Many changes of one key leave their tasks as one row each."""
    rows = spark.range(20_000).select(
        (F.col("id") + 1).alias("seq"), F.lit(0).alias("row_index"), F.lit("update").alias("action"),
        F.array(F.lit("1")).alias("old_row"), F.array(F.lit("1")).alias("new_row"),
    )
    keyed = keyed_rows(rows, {"id": 0}).withColumn("chunk", F.lit(0).cast("long"))
    marks = spark.createDataFrame([(0, 0, 30_000)], MARKS)
    dump = spark.createDataFrame([("1", 0, ["1"]), ("2", 0, ["2"])], DUMP)
    events = chunked_snapshot(dump, keyed, marks, ["id"])
    assert [r.id for r in events.filter("phase = 1").collect()] == ["2"]
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[_of_id" in plan and "CartesianProduct" not in plan
