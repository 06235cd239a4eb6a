"""A dump taken chunk by chunk while the log moves on, merged with the changes of that time.

A chunk is a range of keys. The log's place is noted before a chunk is read (``low``) and after (``high``); what
was read is the chunk as it stood at some place between. A row that no change in between touched was the
same all that time, so it can stand in the log at ``high``. A row that one did touch is left out: the
log has it. Chunks may be read in any order and at the same time.
"""

from functools import reduce

from pyspark.sql import functions as F

#: Order of events: place in the log, changes before dump rows, row in the change, old key before new one.
EVENT_ORDER = ("place", "phase", "row_index", "side")


def _key(image, at):
    return F.struct(*[F.get(F.col(image), i).alias(k) for k, i in at.items()])


def keyed_rows(rows, at):
    """Row messages with the columns of their key; ``at`` maps a key column to its place in the row.

    An update that changes a row's key is two rows: the old key is deleted (``side`` 0), the new one is
    there (``side`` 1, as of every other row).
    """
    new = F.struct(F.col("action").alias("action"), F.lit(1).alias("side"), _key("new_row", at).alias("key"))
    old = F.struct(F.lit("delete").alias("action"), F.lit(0).alias("side"), _key("old_row", at).alias("key"))
    moved = (
        (F.col("action") == "update") & F.col("old_row").isNotNull()
        & ~_key("old_row", at).eqNullSafe(_key("new_row", at))
    )
    kept = [c for c in rows.columns if c not in ("action", *at)]
    sides = rows.select(*kept, F.explode(F.when(moved, F.array(old, new)).otherwise(F.array(new))).alias("_side"))
    return sides.select(*kept, "_side.action", "_side.side", *[F.col(f"_side.key.{k}").alias(k) for k in at])


def _same(left, right, keys):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_of_{k}"]) for k in keys])


def chunked_snapshot(dump, rows, marks, keys):
    """Changes and dump rows as one sequence of events, in ``EVENT_ORDER``.

    ``dump`` holds ``keys``, ``chunk`` and ``new_row``; ``rows`` are those of ``keyed_rows`` with a ``chunk``, from the
    least low mark on at the latest; ``marks`` has one row per chunk with ``low`` and ``high``. A dump row of
    a chunk without marks cannot be placed and is left out. Null keys are equal.

    Changes meet the marks by chunk and shrink to the keys touched while their chunk was read before they
    meet the dump, so a key with many changes sends few rows.
    """
    marks = marks.select("chunk", "low", "high")
    while_read = (F.col("seq") > F.col("low")) & (F.col("seq") <= F.col("high"))
    touched = (
        rows.join(marks, "chunk").filter(while_read).select(*[F.col(k).alias(f"_of_{k}") for k in keys]).distinct()
    )
    placed = dump.join(marks, "chunk")
    untouched = placed.join(touched, _same(placed, touched, keys), "left_anti")
    dumped = untouched.select(
        F.col("high").alias("place"), F.lit(1).alias("phase"), F.lit(0).alias("row_index"), F.lit(1).alias("side"),
        F.lit("insert").alias("action"), *keys, "new_row",
    )
    return change_events(rows, keys).unionByName(dumped)


def change_events(rows, keys):
    """The rows of ``keyed_rows`` as events, where there is no dump."""
    return rows.select(
        F.col("seq").alias("place"), F.lit(0).alias("phase"), "row_index", "side", "action", *keys, "new_row"
    )


def table_after(events, keys):
    """The rows of a table once all events are applied: the last one of each key, unless it is a delete."""
    last = F.max_by(F.struct("action", "new_row"), F.struct(*EVENT_ORDER)).alias("_last")
    return (
        events.groupBy(*keys).agg(last).filter("_last.action <> 'delete'")
        .select(*keys, F.col("_last.new_row").alias("new_row"))
    )
