"""Positions, transaction ids, backlog and micro-batches."""

from pyspark.sql import functions as F

from changeflow.operators.greedy import CHUNK_ROWS, greedy_scan
from changeflow.operators.ordered import BLOCK_ROWS, block_of, running_total

#: Fixed value: rows that fill a micro-batch.
BULK_SIZE = 100


def latest_position(positions, keys=("server_uuid",)):
    """The last position of each stream: the last writer wins.

    First per log file, which aggregates numbers only and so hashes instead of
    sorting all rows, then over the files.
    """
    per_file = positions.groupBy(*keys, "binlog_file").agg(
        F.max("seq").alias("seq"), F.max_by("binlog_pos", "seq").alias("binlog_pos")
    )
    return per_file.groupBy(*keys).agg(
        F.max_by("binlog_file", "seq").alias("binlog_file"),
        F.max_by("binlog_pos", "seq").alias("binlog_pos"),
        F.max("seq").alias("seq"),
    )


def latest_gtid(saved, keys=("server_uuid",)):
    """The last saved transaction id of each stream."""
    return saved.groupBy(*keys).agg(F.max_by("gtid_set", "seq").alias("gtid_set"))


def progress_info(positions, saved, keys=("server_uuid",)):
    """Where each stream stands: log file, position and saved transaction id.

    Both inputs shrink to one row per stream before they meet; a stream without
    a saved id shows the empty text.
    """
    keys = list(keys)
    return (
        latest_position(positions, keys)
        .join(latest_gtid(saved, keys), keys, "left")
        .select(
            *keys,
            "binlog_file",
            "binlog_pos",
            F.coalesce("gtid_set", F.lit("")).alias("gtid_set"),
        )
    )


def backlog(queue_events, keys=(), width=BLOCK_ROWS, span=3600):
    """Queue depth after each event: the running sum of ``delta``.

    Events are taken in order ``(ts_s, seq)``, additions before removals. Blocks
    are hours, then seconds cut by ``seq``, so a burst within one second spreads
    over several blocks as well.
    """
    blocked = queue_events.withColumns(
        {
            "_span": block_of("ts_s", span),
            "_part": F.struct("ts_s", block_of("seq", width).alias("part")),
            "_removal": -F.col("delta"),
        }
    )
    return running_total(
        blocked, "delta", list(keys), ["ts_s", "seq", "_removal"],
        ["_span", "_part"], "backlog",
    ).drop("_span", "_part", "_removal")


def backlog_by_second(queue_events, keys=(), span=3600):
    """Queue depth at the end of each second that saw an event.

    Seconds are summed before the shuffle; the scan sees one row per second.
    """
    seconds = (
        queue_events.groupBy(*keys, "ts_s")
        .agg(F.sum("delta").alias("delta"))
        .withColumn("_span", block_of("ts_s", span))
    )
    return running_total(
        seconds, "delta", list(keys), ["ts_s"], ["_span"], "backlog"
    ).drop("_span")


def micro_batches(
    row_events, weight, keys=(), bulk_size=BULK_SIZE, tick=1, width=CHUNK_ROWS,
    checkpoints=None,
):
    """The flushes of the row buffer, one row per micro-batch.

    A batch closes when a whole event brings it to ``bulk_size`` rows or more, or
    at the interval tick. With ``checkpoints`` (rows holding the ``seq`` of saved
    transaction ids), a saved id also closes the batch before its own event.
    """
    keys = list(keys)
    columns = [*keys, "seq", block_of("ts_s", tick).alias("tick_s")]
    points = row_events.select(
        *columns, F.lit(1).alias("_is_rows"), F.col(weight).cast("bigint").alias("_weight")
    )
    force = None
    if checkpoints is not None:
        force = "_flush"
        points = points.withColumn(force, F.lit(False)).unionByName(
            checkpoints.select(
                *columns,
                F.lit(0).alias("_is_rows"),
                F.lit(0).cast("bigint").alias("_weight"),
                F.lit(True).alias(force),
            )
        )
    points = points.withColumn("_block", block_of("seq", width))
    scanned = greedy_scan(
        points, [*keys, "tick_s"], ["seq", "_is_rows"], "_block", bulk_size,
        strict=False, weight="_weight", force=force,
    )
    return (
        scanned.filter("_is_rows = 1")
        .groupBy(*keys, "tick_s", "fired_before")
        .agg(
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.count("*").alias("n_events"),
            F.sum("_weight").alias("n_rows"),
        )
        .drop("fired_before")
    )
