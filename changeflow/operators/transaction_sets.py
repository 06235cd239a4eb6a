"""Algebra of transaction sets kept as tables of inclusive intervals per server.

Every operation is one sweep: intervals become +1 at their start and -1 behind their end, running totals
tell at each such number which sets hold it, and the numbers where the answer changes are the ends of the
result's intervals. Results are disjoint, in the fewest intervals, and touching ones are one. The edges, two
rows per interval, are written as a table when an operation is called; unless they are few, totals run in
blocks of numbers, so no server goes through one task.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from changeflow.operators.ordered import block_of, levels_of, next_after, running_total
from changeflow.session import written

SERVER = "server_uuid"
WIDTH = 1 << 20


def _edges(sets):
    """One row per server and number at which an interval of some set starts or has just ended."""
    parts = []
    for i, ranges in enumerate(sets):
        valid = ranges.filter(f"{SERVER} IS NOT NULL AND gno_start <= gno_end")
        for at, step in ((F.col("gno_start"), 1), (F.col("gno_end") + 1, -1)):
            steps = [F.lit(step if i == j else 0).cast("bigint").alias(f"_step_{j}") for j in range(len(sets))]
            parts.append(valid.select(SERVER, at.alias("_at"), *steps))
    names = [f"_step_{j}" for j in range(len(sets))]
    summed = reduce(lambda a, b: a.unionByName(b), parts).groupBy(SERVER, "_at").agg(*[F.sum(n).alias(n) for n in names])
    return written(summed.filter(" OR ".join(f"{n} <> 0" for n in names)), "set-edges")


def segments(sets, holds, width=WIDTH):
    """The numbers of each server from the first transaction of any set to the last, cut where ``holds`` changes.

    Inclusive intervals ``gno_start .. gno_end`` with ``holds`` as a column; neighbours differ in it.
    """
    edges = _edges(sets)
    levels = levels_of(edges, ["_block"])
    swept = edges.withColumn("_block", block_of("_at", width))
    for j in range(len(sets)):
        swept = running_total(swept, f"_step_{j}", [SERVER], ["_at"], levels, f"_depth_{j}")
    now = holds(*[F.col(f"_depth_{j}") > 0 for j in range(len(sets))])
    before = holds(*[F.col(f"_depth_{j}") > F.col(f"_step_{j}") for j in range(len(sets))])
    changes = swept.select(SERVER, "_at", "_block", now.alias("holds"), before.alias("_before")).filter("holds <> _before")
    paired = next_after(changes, "_at", [SERVER], ["_at"], levels, "_next")
    return paired.filter("_next IS NOT NULL").select(
        SERVER, F.col("_at").alias("gno_start"), (F.col("_next") - 1).alias("gno_end"), "holds"
    )


def combined(sets, holds, width=WIDTH):
    """The transactions for which ``holds`` is true, given a boolean column per set; intervals as a table.

    ``holds`` must be false where no set has the transaction. Intervals without a server or with an end
    before their start are nothing; they may overlap and repeat.
    """
    return segments(sets, holds, width).filter("holds").drop("holds")


def coalesced(ranges, width=WIDTH):
    """The set in the fewest intervals."""
    return combined([ranges], lambda a: a, width)


def union_sets(left, right, width=WIDTH):
    return combined([left, right], lambda a, b: a | b, width)


def intersect_sets(left, right, width=WIDTH):
    return combined([left, right], lambda a, b: a & b, width)


def subtract_sets(left, right, width=WIDTH):
    """Transactions of ``left`` that ``right`` does not have."""
    return combined([left, right], lambda a, b: a & ~b, width)


def contained(left, right, width=WIDTH):
    """For each server of ``left``, whether ``right`` has all its transactions, and how many it lacks."""
    lacking = subtract_sets(left, right, width).groupBy(SERVER).agg(
        F.sum(F.col("gno_end") - F.col("gno_start") + 1).alias("_n")
    )
    servers = left.filter(f"{SERVER} IS NOT NULL AND gno_start <= gno_end").select(SERVER).distinct()
    missing = F.coalesce("_n", F.lit(0).cast("bigint"))
    return servers.join(lacking, SERVER, "left").select(
        SERVER, (missing == 0).alias("contained"), missing.alias("n_missing")
    )


def observed_set(changes, width=WIDTH):
    """The transactions a log holds; rows without server or number are nothing.

    Runs of numbers are found inside blocks and then joined across them.
    """
    seen = changes.filter(f"{SERVER} IS NOT NULL AND gno IS NOT NULL").select(SERVER, "gno").distinct()
    blocked = seen.withColumn("_block", block_of("gno", width))
    place = F.row_number().over(Window.partitionBy(SERVER, "_block").orderBy("gno"))
    runs = (
        blocked.withColumn("_run", F.col("gno") - place)
        .groupBy(SERVER, "_block", "_run")
        .agg(F.min("gno").alias("gno_start"), F.max("gno").alias("gno_end"))
        .select(SERVER, "gno_start", "gno_end")
    )
    return coalesced(runs, width)


def server_texts(ranges, width=WIDTH):
    """``uuid:a-b:c`` per server, intervals in order."""
    one = F.col("gno_start") == F.col("gno_end")
    text = F.when(one, F.col("gno_start").cast("string")).otherwise(F.concat_ws("-", "gno_start", "gno_end"))
    grouped = coalesced(ranges, width).groupBy(SERVER).agg(
        F.array_sort(F.collect_list(F.struct("gno_start", text.alias("text")))).alias("_parts")
    )
    return grouped.select(
        SERVER, F.concat_ws(":", SERVER, F.array_join(F.col("_parts.text"), ":")).alias("gtid_set")
    )


def set_text(ranges, width=WIDTH):
    """The whole set as one text, servers in order; one row always, empty for the empty set.

    A text is one value, as servers and checkpoint files take it; ``server_texts`` keeps servers apart.
    """
    return server_texts(ranges, width).agg(
        F.coalesce(F.array_join(F.array_sort(F.collect_list("gtid_set")), ","), F.lit("")).alias("gtid_set")
    )
