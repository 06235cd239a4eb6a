"""Rate limits built on the greedy scan: checkpoints and alerts."""

from functools import reduce

from pyspark.sql import functions as F

from changeflow.operators.greedy import CHUNK_ROWS, greedy_scan
from changeflow.operators.ordered import block_of
from changeflow.session import written

#: Seconds between saved checkpoints, seconds of alert silence.
CHECKPOINT_GAP = 3
SILENCE_GAP = 1800

_LAST = (1 << 63) - 1


def throttle(
    events, keys, time, order, gap, strict, start=None, force=None, succeeded=None,
    chunk_seconds=CHUNK_ROWS,
):
    """Rows of ``events`` kept by a rate limit per ``keys``.

    ``time`` is in whole seconds and ``order`` numbers the rows within one. A row
    is kept if it is at least ``gap`` (more than ``gap`` if ``strict``) after the
    last kept one, or if ``force`` says so. With ``succeeded``, kept rows that
    failed do not start the wait.

    Only the first row of a second can be kept by distance (or, where rows can
    fail, those up to its first success), so the scan sees one row of numbers per
    key and second, aggregated before the shuffle. The seconds that pass, at most
    one per key and gap but for failures, are written to the shared folder when
    this is called. Their size is then known: Spark broadcasts them if they are
    under its limit, and the events are scanned again without a shuffle.
    """
    if force and succeeded:
        raise ValueError("force and succeeded exclude each other")
    if succeeded:
        ok = F.coalesce(F.col(succeeded), F.lit(False))
        flags = {"_upto": F.min(F.when(ok, F.col(order))), "_ok": F.bool_or(ok)}
    else:
        flags = {"_upto": F.min(order)}
    if force:
        forced = F.coalesce(F.col(force), F.lit(False))
        flags["_forced"] = F.bool_or(forced)
    on = [*keys, time]
    seconds = (
        events.groupBy(*on)
        .agg(*[flag.alias(name) for name, flag in flags.items()])
        .withColumn("_span", block_of(time, chunk_seconds))
    )
    scanned = greedy_scan(
        seconds, keys, [time], "_span", gap, strict, position=time, start=start,
        force="_forced" if force else None, moves="_ok" if succeeded else None,
    )
    passing = written(
        scanned.filter("passes").select(
            *[F.col(c).alias(f"_p_{c}") for c in on],
            F.coalesce("_upto", F.lit(_LAST)).alias("_upto"),
        ),
        "passing",
    )
    same_second = reduce(
        lambda a, b: a & b, [events[c].eqNullSafe(passing[f"_p_{c}"]) for c in on]
    )
    in_turn = F.col(order) <= F.col("_upto")
    if force:
        kept = events.join(passing, same_second, "left").filter(forced | in_turn)
    else:
        kept = events.join(passing, same_second).filter(in_turn)
    return kept.select(*events.columns)


def throttle_checkpoints(gtids, keys=("server_uuid",), gap=CHECKPOINT_GAP, start="first"):
    """Transaction ids to save: forced ones, and any more than ``gap`` seconds
    after the last saved. The wait begins at ``start``, the relay's start time,
    by default the first event's."""
    return throttle(
        gtids, list(keys), "ts_s", "seq", gap, strict=True, start=start, force="force"
    )


def silence_alerts(alerts, keys=("channel",), time="ts_s", order="seq",
                   gap=SILENCE_GAP, succeeded=None):
    """Alerts each channel sends: the first, and any at least ``gap`` seconds
    after the last one sent successfully."""
    return throttle(
        alerts, list(keys), time, order, gap, strict=False, succeeded=succeeded
    )
