"""Counters and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from changeflow.operators.catalog import TABLE
from changeflow.operators.ordered import (
    block_of,
    explode_ticks,
    next_after,
    next_multiple,
)
from changeflow.operators.progress import backlog_by_second
from changeflow.operators.rows import event_rows
from changeflow.schemas import ROW_ACTIONS

COUNTS = [f"{action}_count" for action in ROW_ACTIONS]

#: Fixed value: samples a metric series keeps.
RETAINED_SAMPLES = 900


def dml_counts(rows):
    """Row messages per table and action. Works on batch and stream."""
    return rows.groupBy(*TABLE).agg(
        *[
            F.count_if(F.col("action") == action).alias(f"{action}_count")
            for action in ROW_ACTIONS
        ]
    )


def delivered_counts(changes, catalog):
    """Row messages per table and action that fit their table's catalog entry.

    Counts inside the event instead of exploding it: no image is copied into a
    row of its own only to be counted. A body too large to send counts as well.
    """
    fitting = F.filter(
        event_rows(),
        lambda r: (F.size(r["new_row"]) == F.col("n_cols"))
        & ((F.col("action") != "update") | (F.size(r["old_row"]) == F.col("n_cols"))),
    )
    per_event = (
        changes.filter(F.col("action").isin(*ROW_ACTIONS))
        .join(catalog.select(*TABLE, "n_cols"), TABLE)
        .select(*TABLE, "action", F.size(fitting).alias("_n"))
    )
    return per_event.groupBy(*TABLE).agg(
        *[
            F.sum(F.when(F.col("action") == action, F.col("_n")).otherwise(0)).alias(
                f"{action}_count"
            )
            for action in ROW_ACTIONS
        ]
    )


def table_report(catalog, counts):
    """Counts for every catalog table, zero where nothing was counted."""
    return (
        catalog.select(*TABLE)
        .join(counts, TABLE, "left")
        .select(*TABLE, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS])
    )


def ddl_report(catalog, ddl_changes):
    """DDL changes per schema, zero for a schema with tables but no DDL."""
    counts = ddl_changes.groupBy("schema_name").agg(F.count("*").alias("ddl_count"))
    return (
        catalog.select("schema_name")
        .distinct()
        .join(counts, "schema_name", "left")
        .select("schema_name", F.coalesce("ddl_count", F.lit(0)).alias("ddl_count"))
    )


def component_state(state_changes):
    """The current state of each component.

    The last change of a second first, then the last second: both aggregates
    have fixed-width buffers and need no sort.
    """
    return (
        state_changes.groupBy("component", "ts_s")
        .agg(F.max_by("state", "seq").alias("state"))
        .groupBy("component")
        .agg(F.max_by("state", "ts_s").alias("state"))
    )


def sample_backlog(queue_events, interval=2, keys=(), keep=None):
    """Queue depth at every sampling time, from the first event to the last.

    With ``keep`` only the newest ``keep`` times of each series are made.

    A depth holds until the next second with an event. The sampling times are
    made from these spans where they lie, not from one list of all times.
    """
    keys = list(keys)
    at_tick = (
        backlog_by_second(queue_events, keys)
        .groupBy(*keys, next_multiple("ts_s", interval).alias("tick_s"))
        .agg(F.max_by("backlog", "ts_s").alias("backlog"))
        .withColumn("_span", block_of("tick_s", 3600 * interval))
    )
    spans = next_after(at_tick, "tick_s", keys, ["tick_s"], ["_span"], "_next")
    until = F.coalesce(F.col("_next") - interval, F.col("tick_s"))
    first = F.col("tick_s")
    if keep is not None:
        newest = queue_events.groupBy(*keys).agg(F.max("ts_s").alias("_newest")).select(
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            (next_multiple("_newest", interval) - (keep - 1) * interval).alias("_oldest"),
        )
        same = [spans[k].eqNullSafe(newest[f"_k_{k}"]) for k in keys] or [F.lit(True)]
        spans = spans.join(newest, same, "left").filter(until >= F.col("_oldest"))
        first = F.greatest(first, F.col("_oldest"))
    return explode_ticks(spans, first, until, interval, "ts_s", [*keys, "backlog"]).select(
        *keys, "ts_s", "backlog"
    )


def newest_samples(samples, keys=(), keep=RETAINED_SAMPLES):
    """The newest samples of each series.

    Spark prunes each task to ``keep`` rows per series before the shuffle.
    """
    newest_first = Window.partitionBy(*keys).orderBy(F.col("ts_s").desc())
    return (
        samples.withColumn("_n", F.row_number().over(newest_first))
        .filter(F.col("_n") <= keep)
        .drop("_n")
    )
