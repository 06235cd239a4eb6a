"""The rate limit on a stream, batch by batch, with nothing lost and no key in one task."""

from pyspark.sql import functions as F

from changeflow.operators.throttle import throttle
from changeflow.session import passing_tables
from changeflow.sinks import landed, write_batch
from changeflow.streaming.runs import RunState, run_of

_CARRIED = "_carried"


def start_throttle(
    events, path, checkpoint_location, keys, time, order, gap, strict, delay, start=None,
    force=None, succeeded=None, interval=None,
):
    """Start ``throttle`` on a stream; returns the streaming query.

    A row's second is decided once a row at least ``delay`` seconds later has come; until then
    the row waits. Rows of a second that is decided already are late: they are written to
    ``path/late``, forced or not, and change no decision. ``path/kept`` gets the rows kept. The
    kept rows are those of the batch operator over all rows that were not late.

    Each batch runs the batch operator's scan over what became due, cut into chunks, so a hot key
    is spread over tasks. Between batches a run keeps, per batch, the waiting rows and each key's
    last anchor, under ``path/state``; a retried batch starts from the state of the one before
    and replaces its own files, and older state is removed.
    """
    schema = events.schema

    def step(batch, batch_id):
        with passing_tables(batch.sparkSession):
            decide(batch, batch_id)

    def decide(batch, batch_id):
        spark, run = batch.sparkSession, run_of(batch, checkpoint_location)
        state = RunState(spark, path, run, batch_id)
        batch = batch.persist()
        try:
            newest = batch.agg(F.max(time)).first()[0]
            mark, waiting, anchors = None, None, None
            if batch_id:
                mark = state.before("mark", "mark long").first()[0]
                waiting = state.before("waiting", schema)
                anchors = state.before("anchors", anchor_schema)
            known = [x for x in (mark, None if newest is None else newest - delay) if x is not None]
            due_at = max(known, default=None)
            is_late = F.lit(False) if mark is None else F.col(time) <= mark
            fresh = batch.filter(~is_late)
            if waiting is not None:
                fresh = waiting.unionByName(fresh)
            is_due = F.lit(False) if due_at is None else F.col(time) <= due_at
            due = fresh.filter(is_due).withColumn(_CARRIED, F.lit(False))
            if anchors is not None:
                carried = anchors.select(*keys, F.col("_at").alias(time)).withColumns(
                    {order: F.lit(0).cast(schema[order].dataType), _CARRIED: F.lit(True)}
                )
                if succeeded:
                    carried = carried.withColumn(succeeded, F.lit(True))
                due = due.unionByName(carried, allowMissingColumns=True)
            if force:
                # A carried anchor counts as forced: it was kept before, whatever the reason.
                due = due.withColumn("_force", F.coalesce(F.col(force), F.lit(False)) | F.col(_CARRIED))
            kept = throttle(
                due, keys, time, order, gap, strict, start=start,
                force="_force" if force else None, succeeded=succeeded,
            )
            moving = F.coalesce(F.col(succeeded), F.lit(False)) if succeeded else F.lit(True)
            last = kept.groupBy(*keys).agg(F.max(F.when(moving, F.col(time))).alias("_at"))
            if start == "first":
                first = due.groupBy(*keys).agg(F.min(time).alias("_first"))
                on = [first[k].eqNullSafe(last[k]) for k in keys]
                last = first.join(last, on, "left").select(
                    *[first[k] for k in keys], F.coalesce("_at", "_first").alias("_at")
                )
            outputs = {
                "kept": kept.filter(~F.col(_CARRIED)).select(*schema.fieldNames()),
                "late": batch.filter(is_late),
            }
            for name, rows in outputs.items():
                write_batch(rows, f"{path}/{name}", batch_id, run=run)
            state.leave("waiting", fresh.filter(~is_due))
            state.leave("anchors", last.filter("_at IS NOT NULL"))
            state.leave("mark", spark.range(1).select(F.lit(due_at).cast("bigint").alias("mark")))
            state.forget(("waiting", "anchors", "mark"))
        finally:
            batch.unpersist()

    anchor_schema = events.select(*keys, F.col(time).alias("_at")).schema
    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_location)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def kept_log(spark, path, schema):
    """All rows kept so far."""
    return landed(spark, f"{path}/kept", schema).select(*schema.fieldNames())


def late_log(spark, path, schema):
    """All rows that came after their second was decided."""
    return landed(spark, f"{path}/late", schema).select(*schema.fieldNames())
