"""Joining the change stream with the stream of schema versions, as of each change."""

from pyspark.sql import functions as F

from changeflow.operators.catalog import TABLE, resolve_as_of
from changeflow.schemas import CATALOG_SCHEMA
from changeflow.session import passing_tables
from changeflow.sinks import landed, write_batch
from changeflow.streaming.runs import RunState, run_of

BOTH, CHANGES = "both", "changes"


def start_schema_as_of(
    changes, versions, path, checkpoint_location, time, delay, base=None, follow=BOTH, interval=None
):
    """Start resolving a stream of changes against a stream of schema versions; returns the query.

    Either side may come first: a change waits until all versions of its time are known. The mark of a
    side is its newest ``time`` (whole seconds) less ``delay``; a change is resolved once the marks of both
    sides have passed it. Versions are rare, so ``follow="changes"`` lets the mark follow the changes alone
    where a version is known to come at most ``delay`` after them. ``path/resolved`` gets every change
    that was in time, with ``columns``, ``n_cols`` and ``valid_from`` as the batch operator gives them
    over all versions that were in time; ``path/late`` gets the changes at or before the mark already passed.
    A late version holds for the changes resolved after it has come.

    ``base`` is a table of the versions known at the start. ``time`` must grow with ``seq``: no change
    beyond the mark may be older, by ``seq``, than a version before it.

    Between batches a run keeps the changes that wait, and of the versions those beyond the mark and the
    one in force at it for each table: as many rows as there are tables, and what came within ``delay``.
    A batch is joined by ``resolve_as_of``, so a hot table is spread as it is there.
    """
    names = [*CATALOG_SCHEMA.fieldNames(), time]
    held = versions.select(*names).schema
    tagged = changes.select(F.struct(*changes.columns).alias("_change")).unionByName(
        versions.select(F.struct(*names).alias("_version")), allowMissingColumns=True
    )

    def step(batch, batch_id):
        with passing_tables(batch.sparkSession):
            resolve(batch, batch_id)

    def resolve(batch, batch_id):
        spark, run = batch.sparkSession, run_of(batch, checkpoint_location)
        state = RunState(spark, path, run, batch_id)
        batch = batch.persist()
        try:
            came = batch.filter("_change IS NOT NULL").select("_change.*")
            announced = batch.filter("_version IS NOT NULL").select("_version.*")
            before = state.before("marks", "changes long, versions long, mark long").first() or (None, None, None)
            seen = [
                _largest(before[i], side.agg(F.max(time)).first()[0]) for i, side in enumerate((came, announced))
            ]
            sides = seen[:1] if follow == CHANGES else seen
            mark = before[2] if None in sides else _largest(before[2], min(sides) - delay)
            known = state.before("versions", held).unionByName(announced)
            if base is not None and not batch_id:
                start = base.select(*CATALOG_SCHEMA.fieldNames(), F.lit(None).cast(held[time].dataType).alias(time))
                known = start.unionByName(known)
            is_late = F.lit(False) if before[2] is None else F.coalesce(F.col(time) <= before[2], F.lit(False))
            fresh = state.before("waiting", changes.schema).unionByName(came.filter(~is_late))
            # A change without a time has nothing to wait for.
            is_due = F.col(time).isNull() if mark is None else F.coalesce(F.col(time) <= mark, F.lit(True))
            resolved = resolve_as_of(fresh.filter(is_due), known.drop(time))
            write_batch(resolved, f"{path}/resolved", batch_id, run=run)
            write_batch(came.filter(is_late), f"{path}/late", batch_id, run=run)
            state.leave("waiting", fresh.filter(~is_due))
            state.leave("versions", _in_force(known, time, mark))
            state.leave("marks", spark.createDataFrame([(*seen, mark)], "changes long, versions long, mark long"))
            state.forget(("waiting", "versions", "marks"))
        finally:
            batch.unpersist()

    writer = tagged.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_location)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def _largest(*values):
    return max((v for v in values if v is not None), default=None)


def _in_force(versions, time, mark):
    """Versions beyond the mark, and of each table the newest before it."""
    if mark is None:
        return versions
    passed = F.coalesce(F.col(time) <= mark, F.lit(True))
    newest = (
        versions.filter(passed)
        .groupBy(*TABLE)
        .agg(F.max(F.struct("valid_from", "columns", "n_cols")).alias("_v"), F.max(time).alias(time))
        .select(*TABLE, "_v.columns", "_v.n_cols", "_v.valid_from", time)
    )
    return versions.filter(~passed).unionByName(newest)


def resolved_log(spark, path, schema):
    """All changes resolved so far; ``schema`` is that of the changes."""
    found = spark.createDataFrame([], schema).select(
        "*", *[F.lit(None).cast(CATALOG_SCHEMA[c].dataType).alias(c) for c in ("columns", "n_cols", "valid_from")]
    )
    return landed(spark, f"{path}/resolved", found.schema).select(*found.columns)


def late_changes(spark, path, schema):
    """All changes that came after the mark had passed them."""
    return landed(spark, f"{path}/late", schema).select(*schema.fieldNames())
