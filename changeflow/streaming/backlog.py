"""Queue depth on a stream: sums per second and block, corrected where an older second gets rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators.ordered import block_of, running_total
from changeflow.session import passing_tables, written
from changeflow.sinks import landed, write_batch
from changeflow.streaming.runs import RunState, run_of

#: Place of what came before the open blocks, in front of any block.
_EARLIER = -(1 << 62)
#: Blocks whose totals are added up in one task.
_BLOCKS_AT_ONCE = 4096


def start_backlog(
    queue_events, path, checkpoint_location, keys=(), delay=3600, span=3600, interval=None
):
    """Start ``backlog_by_second`` on a stream; returns the streaming query, ``backlog_log`` reads it.

    The depth at the end of a second is kept as two numbers: the depth in front of its block of ``span``
    seconds, and the running sum inside the block. Rows for an older second change the sums of their own
    block from that second on, and one number for each later block; all other depths stay as written.
    Each batch writes only what it changed, under ``path/within`` and ``path/before``.

    A block closes once a row ``delay`` seconds past its end has come. Rows of a closed block are late: their
    sums per second go to ``path/late`` and count from the first open block on, so the depth does not drift,
    while closed depths stay. Rows without a time count the same way. Rows without a ``delta`` count as 0.

    Rows are summed per key and second before they are shuffled; a hot key is spread over its
    blocks. State is the seconds of the open blocks and one depth per key, so it grows with ``delay`` and the
    number of keys, not with the run. A retried batch replaces its own files. A new checkpoint location starts
    a new count and needs a ``path`` of its own.
    """
    keys = list(keys)
    source = queue_events.schema
    fields = [source[k] for k in keys]
    long = T.LongType()
    seconds_schema = T.StructType([*fields, T.StructField("ts_s", long), T.StructField("delta", long)])
    depth_schema = T.StructType([*fields, T.StructField("backlog", long)])
    before_schema = T.StructType([*fields, T.StructField("block_s", long), T.StructField("before", long)])

    def step(batch, batch_id):
        batch = batch.persist()
        try:
            with passing_tables(batch.sparkSession):
                count(batch, batch_id)
        finally:
            batch.unpersist()

    def count(batch, batch_id):
        spark, run = batch.sparkSession, run_of(batch, checkpoint_location)
        state = RunState(spark, path, run, batch_id)
        mark = state.before("mark", "mark long, open_from long").first()
        newest, open_from = mark or (None, None)
        latest = batch.agg(F.max("ts_s")).first()[0]
        newest = max((t for t in (newest, latest) if t is not None), default=None)

        sums = written(
            batch.groupBy(*keys, F.col("ts_s").cast("bigint").alias("ts_s")).agg(_sum("delta")), "increments"
        )
        is_late = F.col("ts_s").isNull()
        if open_from is not None:
            is_late = is_late | (F.col("ts_s") < open_from)
        late = sums.filter(is_late)
        seconds = written(
            state.before("seconds", seconds_schema)
            .withColumn("_new", F.lit(False))
            .unionByName(sums.filter(~is_late).withColumn("_new", F.lit(True)))
            .groupBy(*keys, "ts_s")
            .agg(_sum("delta"), F.max("_new").alias("_new"))
            .withColumn("block_s", block_of("ts_s", span)),
            "seconds",
        )
        settled = state.before("settled", depth_schema).unionByName(
            late.select(*keys, F.col("delta").alias("backlog"))
        )

        so_far = Window.partitionBy(*keys, "block_s").orderBy("ts_s")
        within = seconds.withColumns(
            {"within": F.sum("delta").over(so_far), "_changed": F.max("_new").over(so_far)}
        )
        before = written(_before(seconds, settled, keys, span), "before")
        known = state.before("before", before_schema).withColumnsRenamed(
            {c: f"_known_{c}" for c in before_schema.fieldNames()}
        )
        same = [before[c].eqNullSafe(known[f"_known_{c}"]) for c in before_schema.fieldNames()]
        outputs = {
            "within": within.filter("_changed").select(*keys, "block_s", "ts_s", "within"),
            "before": before.join(known, same, "left_anti"),
            "late": late,
        }
        for name, rows in outputs.items():
            write_batch(
                rows.withColumn("version", F.lit(batch_id).cast("bigint")), f"{path}/{name}", batch_id, run=run
            )

        if newest is not None:
            closed = newest - delay - (newest - delay) % span
            open_from = closed if open_from is None else max(open_from, closed)
        done = F.lit(False) if open_from is None else F.col("ts_s") < open_from
        state.leave("seconds", seconds.filter(~done).select(*keys, "ts_s", "delta"))
        state.leave(
            "settled",
            settled.unionByName(seconds.filter(done).select(*keys, F.col("delta").alias("backlog")))
            .groupBy(*keys)
            .agg(_sum("backlog")),
        )
        state.leave("before", before if open_from is None else before.filter(F.col("block_s") >= open_from))
        state.leave("mark", spark.createDataFrame([(newest, open_from)], "mark long, open_from long"))
        state.forget(("seconds", "settled", "before", "mark"))

    writer = queue_events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_location)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def _sum(column):
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias(column)


def _before(seconds, settled, keys, span):
    """The depth in front of each open block: what is settled and the totals of the blocks before it."""
    totals = (
        seconds.groupBy(*keys, "block_s")
        .agg(_sum("delta"))
        .unionByName(
            settled.groupBy(*keys).agg(_sum("backlog")).select(
                *keys, F.lit(_EARLIER).cast("bigint").alias("block_s"), F.col("backlog").alias("delta")
            )
        )
        .withColumn("_wide", block_of("block_s", span * _BLOCKS_AT_ONCE))
    )
    return (
        running_total(totals, "delta", keys, ["block_s"], ["_wide"], "_upto")
        .filter(F.col("block_s") != _EARLIER)
        .select(*keys, "block_s", (F.col("_upto") - F.col("delta")).cast("bigint").alias("before"))
    )


def backlog_log(spark, path, schema, keys=()):
    """Queue depth at the end of each second that saw an event, as it stands after the last batch.

    ``schema`` is that of the queue events. The newest sums win, by aggregates that combine before the shuffle.
    """
    keys, fields = list(keys), [schema[k] for k in keys]
    long = T.LongType()

    def newest(name, place, value):
        stored = T.StructType([*fields, *[T.StructField(c, long) for c in (*place, value, "version")]])
        return landed(spark, f"{path}/{name}", stored).groupBy(*keys, *place).agg(
            F.max_by(value, "version").alias(value)
        )

    within = newest("within", ["block_s", "ts_s"], "within")
    before = newest("before", ["block_s"], "before")
    on = [within[c].eqNullSafe(before[c]) for c in [*keys, "block_s"]]
    return within.join(before, on).select(
        *[within[k] for k in keys], "ts_s", (F.col("before") + F.col("within")).alias("backlog")
    )


def late_deltas(spark, path, schema, keys=()):
    """The sums of late rows, per key, second and batch."""
    fields = [schema[k] for k in keys]
    stored = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("ts_s", "delta", "version")]])
    return landed(spark, f"{path}/late", stored).select(*keys, "ts_s", "delta")
