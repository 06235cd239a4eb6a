"""Metric series kept by a stream: the newest samples of each, in storage that does not grow with time.

Batches of samples are folded as the catalog's versions are. A batch is cut to the newest samples of each series
before it is written, so a series holds at most ``keep`` samples in the snapshot and in each batch since.
"""

from pyspark.sql import functions as F

from changeflow.operators.reports import RETAINED_SAMPLES, newest_samples
from changeflow.streaming.folding import FOLD_EVERY, add_batch, folded_rows
from changeflow.streaming.runs import run_of


def kept_samples(samples, keys, keep=RETAINED_SAMPLES, live_s=None):
    """The newest ``keep`` samples of each series.

    A time counts once in a series; of several samples of one time the greatest stays, so neither the order
    of batches nor a repeated one matters. Samples more than ``live_s`` seconds older than the newest of all
    series are dropped, and with them a series that has had none since. Samples without a time are dropped.
    """
    values = [c for c in samples.columns if c not in (*keys, "ts_s")]
    if live_s is not None:
        samples = samples.filter(F.col("ts_s") >= samples.agg(F.max("ts_s") - live_s).scalar())
    timed = samples.filter(F.col("ts_s").isNotNull())
    once = timed.groupBy(*keys, "ts_s").agg(F.max(F.struct(*values)).alias("_values"))
    newest = newest_samples(once, keys, keep)
    return newest.select(
        *[F.col(f"_values.{c}").alias(c) if c in values else F.col(c) for c in samples.columns]
    )


def start_series(
    samples, path, checkpoint_location, keys, keep=RETAINED_SAMPLES, live_s=None, interval=None, fold_every=FOLD_EVERY
):
    """Keep the newest samples of each series from a stream of samples; returns the streaming query.

    ``samples`` holds ``keys``, ``ts_s`` and values. ``series_log`` reads what is kept. Late samples count as any
    other while they are among the newest. One stream writes to a path.
    """
    schema = samples.schema

    def fold(rows):
        return kept_samples(rows, keys, keep, live_s)

    def add(batch, batch_id):
        # The newest of all is known to the fold alone.
        newest = kept_samples(batch, keys, keep)
        add_batch(newest, path, batch_id, run_of(batch, checkpoint_location), schema, fold, fold_every)

    writer = samples.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_location)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()


def series_log(spark, path, schema, keys, keep=RETAINED_SAMPLES, live_s=None):
    """The samples kept so far; no rows from a stream that saw none."""
    return kept_samples(folded_rows(spark, path, schema), keys, keep, live_s)
