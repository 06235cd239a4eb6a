"""The rate limit on a stream, with its state in the state store."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from changeflow.operators.greedy import NEVER, Chain

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class PassingSeconds(StatefulProcessor):
    """The seconds of a key in which a row is kept by its distance from the last.

    Seconds arrive once each, and never one before the end of an earlier batch:
    the aggregate ahead releases them by watermark. So the state is the position
    of the last kept row, and a batch only needs sorting.
    """

    def __init__(self, columns, time, gap, strict, start):
        self.columns, self.time = columns, time
        self.gap, self.strict, self.start = gap, strict, start

    def init(self, handle):
        self.last = handle.getValueState(
            "last", T.StructType([T.StructField("at", T.LongType())])
        )

    def handleInputRows(self, key, rows, timerValues):
        seconds = pd.concat(list(rows))
        # Names are set by place: the frames come with renamed ones where a name
        # is not a Python identifier.
        seconds.columns = [*self.columns, "_forced"]
        seconds = seconds.sort_values(self.time, ignore_index=True)
        position = seconds[self.time].to_numpy(np.int64)
        if self.last.exists():
            anchor = self.last.get()[0]
        else:
            anchor = int(position[0]) if self.start == "first" else self.start
        force = seconds["_forced"].to_numpy(bool)
        fired = Chain(position, force, self.gap, self.strict).fired(anchor)
        before = np.searchsorted(fired, np.arange(len(position)))
        distance = position - np.append(anchor, position[fired])[before]
        passes = distance > self.gap if self.strict else distance >= self.gap
        self.last.update((int(position[fired[-1]]) if len(fired) else anchor,))
        yield seconds.loc[passes, self.columns]

    def close(self):
        pass


def throttle_stream(
    events, keys, time, order, gap, strict, delay, start=None, force=None
):
    """``throttle`` on a stream: the same rows, each once its second is past the
    watermark. Rows later than ``delay`` are dropped, as with any watermark, and a key's due
    seconds go through one task; ``start_throttle`` keeps late rows and spreads keys.

    ``time`` is in whole seconds. Only the first row of a second can be kept by
    distance, so an aggregate, combined before the shuffle, reduces each second of
    a key to that row. Forced rows are kept whatever came before them and need no
    state. Needs the RocksDB state store provider.
    """
    marked = events.withColumn("_event_time", F.timestamp_seconds(time)).withWatermark(
        "_event_time", delay
    )
    forced = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)
    seconds = (
        marked.groupBy(*keys, "_event_time")
        .agg(
            F.min_by(F.struct(*events.columns), order).alias("_first"),
            F.bool_or(forced).alias("_forced"),
        )
        .select("_first.*", "_forced")
    )
    passing = seconds.groupBy(*keys).transformWithStateInPandas(
        PassingSeconds(
            events.columns, time, gap, strict, NEVER if start is None else start
        ),
        outputStructType=events.schema,
        outputMode="Append",
        timeMode="None",
    )
    if force is None:
        return passing
    return passing.filter(~F.coalesce(F.col(force), F.lit(False))).unionByName(
        marked.filter(F.col(force)).drop("_event_time")
    )
