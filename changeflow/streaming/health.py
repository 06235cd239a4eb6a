"""Health checks on a stream: event-time timers that fire whether or not a state has changed."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from changeflow.operators.alerts import HEALTH_PERIOD
from changeflow.operators.ordered import next_multiple
from changeflow.session import ROCKSDB_PROVIDER
from changeflow.sinks import landed, write_batch
from changeflow.streaming.runs import run_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WATCHED = ("canal", "endpoint")
ALERTS = "ts_s long, canal_state int, endpoint_state int"
#: Alerts in one frame, so that a long span of them is never held at once.
ALERTS_AT_ONCE = 100_000
_CURRENT = T.StructType(
    [T.StructField("next_s", T.LongType()), T.StructField("canal", T.IntegerType()), T.StructField("endpoint", T.IntegerType())]
)


class HealthChecks(StatefulProcessor):
    """The checks of one monitored relay that find a component down.

    Rows are checks that a state has changed before, one each, and come when the watermark has reached them: the
    aggregate ahead holds them until then. All checks up to the watermark are made at once. While a component is
    down a timer stands at the very next one, so that it is made though no state changes.
    """

    def __init__(self, period, keyed=False):
        self.period, self.keyed = period, keyed

    def init(self, handle):
        self.handle = handle
        self.current = handle.getValueState("current", _CURRENT)

    def handleInputRows(self, key, rows, timerValues):
        parts = [_packed(part) for part in rows]
        changed = np.concatenate(parts)
        parts.clear()
        changed.sort(order="tick")
        return self._advance(key, changed, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._advance(key, np.empty(0, _CHANGED), timerValues)

    def _advance(self, key, changed, timerValues):
        """Make the checks up to the watermark, given those before which a state has changed."""
        upto = timerValues.getCurrentWatermarkInMs() // 1000
        if self.current.exists():
            at, *before = self.current.get()
        else:
            at, before = int(changed["tick"][0]), [0, 0]
        # A state holds from its check up to the next one that a state has changed before.
        starts = np.append(at, changed["tick"])
        ends = np.append(changed["tick"], max(at, at + ((upto - at) // self.period + 1) * self.period))
        states = [_filled(first, changed[c], changed[f"has_{c}"]) for first, c in zip(before, WATCHED)]
        self.current.update((int(ends[-1]), *(int(s[-1]) for s in states)))
        if any(s[-1] == 0 for s in states):
            # A timer fires once the watermark is past it, and a check is due when the watermark reaches it.
            self.handle.registerTimer(int(ends[-1]) * 1000 - 1)
        down = (states[0] == 0) | (states[1] == 0)
        return self._alerts(key, starts[down], ends[down], [s[down] for s in states])

    def _alerts(self, key, starts, ends, states):
        upto = np.cumsum((ends - starts) // self.period)
        for first in range(0, int(upto[-1]) if len(upto) else 0, ALERTS_AT_ONCE):
            number = np.arange(first, min(first + ALERTS_AT_ONCE, int(upto[-1])))
            span = np.searchsorted(upto, number, side="right")
            ticks = ends[span] - (upto[span] - number) * self.period
            found = pd.DataFrame({"ts_s": ticks, "canal_state": states[0][span], "endpoint_state": states[1][span]})
            if self.keyed:
                found.insert(0, "relay", key[0])
            yield found

    def close(self):
        pass


_CHANGED = np.dtype(
    [("tick", np.int64), *((c, np.int32) for c in WATCHED), *((f"has_{c}", np.bool_) for c in WATCHED)]
)


def _packed(part):
    """Checks of a frame in 18 bytes each; a component without a change has none of its own."""
    packed = np.empty(len(part), _CHANGED)
    packed["tick"] = part["tick_s"].to_numpy(np.int64)
    for c in WATCHED:
        packed[f"has_{c}"] = part[c].notna().to_numpy()
        packed[c] = part[c].fillna(0).to_numpy(np.int32)
    return packed


def _filled(first, values, changed):
    """The state before all checks and after each: of those without a change, that of the one before."""
    last = np.maximum.accumulate(np.where(changed, np.arange(1, len(values) + 1), 0), dtype=np.int64)
    return np.append(np.int32(first), values)[np.append(0, last)]


def start_health(state_changes, path, checkpoint_location, period=HEALTH_PERIOD, delay=None, key=None, interval=None):
    """Start ``health_alerts`` on a stream; returns the streaming query, ``path`` gets the alerts.

    Checks run from the first state change on as the watermark moves, which is the newest change's check
    less ``delay`` (one period unless given); the same checks as of the batch operator, and further ones when
    time goes on without a change of state. A change whose check has been made is late and dropped, as
    with any watermark, so its component keeps the state before it until its next change: choose ``delay``
    for the lateness that occurs. ``key`` names a column that tells monitored relays apart: each has checks of its own, and alerts
    carry its value as text in ``relay``.

    An aggregate, combined before the shuffle, shrinks the changes between two checks to one row and releases it
    by watermark. So Python sees one row per check, and a relay's state is one row per check within ``delay`` and
    one more.
    """
    keyed = state_changes.filter(F.col("component").isin(*WATCHED) & F.col("ts_s").isNotNull()).select(
        (F.col(key) if key else F.lit("")).cast("string").alias("relay"),
        "component", "ts_s", "seq", F.col("state").cast("int").alias("state"),
        next_multiple("ts_s", period).alias("tick_s"),
    )

    def last_state(component):
        # Of several changes before one check the last counts.
        return F.max(F.when(F.col("component") == component, F.struct("ts_s", "seq", "state")))["state"].alias(component)

    delay = f"{period} seconds" if delay is None else delay
    timed = keyed.withColumn("_tick", F.timestamp_seconds("tick_s")).withWatermark("_tick", delay)
    checks = timed.groupBy("relay", "_tick").agg(*map(last_state, WATCHED)).withColumn("tick_s", F.unix_seconds("_tick"))
    alerts = checks.groupBy("relay").transformWithStateInPandas(
        HealthChecks(period, keyed=key is not None),
        outputStructType=f"relay string, {ALERTS}" if key else ALERTS,
        outputMode="Append", timeMode="EventTime",
    )

    def add(batch, batch_id):
        write_batch(batch, path_of(path), batch_id, run=run_of(batch, checkpoint_location))

    writer = alerts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return _started(state_changes.sparkSession, writer)


def _started(spark, writer):
    """Start with the state store that timers need; other queries keep theirs."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB_PROVIDER)
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)


def path_of(path):
    return f"{path}/alerts"


def health_log(spark, path, key=False):
    """All checks so far that found a component down."""
    schema = f"relay string, {ALERTS}" if key else ALERTS
    names = [c.split()[0] for c in schema.split(", ")]
    return landed(spark, path_of(path), schema).select(*names)
