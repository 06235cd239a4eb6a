"""Keep-or-skip decisions that depend on the last kept row, in parallel.

Checkpoint throttle, alert silence and micro-batching are the same scan: walk
the rows of a key by position, and *fire* at a row when its distance from the
anchor (the position of the last fired row) reaches a gap, or when the row
forces it. Each decision needs the one before, yet a key need not go through
one task. A chunk of rows turns every possible incoming anchor into an outgoing
one, and only anchors less than a gap before the chunk make a difference, so
the chunk is summed up by a short step function. Three passes give the exact
result: sum up all chunks in parallel, chain the summaries, replay all chunks
in parallel with their known incoming anchor.
"""

import sys
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for "never fired": farther back than any gap reaches.
NEVER = -(1 << 62)

#: Points of a key a task takes at a time.
CHUNK_ROWS = 1 << 18

_GROUP, _CHUNK = "_group", "_chunk"

# Tasks get these functions with the plan; executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Chain:
    """The scan inside one chunk of positions sorted in ascending order."""

    def __init__(self, position, force, gap, strict):
        self.position = position
        self.threshold = position - gap
        self.side = "right" if strict else "left"
        size = len(position)
        self.forced = np.flatnonzero(force)
        reach = self._entry_by_gap(position)
        following = np.arange(1, size + 1)
        next_forced = np.append(self.forced, size)[
            np.searchsorted(self.forced, following)
        ]
        self.following = np.minimum(np.maximum(reach, following), next_forced)

    def _entry_by_gap(self, anchors):
        return np.searchsorted(self.threshold, anchors, side=self.side)

    def entry(self, anchor):
        """Index of the first row to fire, given the incoming anchor."""
        first_forced = self.forced[0] if len(self.forced) else len(self.position)
        return int(min(self._entry_by_gap(anchor), first_forced))

    def fired(self, anchor):
        """Indexes of all rows that fire, given the incoming anchor."""
        found, at = [], self.entry(anchor)
        following, size = self.following.tolist(), len(self.position)
        while at < size:
            found.append(at)
            at = following[at]
        return np.array(found, dtype=np.int64)

    def steps(self, latest_anchor):
        """``(threshold, outgoing anchor, fires)`` for each row that can be the
        first to fire when the incoming anchor is at most ``latest_anchor``."""
        size = len(self.position)
        last = min(self.entry(latest_anchor), size - 1)
        end, fires = list(range(size)), [1] * size
        following = self.following.tolist()
        for i in range(size - 1, -1, -1):
            after = following[i]
            if after < size:
                end[i], fires[i] = end[after], fires[after] + 1
        rows = np.arange(last + 1)
        # Of rows at one position only the first can be entered by distance.
        first = np.append(True, self.threshold[1 : last + 1] != self.threshold[:last])
        first |= np.isin(rows, self.forced[:1])
        rows = rows[first]
        thresholds = self.threshold[rows].copy()
        if len(self.forced) and self.forced[0] <= last:
            thresholds[rows == self.forced[0]] = -NEVER
            rows, thresholds = rows[rows <= self.forced[0]], thresholds[rows <= self.forced[0]]
        outs, counts = self.position[end][rows], np.array(fires)[rows]
        # Entries that end alike are one step, up to the last one's threshold.
        last_of_run = np.append((np.diff(outs) != 0) | (np.diff(counts) != 0), True)
        return thresholds[last_of_run], outs[last_of_run], counts[last_of_run]


def _in_order(chunk, order, relative):
    chunk = chunk.sort_by([(c, "ascending") for c in order])
    values = chunk["_x"].to_numpy()
    position = np.cumsum(values) if relative else values
    return chunk, position, chunk["_force"].to_numpy(), np.flatnonzero(chunk["_moves"].to_numpy())


def _summarise(chunk, order, gap, strict, relative, start):
    """One row per chunk: the step function from incoming to outgoing anchor."""
    chunk, position, force, moving = _in_order(chunk, order, relative)
    thresholds = outs = fires = np.array([], dtype=np.int64)
    if len(moving):
        latest = 0 if relative else position[moving[0]]
        if start != "first":
            latest = max(latest, start)
        chain = Chain(position[moving], force[moving], gap, strict)
        thresholds, outs, fires = chain.steps(latest)
    longs = pa.list_(pa.int64())
    return pa.table(
        {
            _GROUP: chunk[_GROUP].slice(0, 1),
            _CHUNK: chunk[_CHUNK].slice(0, 1),
            "first_x": pa.array([position[0]], pa.int64()),
            "span": pa.array([position[-1] if relative else 0], pa.int64()),
            "thresholds": pa.array([thresholds], longs),
            "outs": pa.array([outs], longs),
            "fires": pa.array([fires], longs),
        }
    )


def _chain_summaries(batches, start, strict):
    """Carry anchor and count through the summaries; state is two numbers."""
    find = bisect_right if strict else bisect_left
    group = anchor = count = None
    for batch in batches:
        anchors, counts = [], []
        for i in range(batch.num_rows):
            # One summary at a time: its lists may be as long as the gap.
            row = batch.slice(i, 1).to_pylist()[0]
            if row[_GROUP] != group:
                group, count = row[_GROUP], 0
                anchor = row["first_x"] if start == "first" else start
            anchors.append(anchor)
            counts.append(count)
            entered = find(row["thresholds"], anchor)
            if entered < len(row["thresholds"]):
                anchor = row["outs"][entered]
                count += row["fires"][entered]
            if anchor != NEVER:
                anchor -= row["span"]
        yield pa.RecordBatch.from_arrays(
            [batch[_GROUP], batch[_CHUNK], pa.array(anchors, pa.int64()), pa.array(counts, pa.int64())],
            names=[_GROUP, _CHUNK, "_anchor", "_count"],
        )


def _replay(chunk, carry, order, gap, strict, relative, columns):
    chunk, position, force, moving = _in_order(chunk, order, relative)
    anchor = carry["_anchor"][0].as_py()
    fires = np.zeros(len(position), dtype=bool)
    if len(moving):
        chain = Chain(position[moving], force[moving], gap, strict)
        fires[moving[chain.fired(anchor)]] = True
    before = np.cumsum(fires) - fires
    # A row that does not move the anchor is tested against the last one that did.
    distance = position - np.append(anchor, position[fires])[before]
    passes = distance > gap if strict else distance >= gap
    return (
        chunk.select(columns)
        .append_column("passes", pa.array(passes))
        .append_column("fired_before", pa.array(carry["_count"][0].as_py() + before, pa.int64()))
    )


def greedy_scan(
    points, keys, order, chunk, gap, strict, position=None, weight=None,
    force=None, moves=None, start=None,
):
    """Add ``passes`` and ``fired_before`` to each point.

    ``position`` is an integer column that grows along ``order``; or ``weight``,
    whose running sum is the position, with the anchor starting at zero.
    ``passes`` says the distance from the anchor reaches ``gap`` (exceeds it if
    ``strict``). A point fires when it passes or ``force`` is set, and then
    becomes the anchor unless ``moves`` is false. ``fired_before`` counts the
    anchors set before the point. ``start`` is the anchor before the first
    point: a position, ``"first"`` for the first point's own, or none (the
    first point passes).

    ``chunk`` is a column that grows along ``order`` and bounds the points that
    share a key and a chunk. It sets the parallelism and the memory of a task.
    """
    if gap <= 0:
        raise ValueError("gap must be positive")
    relative = weight is not None
    if start is None:
        start = 0 if relative else NEVER
    columns = points.columns
    true, false = F.lit(True), F.lit(False)
    prepared = (
        points.withColumn(_GROUP, F.struct(*keys) if keys else F.struct(F.lit(0)))
        .withColumn(_CHUNK, F.col(chunk).cast("bigint"))
        .withColumn("_x", F.col(weight if relative else position).cast("bigint"))
        .withColumn("_force", F.coalesce(F.col(force), false) if force else false)
        .withColumn("_moves", F.coalesce(F.col(moves), false) if moves else true)
    )
    label = [_GROUP, _CHUNK]

    def with_label(*fields):
        return T.StructType(
            [prepared.schema[name] for name in label]
            + [T.StructField(name, kind) for name, kind in fields]
        )

    long, longs = T.LongType(), T.ArrayType(T.LongType())
    summary_type = with_label(
        ("first_x", long), ("span", long), ("thresholds", longs), ("outs", longs), ("fires", longs)
    )
    carry_type = with_label(("_anchor", long), ("_count", long))
    result_type = T.StructType(
        points.schema.fields
        + [T.StructField("passes", T.BooleanType()), T.StructField("fired_before", long)]
    )

    # Both passes over the points group by the same columns of the same plan, so
    # the second one reuses the shuffle of the first.
    summaries = prepared.groupBy(*label).applyInArrow(
        lambda chunk: _summarise(chunk, order, gap, strict, relative, start), summary_type
    )
    carries = (
        summaries.repartition(_GROUP)
        .sortWithinPartitions(*label)
        .mapInArrow(lambda batches: _chain_summaries(batches, start, strict), carry_type)
    )
    return (
        prepared.groupBy(*label)
        .cogroup(carries.groupBy(*label))
        .applyInArrow(
            lambda chunk, carry: _replay(chunk, carry, order, gap, strict, relative, columns),
            result_type,
        )
    )
