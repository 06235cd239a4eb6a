"""Removal of long repeated strings by anchors and content hashes, in place of bucket-pointer refinement.

A string of ``LENGTH`` bytes is repeated if it starts at two places of the corpus. The places are
dealt into buckets that are refined in three fixed steps, each by hashes of more bytes around the anchor,
and places alone in their bucket drop out; no step looks up the bucket of another offset:

1. q-gram buckets. Every string is represented by the least q-gram in it, its anchor: equal strings
   have the same anchor at the same offset, and neighbouring strings mostly share theirs, so there is
   about one bucket entry for eighty strings. An anchor met once drops out with all its strings.
2. Runs. The strings of one anchor lie in one run of bytes. Runs of one bucket that are equal as a
   whole settle all their strings at once, however many copies there are.
3. Cells. Of buckets with different runs, one run of each kind goes on. It is cut into cells of
   ``CELL`` strings by offset from the anchor; a cell's bucket is the core that all its strings have.
   Cells alone with their core drop out; cores whose cells are all equal are settled.
4. Strings. What is left, the cells at the edges of repeats, is compared string by string.

Identifiers of a step are hashes of the bytes (64 bits), counted by aggregation, so a bucket may hold
a third of all entries. A step passes on which identifiers stay open as a Bloom filter of bounded
size and finds their bytes again; a false hit there only adds true strings to the comparison.
Positions and identifiers travel; texts meet the removed ranges in one join by row.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from changeflow.session import written

from . import bloom
from .tables import row_key
from .words import U, blocks, mix, prefix_sums, range_hashes

LENGTH = 200
GRAM = 32
CELL = 16
SLICE = 4 << 20
PLACE = U((1 << 24) - 1)


def anchors(data, offsets, length=LENGTH, gram=GRAM):
    """Runs of strings that share their least q-gram, over the rows of a block.

    Returns arrays: q-gram hash, row, place of the q-gram, first and last string start of the run (all
    places in ``data``), and the running sums for hashes of its bytes, slice by slice.
    """
    for low in range(0, max(1, len(data) - length + 1), SLICE):
        part = data[low : low + SLICE + length - 1]
        found = _anchors(part, np.clip(offsets - low, 0, len(part)), length, gram)
        if found is not None:
            hashes, row, place, first, last, sums = found
            yield hashes, row, place, first, last, sums, low


def _anchors(data, offsets, length, gram):
    n, width = len(data), length - gram + 1
    if n < length:
        return None
    sums = prefix_sums(data)
    m = n - gram + 1
    start = np.arange(m)
    hashes = range_hashes(sums, start, start + gram)
    # The q-gram's rank above, its place below: the leftmost of equal ones is the least.
    ranked = (mix(hashes) & ~PLACE) | start.astype(U)
    padded = np.full(-(-m // width) * width, ~U(0))
    padded[:m] = ranked
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    starts = np.flatnonzero(np.arange(count) + length <= offsets[1:][row])
    if not len(starts):
        return None
    place = (least[starts] & PLACE).astype(np.int64)
    edge = (np.diff(place) != 0) | (np.diff(starts) != 1)
    first = np.flatnonzero(np.concatenate([[True], edge]))
    last = np.flatnonzero(np.concatenate([edge, [True]]))
    place, first, last = place[first], starts[first], starts[last]
    return hashes[place], row[first], place, first, last, sums


def run_hashes(sums, place, first, last, length):
    """Names of runs: equal for equal bytes around the anchor."""
    shape = (place - first).astype(U) | ((last - first).astype(U) << U(32))
    return mix(range_hashes(sums, first, last + length) ^ mix(shape))


def _grams(length, gram):
    def make(batches):
        for batch in batches:
            for _, data, offsets in blocks(batch.column("text")):
                for hashes, *_ in anchors(data, offsets, length, gram):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], names=["gram"])

    return make


def _runs(length, gram, shared):
    def make(batches):
        for batch in batches:
            keys = batch.column("row_key").to_numpy()
            for at, data, offsets in blocks(batch.column("text")):
                for hashes, row, place, first, last, sums, low in anchors(data, offsets, length, gram):
                    kept = np.flatnonzero(shared.contains(hashes.view(np.int64)))
                    hashes, row, place, first, last = (x[kept] for x in (hashes, row, place, first, last))
                    runs = run_hashes(sums, place, first, last, length)
                    base = offsets[:-1][row] - low
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes.view(np.int64)),
                            pa.array(runs.view(np.int64)),
                            pa.array(keys[at + row]),
                            pa.array((place - base).astype(np.int32)),
                            pa.array((first - base).astype(np.int32)),
                            pa.array((last - base).astype(np.int32)),
                        ],
                        names=["gram", "run", "row_key", "place", "first", "last"],
                    )

    return make


RUNS = "gram long, run long, row_key long, place int, first int, last int"


def _place_key(row_keys, places):
    """One number for a place in a row."""
    return mix(np.asarray(row_keys).view(U) ^ (places.astype(U) * U(0x9E3779B97F4A7C15))).view(np.int64)


def _bytes_of_runs(length, gram, rows, wanted):
    def make(batches):
        for batch in batches:
            keep = rows.contains(batch.column("row_key").to_numpy())
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            keys = batch.column("row_key").to_numpy()
            for at, data, offsets in blocks(batch.column("text")):
                for hashes, row, place, first, last, _, low in anchors(data, offsets, length, gram):
                    base = offsets[:-1][row] - low
                    kept = np.flatnonzero(wanted.contains(_place_key(keys[at + row], place - base)))
                    hashes, row, place, first, last, base = (x[kept] for x in (hashes, row, place, first, last, base))
                    held = [data[low + a : low + b + length].tobytes() for a, b in zip(first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hashes.view(np.int64)),
                            pa.array(keys[at + row]),
                            pa.array((first - base).astype(np.int32)),
                            pa.array((place - first).astype(np.int32)),
                            pa.array(held, pa.binary()),
                        ],
                        names=["gram", "row_key", "first", "lead", "held"],
                    )

    return make


def _cells(batch, length):
    """The cells of a batch of runs: core and whole identifiers, run number, first and last start, sums."""
    gram = batch.column("gram").to_numpy().view(U)
    lead = batch.column("lead").to_numpy().astype(np.int64)
    for at, data, offsets in blocks(batch.column("held")):
        sums = prefix_sums(data)
        run = np.arange(len(offsets) - 1)
        size = np.diff(offsets) - length + 1
        anchor = offsets[:-1] + lead[at + run]
        # Distances from string start to anchor run from lead down; cells are aligned to CELL.
        high, low = lead[at + run], lead[at + run] - size + 1
        n = high // CELL - low // CELL + 1
        of = np.repeat(run, n)
        cell = low[of] // CELL + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        far, near = np.minimum(cell * CELL + CELL - 1, high[of]), np.maximum(cell * CELL, low[of])
        core_from, core_to = anchor[of] - cell * CELL, anchor[of] - cell * CELL - CELL + 1 + length
        core = mix(range_hashes(sums, core_from, core_to) ^ mix(gram[at + of] + cell.astype(U)))
        first, last = anchor[of] - far, anchor[of] - near
        shape = far.astype(U) | (near.astype(U) << U(32))
        whole = mix(range_hashes(sums, first, last + length) ^ mix(shape))
        yield at + of, offsets[:-1][of], core, whole, first, last, sums


def _cell_rows(length):
    def make(batches):
        for batch in batches:
            keys, begin = batch.column("row_key").to_numpy(), batch.column("first").to_numpy().astype(np.int64)
            for of, base, core, whole, first, last, _ in _cells(batch, length):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(keys[of]),
                        pa.array((first - base + begin[of]).astype(np.int32)),
                        pa.array((last - base + begin[of]).astype(np.int32)),
                    ],
                    names=["core", "whole", "row_key", "first", "last"],
                )

    return make


def _string_rows(length, open_cores):
    def make(batches):
        for batch in batches:
            keys, begin = batch.column("row_key").to_numpy(), batch.column("first").to_numpy().astype(np.int64)
            for of, base, core, _, first, last, sums in _cells(batch, length):
                kept = open_cores.contains(core.view(np.int64))
                of, base, first, last = of[kept], base[kept], first[kept], last[kept]
                n = last - first + 1
                cell = np.repeat(np.arange(len(n)), n)
                start = first[cell] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                strings = range_hashes(sums, start, start + length)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(strings.view(np.int64)),
                        pa.array(keys[of[cell]]),
                        pa.array((start - base[cell] + begin[of[cell]]).astype(np.int32)),
                    ],
                    names=["string", "row_key", "start"],
                )

    return make


def repeated_ranges(rows, length=LENGTH, gram=GRAM):
    """``row_key, first, last``: starts of repeated strings, from first to last, in ``rows(row_key, text)``.

    Ranges of a row may overlap.
    """
    text = rows.select("row_key", "text")
    shared = written(
        text.mapInArrow(_grams(length, gram), "gram long").groupBy("gram").count().where("count > 1").select("gram"),
        "shared-grams",
    )
    runs = written(text.mapInArrow(_runs(length, gram, bloom.build(shared, "gram", shared.count())), RUNS), "runs")
    kinds = written(
        runs.groupBy("gram", "run").agg(
            F.count("*").alias("n"), F.min("row_key").alias("row_key"), F.min_by("place", "row_key").alias("place")
        ),
        "run-kinds",
    )
    copied = kinds.where("n > 1").select("gram", "run")
    settled = runs.join(copied, ["gram", "run"], "left_semi").select("row_key", "first", "last")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    going_on = written(
        kinds.join(several, "gram", "left_semi").select("row_key", "place").mapInArrow(
            _with_keys, "row_key long, place_key long"
        ),
        "open-runs",
    )
    number = going_on.count()
    held = written(
        text.mapInArrow(
            _bytes_of_runs(length, gram, bloom.build(going_on, "row_key", number), bloom.build(going_on, "place_key", number)),
            "gram long, row_key long, first int, lead int, held binary",
        ),
        "run-bytes",
    )
    cells = written(
        held.mapInArrow(_cell_rows(length), "core long, whole long, row_key long, first int, last int"), "cells"
    )
    cores = written(
        cells.groupBy("core").agg(F.count("*").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y")).where("n > 1"),
        "cores",
    )
    equal = cores.where("x = y").select("core")
    settled_cells = cells.join(equal, "core", "left_semi").select("row_key", "first", "last")
    unequal = cores.where("x <> y").select("core")
    strings = written(
        held.mapInArrow(
            _string_rows(length, bloom.build(unequal, "core", unequal.count())), "string long, row_key long, start int"
        ),
        "strings",
    )
    twice = strings.groupBy("string").count().where("count > 1").select("string")
    single = strings.join(twice, "string", "left_semi").select("row_key", F.col("start").alias("first"), F.col("start").alias("last"))
    return settled.unionByName(settled_cells).unionByName(single)


def _with_keys(batches):
    for batch in batches:
        rows, places = batch.column(0), batch.column(1).to_numpy().astype(np.int64)
        keys = _place_key(rows.to_numpy(), places)
        yield pa.RecordBatch.from_arrays([rows, pa.array(keys)], names=["row_key", "place_key"])


def _removed(length):
    """Cut the repeated ranges out of each text."""

    def make(batches):
        for batch in batches:
            texts, ranges = batch.column("text"), batch.column("ranges").to_pylist()
            n_bytes, n_removed, n_spans, digests, kept_texts = [], [], [], [], []
            for text, found in zip(texts, ranges):
                raw = text.as_py()
                data = b"" if raw is None else raw
                spans = merged_spans([(r["first"], r["last"] + length) for r in found or []])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                kept = b"".join(kept)
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept))
                n_spans.append(len(spans))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests), pa.array(kept_texts, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return make


def merged_spans(ranges):
    """Maximal runs covered by half-open ranges; those that touch are one."""
    out = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs, length=LENGTH, gram=GRAM):
    """Every row of ``docs`` without the bytes of strings that also start elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes; a cut may fall
    inside a character). Null text counts as empty. Strings are judged on the input and never cross
    rows; a repeated row repeats all strings of the other.
    """
    rows = docs.select(
        docs["doc_id"], row_key(docs).alias("row_key"), docs["text"].cast("string").cast("binary").alias("text")
    )
    ranges = (
        repeated_ranges(rows, length, gram)
        .groupBy(F.col("row_key").alias("ranges_of"))
        .agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    )
    joined = rows.join(ranges, rows["row_key"] == ranges["ranges_of"], "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        _removed(length),
        f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
