"""Removal of repeated windows of words, found by level-wise doubling.

A window of ``length`` words can only occur twice if the pieces in it do. So short pieces are counted
first, and only those met twice are extended to pieces of twice the length, which are counted in turn,
until they have the length of a window or no candidate survives:

1. Every window is represented by the least of its shortest pieces (5 of 20 words), so that neighbouring
   windows mostly share theirs: about one piece in seven words is counted.
2. A piece met twice is extended to twice its length, to the right of it where that stays inside the
   window and else to the left: two pieces at most for all windows that share it.
3. At the full length each surviving window is named by a hash of its words, and an aggregation finds the
   first document that holds it. All other places of a surviving window are removed. A window that is
   nowhere else is its own first and stays, so false survivors cost time and change nothing.

Counts are combined before each shuffle and no step gathers the places of a window, so one passage may
fill a third of the corpus. Pieces met twice reach the next level as a Bloom filter of bounded size;
with more pieces than it is meant for, more windows reach the last level. Texts are read again at each
level and shuffled once at the end, to meet the list of windows they hold first.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F

from changeflow.session import written

from . import bloom
from .tables import row_key
from .words import SPACES, U, blocks, byte_set, cut, mix, prefix_sums, range_hashes, word_hashes

LENGTH = 20
SHORTEST = 4
#: Words that are searched at once.
SLICE = 1 << 20
PLACE = U((1 << 24) - 1)
NOT_SPACE = byte_set(SPACES, inverted=True)


def levels(length, shortest=SHORTEST):
    """Lengths of the pieces that are counted before windows: halves of halves, the shortest first."""
    out = []
    while length // 2 >= shortest:
        length //= 2
        out.insert(0, length)
    return out or [length]


def windows(hashes, first, length, base):
    """Windows over the words of a block, and the place of each one's least piece of ``base`` words.

    Yields per slice: its first word, running sums of its words, and start, place and row of each window
    (start and place counted from the slice's first word).
    """
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for low in range(0, len(hashes) - length + 1, SLICE):
        part = hashes[low : low + SLICE + length - 1]
        n, width = len(part), length - base + 1
        sums = prefix_sums(np.arange(n), part)
        m = n - base + 1
        at = np.arange(m)
        # The piece's rank above, its place below: the leftmost of equal ones is the least.
        ranked = (mix(range_hashes(sums, at, at + base)) & ~PLACE) | at.astype(U)
        padded = np.full(-(-m // width) * width, ~U(0))
        padded[:m] = ranked
        padded = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - length + 1
        least = np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])
        row = row_of[low : low + count]
        start = np.flatnonzero(np.arange(low, low + count) + length <= first[1:][row])
        if len(start):
            yield low, sums, start, (least[start] & PLACE).astype(np.int64), row[start]


def piece_starts(start, place, size, length, base):
    """Where the piece of ``size`` words of each window starts: at its least piece, or so that it ends with it."""
    return np.where(place + size <= start + length, place, place + base - size)


def survivors(hashes, first, length, filters, base):
    """The windows whose pieces were all met twice, by slices as ``windows`` gives them."""
    for low, sums, start, place, row in windows(hashes, first, length, base):
        for size, met_twice in filters:
            pieces, back = np.unique(piece_starts(start, place, size, length, base), return_inverse=True)
            keep = met_twice.contains(range_hashes(sums, pieces, pieces + size).view(np.int64))[back]
            start, place, row = start[keep], place[keep], row[keep]
        if len(start):
            yield low, sums, start, place, row


def words_of(text):
    """Blocks of a text column: first row, bytes, starts and ends of words, first word of each row, word hashes."""
    for at, data, offsets in blocks(text):
        starts, ends, first = cut(data, offsets, NOT_SPACE)
        yield at, data, starts, ends, first, word_hashes(data, starts, ends, fold=False)


def _pieces(size, length, filters, base):
    def counted(batches):
        for batch in batches:
            for _, _, _, _, first, hashes in words_of(batch.column("text")):
                for _, sums, start, place, _ in survivors(hashes, first, length, filters, base):
                    pieces = np.unique(piece_starts(start, place, size, length, base))
                    found, n = np.unique(range_hashes(sums, pieces, pieces + size), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["piece", "n"])

    return counted


def block_windows(hashes, first, length, filters, base):
    """Start, row and hash of every surviving window of a block, and whether it is the first such in its row."""
    found = [
        (low + start, row, range_hashes(sums, start, start + length))
        for low, sums, start, _, row in survivors(hashes, first, length, filters, base)
    ]
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool))
    start, row, name = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, name, row))
    again = np.zeros(len(order), bool)
    again[1:] = (row[order][1:] == row[order][:-1]) & (name[order][1:] == name[order][:-1])
    fresh = np.empty(len(order), bool)
    fresh[order] = ~again
    return start, row, name, fresh


def _named(length, filters, base):
    def made(batches):
        for batch in batches:
            ids, keys = batch.column("place_id").to_numpy(), batch.column("row_key").to_numpy()
            for at, _, _, _, first, hashes in words_of(batch.column("text")):
                _, row, name, fresh = block_windows(hashes, first, length, filters, base)
                row, name = at + row[fresh], name[fresh]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(ids[row]), pa.array(keys[row])],
                    names=["window", "place_id", "row_key"],
                )

    return made


def piece_filters(text, length=LENGTH, shortest=SHORTEST):
    """A filter per level over the pieces met twice; None where a level has no survivor."""
    sizes, filters = levels(length, shortest), []
    for size in sizes:
        counted = text.mapInArrow(_pieces(size, length, filters, sizes[0]), "piece long, n long")
        twice = written(counted.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").select("piece"), f"pieces-{size}")
        number = twice.count()
        if not number:
            return None
        filters = [*filters, (size, bloom.build(twice, "piece", number))]
    return filters


def _joined(data, starts, ends, kept, first):
    """The kept words of each row, joined by one blank."""
    index = np.flatnonzero(kept)
    size = ends[index] - starts[index] + 1
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(at[-1]) + np.repeat(starts[index] - at[:-1], size)
    out = data[np.minimum(source, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = 0x20
    bounds = at[np.searchsorted(index, first)]
    out = out.tobytes()
    return [out[a : b - 1] if b > a else b"" for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _removed(length, filters, base):
    """Cut the windows that start earlier elsewhere out of each text."""

    def made(batches):
        for batch in batches:
            own, of = batch.column("own"), None
            if filters:
                of, own = pc.list_parent_indices(own).to_numpy(), pc.list_flatten(own).to_numpy().view(U)
            for at, data, starts, ends, first, hashes in words_of(batch.column("text")):
                rows = len(first) - 1
                covered = np.zeros(len(hashes) + 1, np.int64)
                if filters:
                    start, row, name, fresh = block_windows(hashes, first, length, filters, base)
                    a, b = np.searchsorted(of, [at, at + rows])
                    stays = fresh & np.isin(_in_row(name, row), _in_row(own[a:b], of[a:b] - at))
                    gone = start[~stays]
                    covered[gone] += 1
                    covered[gone + length] -= 1
                kept = np.cumsum(covered[:-1]) == 0
                texts = _joined(data, starts, ends, kept, first)
                n_words = np.diff(first)
                held = np.concatenate([[0], np.cumsum(kept)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, rows),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(n_words - (held[first[1:]] - held[first[:-1]])),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array(texts, pa.binary()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return made


def _in_row(name, row):
    return mix(name ^ mix(row.astype(U)))


def remove_repeats(docs, length=LENGTH, shortest=SHORTEST):
    """Every row of ``docs`` without the words of windows that start earlier.

    Returns doc_id, n_words, n_removed, kept_sha256, kept (the remaining words joined by one blank, UTF-8
    bytes). Earlier is a smaller id, or the same row further left; windows are judged on the input. Null
    and blank texts have no words. A null id takes a place of its own from the row's hash, among the
    largest ids. Different rows that share an id are ordered by their hash; rows equal in id and text
    count as one, of which every copy is cut alike. Columns beside doc_id and text are not read, whatever
    their names; an empty table gives no rows. A very long text is searched in slices of ``SLICE`` words.
    """
    key = row_key(docs)
    late = F.lit(2**62).cast("long").bitwiseOR(key.bitwiseAND(F.lit(2**62 - 1)))
    rows = docs.select(
        docs["doc_id"],
        F.coalesce(docs["doc_id"].cast("long"), late).alias("place_id"),
        key.alias("row_key"),
        docs["text"].cast("string").cast("binary").alias("text"),
    )
    base = levels(length, shortest)[0]
    filters = piece_filters(rows.select("text"), length, shortest)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary"
    if filters is None:
        bare = rows.select("doc_id", "text", F.lit(None).cast("array<long>").alias("own"))
        return bare.mapInArrow(_removed(length, None, base), schema)
    named = rows.select("place_id", "row_key", "text").mapInArrow(
        _named(length, filters, base), "window long, place_id long, row_key long"
    )
    first = named.groupBy("window").agg(F.min(F.struct("place_id", "row_key")).alias("first"))
    own = written(
        first.groupBy(F.col("first.row_key").alias("own_row")).agg(F.collect_list("window").alias("own")), "own-windows"
    )
    joined = rows.join(own, rows["row_key"] == own["own_row"], "left").select("doc_id", "text", "own")
    return joined.mapInArrow(_removed(length, filters, base), schema)
