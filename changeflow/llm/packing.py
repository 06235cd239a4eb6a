"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents are cut into pieces of at most the largest capacity. Pieces are dealt by hash into groups
of bounded size; those equal in id, place and length are counted and dealt in short runs, so that an id which
repeats, or is missing, in a third of all rows fills no group. Each group is packed on its own: longest piece first, into the open bin with
the least room that still takes it. Where none does, a bin is opened at the capacity that costs
least per token it is expected to hold: for every capacity the room behind the piece is filled on
paper with the longest remaining pieces that fit, so the capacities compete with the pieces that are
really left. At the end each bin is downsized to the smallest capacity that holds its contents.

The groups make packing a shuffle of (id, length) pairs; texts never move. What a group loses
against one large packing is a fraction of its last few bins.
"""

import bisect
import math

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F

from changeflow.operators.ordered import explode_ticks
from changeflow.session import written

from .feistel import token_counts
from .tables import WORD, text_of

CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 64
GROUP_PIECES = 8192
#: Pieces equal in id, place and length are dealt in runs of so many.
EQUAL_PIECES = 64

PACKED = (
    "doc_id long, piece int, piece_start long, n_tokens int, bin_id string, "
    "bin_offset int, bin_used int, bin_capacity int"
)


def expected_fill(length, capacity, lengths, left):
    """Tokens a new bin would hold if ``length`` went in with the longest pieces that then fit.

    ``lengths`` ascends; the first ``left`` of them are not placed yet. Equal lengths are taken in one
    step, so there are at most about sqrt(2 * capacity) steps.
    """
    room = capacity - length
    while left := bisect.bisect_right(lengths, room, 0, left):
        longest = lengths[left - 1]
        equal = left - bisect.bisect_left(lengths, longest, 0, left)
        taken = min(equal, room // longest)
        left -= taken
        room -= taken * longest
    return capacity - room


def cheapest(length, capacities, bin_cost, lengths, left):
    """The capacity with the least cost per token expected in it; of equals the smallest."""
    return min(
        (c for c in capacities if c >= length),
        key=lambda c: ((c + bin_cost) / expected_fill(length, c, lengths, left), c),
    )


def pack(lengths, capacities=CAPACITIES, bin_cost=BIN_COST):
    """Pack ascending ``lengths``; returns for each its bin and offset, and each bin's used tokens.

    Open bins are kept sorted by room, and among equal room by age, so that ties have one answer.
    """
    rooms, used = [], []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in range(len(lengths) - 1, -1, -1):
        length = lengths[i]
        at = bisect.bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            chosen, room = len(used), cheapest(length, capacities, bin_cost, lengths, i)
            used.append(0)
        bins[i], offsets[i] = chosen, used[chosen]
        used[chosen] += length
        if room > length:
            bisect.insort(rooms, (room - length, chosen))
    return bins, offsets, used


def downsized(used, capacities=CAPACITIES):
    return [next(c for c in sorted(capacities) if c >= u) for u in used]


def tokenized_lengths(docs, tokenizer):
    """doc_id and n, the tokens of its text by the rank file ``tokenizer``, of every row."""

    def counted(batches):
        for batch in batches:
            n = pa.array(token_counts(batch.column(1), tokenizer))
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n long")


def pieces(docs, capacity, n_tokens=None, tokenizer=None):
    """Cut each document into pieces of at most ``capacity`` tokens, by numbers only.

    ``tokenizer`` is the path of a rank file that every executor can read, or else ``n_tokens`` a column
    of token counts; with neither, words between white space count, which are fewer than tokens.
    """
    if tokenizer is not None:
        counted = tokenized_lengths(docs, tokenizer)
    else:
        if n_tokens is None:
            n_tokens = F.regexp_count(text_of(docs), F.lit(WORD))
        counted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), n_tokens.cast("long").alias("n"))
    cut = counted.where("n > 0").select(
        "doc_id",
        "n",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("int") - 1)).alias("piece"),
    )
    start = F.col("piece").cast("long") * capacity
    return cut.select(
        "doc_id",
        "piece",
        start.alias("piece_start"),
        F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("n_tokens"),
    )


def best_fit(
    docs, capacities=CAPACITIES, bin_cost=BIN_COST, n_tokens=None, group_pieces=GROUP_PIECES, tokenizer=None
):
    """One row per piece: doc_id, piece, piece_start, n_tokens, bin_id, bin_offset, bin_used, bin_capacity.

    Documents without tokens (null, empty or blank text) have no piece, an empty table no row. Rows that repeat an
    id, or have none, are packed each and spread over groups. The result depends only on ids and lengths,
    never on how rows are partitioned; of pieces of equal length the smaller id is placed first, a missing
    one last. A very long text is many pieces. Other columns are not read, whatever their names.
    """
    capacities = tuple(sorted(capacities))
    # Written once: texts are read for their lengths only, and not again for the number of groups.
    cut = written(pieces(docs, capacities[-1], n_tokens, tokenizer), "pieces")
    groups = max(1, math.ceil(cut.count() / group_pieces))

    # Arrow, not pandas: a column that holds a null would come as float64 and round large ids.
    def packed(held):
        order = pc.sort_indices(
            held,
            sort_keys=[("n_tokens", "ascending"), ("doc_id", "descending"), ("piece", "descending")],
            null_placement="at_end",
        )
        held = held.take(order)
        bins, offsets, used = pack(held["n_tokens"].to_pylist(), capacities, bin_cost)
        sizes = downsized(used, capacities)
        group = held["pack_group"][0].as_py() if len(held) else 0
        kept = [held[c] for c in ("doc_id", "piece", "piece_start", "n_tokens")]
        made = [offsets, [used[b] for b in bins], [sizes[b] for b in bins]]
        return pa.Table.from_arrays(
            [*kept, pa.array([f"{group}-{b}" for b in bins], pa.string()), *(pa.array(x, pa.int32()) for x in made)],
            names=[c.split()[0] for c in PACKED.split(", ")],
        )

    return dealt(cut, groups).groupBy("pack_group").applyInArrow(packed, PACKED)


def dealt(cut, groups):
    """Every piece with its group; the same whatever the order and the partitions of the pieces."""
    names = ["doc_id", "piece", "piece_start", "n_tokens"]
    equal = cut.groupBy(*names).agg(F.count("*").alias("n"))
    runs = explode_ticks(equal, F.lit(0).cast("bigint"), F.col("n") - 1, EQUAL_PIECES, "run", [*names, "n"])
    size = F.least(F.col("n") - F.col("run"), F.lit(EQUAL_PIECES))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "run"), F.lit(groups))
    return runs.select(*names, spread.alias("pack_group"), F.explode(F.sequence(F.lit(1), size)).alias("_copy")).drop("_copy")
