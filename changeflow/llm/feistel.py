"""Token shards in training order: a keyed permutation gives every sequence its global slot.

Documents are tokenized and cut into sequences of a fixed number of tokens. Sequences are numbered
without gaps, partition by partition; a keyed Feistel network over the next even number of bits,
walked until it lands inside the range (cycle-walking), maps number to slot. The permutation is a
formula, so a slot or its sequence can be computed anywhere, in either direction, from key and
count alone. Sequences are range-partitioned by shard and written at a fixed stride: slot s is in
shard s div R at byte (s mod R) * stride, and a reader resumes by seeking.

Tokens are counted in one pass and made in another. Counting first costs the tokenizer a second
time, but keeps the tokens themselves to one shuffle and one write.
"""

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark import TaskContext

from .words import U, blocks, mix, word_hashes

SEQUENCE = 512
SHARD_RECORDS = 8192
ROUNDS = 4
KEY = 20240601
#: Stored for a row without an id.
NO_ID = -(1 << 63)
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


# --- permutation -------------------------------------------------------------------------------


def half_bits(count):
    """Bits of each half of the network: the least for which two halves cover ``count``."""
    return max(1, math.ceil(max(1, (count - 1).bit_length()) / 2))


def _network(x, bits, keys):
    mask = U((1 << bits) - 1)
    left, right = x >> U(bits), x & mask
    for key in keys:
        left, right = right, left ^ (mix(right + key) & mask)
    return (right << U(bits)) | left


def round_keys(key):
    return mix(np.arange(1, ROUNDS + 1, dtype=U) * U(0xA0761D6478BD642F) + U(key))


def permuted(numbers, count, key=KEY, inverse=False):
    """The slots of ``numbers``, all below ``count``; with ``inverse`` the numbers of slots.

    Values outside the range go through the network again until they are inside; as the network
    is a bijection, every walk ends and no two meet.
    """
    bits, keys = half_bits(count), round_keys(key)
    keys = keys[::-1] if inverse else keys
    x = np.asarray(numbers).astype(U)
    outside = np.ones(len(x), bool)
    while outside.any():
        x[outside] = _network(x[outside], bits, keys)
        outside = x >= U(count)
    return x.astype(np.int64)


# --- tokens ------------------------------------------------------------------------------------

_ENCODERS = {}
TOKEN_BLOCK = 8 << 20


def encoder(path):
    """The rank file's encoder and the bytes of each token, once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        widths = np.zeros(max(ranks.values()) + 1, np.int64)
        widths[list(ranks.values())] = [len(b) for b in ranks]
        _ENCODERS[path] = (
            tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}),
            widths,
        )
    return _ENCODERS[path]


def _solid(data):
    """Bytes that surely belong to no white space; doubtful ones beyond ASCII count as white."""
    lead = (data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3))
    doubtful = lead.copy()
    doubtful[1:] |= lead[:-1]
    doubtful[2:] |= lead[:-2]
    return ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)) | doubtful)


def units(data, offsets):
    """Cut text where no token reaches across: before a single space between solid characters.

    Returns the start and end of each unit, whether it may follow any other unit without changing
    its tokens, and the first unit of each row.
    """
    n = len(data)
    solid = _solid(data)
    begins = np.zeros(n + 1, bool)
    if n > 2:
        begins[1 : n - 1] = (data[1:-1] == 0x20) & solid[:-2] & solid[2:]
    begins[offsets] = True
    starts = np.flatnonzero(begins[:n])
    ends = np.append(starts[1:], n)[: len(starts)]
    second = np.minimum(starts + 1, max(n - 1, 0))
    joins = (data[starts] == 0x20) & (ends - starts > 1) & solid[second]
    return starts, ends, joins, np.searchsorted(starts, offsets)


def tokens_of_units(data, starts, ends, joins, path):
    """Tokenize each distinct unit once, however often it occurs in the block.

    Returns token ids, then by distinct unit the first id's place and the number of ids, then each
    unit's distinct unit.
    """
    encode, widths = encoder(path)
    _, first, which = np.unique(
        word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True
    )
    raw = data.tobytes()
    ids, counts, places = [], np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    done = 0
    joined = np.flatnonzero(joins[first])
    if len(joined):
        low, high = starts[first[joined]], ends[first[joined]]
        text = b"".join([raw[a:b] for a, b in zip(low.tolist(), high.tolist())])
        found = encode.encode_to_numpy(text.decode("utf-8"))
        stops = np.searchsorted(np.cumsum(widths[found]), np.cumsum(high - low), "left") + 1
        counts[joined] = np.diff(stops, prepend=0)
        places[joined] = stops - counts[joined]
        ids.append(found)
        done = len(found)
    for k in np.flatnonzero(~joins[first]).tolist():
        found = encode.encode_to_numpy(raw[starts[first[k]] : ends[first[k]]].decode("utf-8"))
        counts[k], places[k] = len(found), done
        ids.append(found)
        done += len(found)
    return np.concatenate([np.zeros(0, np.uint32), *ids]), places, counts, which


def token_counts(column, path):
    """Tokens of each text of an Arrow column; null has none."""
    out = np.zeros(len(column), np.int64)
    for row, data, offsets in blocks(column, TOKEN_BLOCK):
        starts, ends, joins, first = units(data, offsets)
        _, _, counts, which = tokens_of_units(data, starts, ends, joins, path)
        sums = np.concatenate([[0], np.cumsum(counts[which])])
        out[row : row + len(offsets) - 1] = np.diff(sums[first])
    return out


def token_ids(column, path):
    """Token ids of an Arrow column, block by block: first row, ids, offset of each row in them."""
    for row, data, offsets in blocks(column, TOKEN_BLOCK):
        starts, ends, joins, first = units(data, offsets)
        ids, places, counts, which = tokens_of_units(data, starts, ends, joins, path)
        n = counts[which]
        sums = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(sums[-1]) + np.repeat(places[which] - sums[:-1], n)
        yield row, ids[take], sums[first]


# --- sequences ---------------------------------------------------------------------------------


class Layout:
    """Where the records of ``count`` sequences lie. A record: doc_id (8 bytes), chunk (4), tokens
    held (4), the tokens (2 or 4 bytes each), a line end."""

    def __init__(self, count, sequence=SEQUENCE, shard_records=SHARD_RECORDS, wide=False, key=KEY):
        self.count, self.sequence, self.shard_records, self.key = count, sequence, shard_records, key
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.fields = np.dtype(
            [("doc_id", "<i8"), ("chunk", "<i4"), ("n_tokens", "<i4"), ("tokens", self.kind, (sequence,))]
        )
        self.stride = self.fields.itemsize + 1

    @property
    def n_shards(self):
        return max(1, -(-self.count // self.shard_records))

    def place(self, slot):
        """Shard and byte offset of a slot."""
        return slot // self.shard_records, slot % self.shard_records * self.stride


def numbered_partitions(docs, tokenizer, sequence):
    """Sequences per partition of ``docs``, in partition order, as an array."""

    def counted(batches):
        n = 0
        for batch in batches:
            n += int((token_counts(batch.column(1), tokenizer) // sequence + 1).sum())
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n])], names=["part", "n"])

    found = docs.mapInArrow(counted, "part long, n long").collect()
    counts = np.zeros(max([r.part for r in found], default=-1) + 1, np.int64)
    for r in found:
        counts[r.part] = r.n
    return counts


def token_sequences(docs, tokenizer, sequence=SEQUENCE, end_id=50256, key=KEY, shard_records=SHARD_RECORDS):
    """The records of all sequences of ``docs(doc_id, text)``, with their slots, and their layout.

    ``tokenizer`` is the path of a rank file that every executor can read; ``end_id`` ends each
    document and fills its last sequence up. Returns slot, shard, record. Null or empty text is one
    sequence of the end alone; rows that repeat an id have sequences of their own; a null id is
    stored as ``NO_ID``.

    Sequences are numbered by partition and place in it, so ``docs`` must have the same partitions
    each time it is read, as a table's files have; a partition that differs in the second pass
    stops the job. The driver holds one number per partition.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    counts = numbered_partitions(rows, tokenizer, sequence)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    layout = Layout(int(offsets[-1]), sequence, shard_records, end_id > 0xFFFF, key)

    def made(batches):
        part = TaskContext.get().partitionId()
        number = int(offsets[part])
        for batch in batches:
            ids_of_rows = np.array(batch.column(0).fill_null(NO_ID))
            for row, ids, at in token_ids(batch.column(1), tokenizer):
                doc_ids = ids_of_rows[row : row + len(at) - 1]
                records = _records(ids, at, doc_ids, end_id, layout)
                slots = permuted(number + np.arange(len(records)), layout.count, key)
                number += len(records)
                yield _record_batch(records, slots, layout)
        if number != offsets[part + 1]:
            raise RuntimeError("the partitions of docs changed between two reads; write docs first")

    return rows.mapInArrow(made, "slot long, shard int, record binary"), layout


def _records(ids, at, doc_ids, end_id, layout):
    n = np.diff(at)
    chunks = n // layout.sequence + 1
    first = np.cumsum(chunks) - chunks
    out = np.zeros(int(chunks.sum()), layout.fields)
    tokens = np.full(len(out) * layout.sequence, end_id, layout.kind)
    tokens[np.arange(len(ids)) + np.repeat(first * layout.sequence - at[:-1], n)] = ids
    out["tokens"] = tokens.reshape(len(out), layout.sequence)
    out["doc_id"] = np.repeat(doc_ids, chunks)
    out["chunk"] = np.arange(len(out)) - np.repeat(first, chunks)
    out["n_tokens"] = np.minimum(np.repeat(n + 1, chunks) - out["chunk"] * layout.sequence, layout.sequence)
    return out


def _record_batch(records, slots, layout):
    width = records.dtype.itemsize
    offsets = pa.py_buffer((np.arange(len(records) + 1) * width).astype(np.int32).tobytes())
    held = pa.Array.from_buffers(
        pa.binary(), len(records), [None, offsets, pa.py_buffer(records.tobytes())]
    )
    shards = (slots // layout.shard_records).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(slots), pa.array(shards), held], names=["slot", "shard", "record"]
    )


def write_shards(records, layout, path):
    """Write one file per shard, its records in slot order.

    Partition number is shard number, so every shard is one task's sequential write, through Spark's
    committer: a lost task writes its file again, and no half-written file is left in place.
    """
    (
        records.repartitionById(layout.n_shards, F.col("shard"))
        .sortWithinPartitions("shard", "slot")
        .select(F.col("record").cast("string").alias("value"), "shard")
        .write.partitionBy("shard")
        .option("lineSep", "\n")
        .text(path)
    )


def read_shards(spark, path, layout):
    """The sequences in the shards: slot, shard, byte_offset, doc_id, chunk, n_tokens, tokens_sha256."""

    def parsed(batches):
        fields = np.dtype([("held", layout.fields), ("end", "u1")])
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = np.frombuffer(content.as_buffer(), fields)["held"]
                place = np.arange(len(records))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard * layout.shard_records + place),
                        pa.array(np.full(len(records), shard, np.int32)),
                        pa.array(place * layout.stride),
                        pa.array(records["doc_id"].copy(), mask=records["doc_id"] == NO_ID),
                        pa.array(records["chunk"].copy()),
                        pa.array(records["n_tokens"].copy()),
                        pa.array([hashlib.sha256(t.tobytes()).hexdigest() for t in records["tokens"]]),
                    ],
                    names=["slot", "shard", "byte_offset", "doc_id", "chunk", "n_tokens", "tokens_sha256"],
                )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int")
    return files.select(shard.alias("shard"), "content").mapInArrow(
        parsed,
        "slot long, shard int, byte_offset long, doc_id long, chunk int, n_tokens int, tokens_sha256 string",
    )
