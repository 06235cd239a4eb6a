"""A Bloom filter of fixed size over 64-bit keys, to keep rows out of a join that cannot match.

It is built in parallel by pieces and has a size bound of its own: with more keys than it is meant
for it lets more rows through and never loses one. Whatever uses it joins exactly afterwards.
"""

import numpy as np
import pyarrow as pa

from .words import U, mix

PIECE_BITS = 19
HASHES = 3


class Bloom:
    def __init__(self, bits, words):
        self.bits, self.words = bits, words

    def contains(self, keys):
        keys = np.asarray(keys).astype(np.int64).view(U)
        found = np.ones(len(keys), bool)
        for places in _places(keys, self.bits):
            found &= (self.words[places >> U(3)] >> (places & U(7)).astype(np.uint8)) & 1 == 1
        return found


def _places(keys, bits):
    for i in range(HASHES):
        yield mix(keys + U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) >> U(64 - bits)


def size_for(keys, most=27):
    """Bits of a filter for so many keys, at about ten bits each and at most 2**27 (16 MB)."""
    return min(most, max(PIECE_BITS, int(keys * 10).bit_length()))


def build(frame, column, keys):
    """A filter over a long column of ``frame``, which has about ``keys`` rows."""
    bits = size_for(keys)

    def marked(batches):
        words = {}
        for batch in batches:
            found = batch.column(0).drop_null().to_numpy().view(U)
            for places in _places(found, bits):
                pieces = places >> U(PIECE_BITS)
                for piece in np.unique(pieces):
                    held = words.setdefault(int(piece), np.zeros(1 << PIECE_BITS, bool))
                    held[places[pieces == piece] & U((1 << PIECE_BITS) - 1)] = True
        for piece, held in words.items():
            packed = np.packbits(held, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([packed])], names=["piece", "held"])

    def merged(table):
        out = np.zeros(1 << (PIECE_BITS - 3), np.uint8)
        for chunk in table.column("held"):
            out |= np.frombuffer(chunk.as_buffer(), np.uint8)
        return pa.table({"piece": table.column("piece")[:1], "held": pa.array([out.tobytes()])})

    schema = "piece long, held binary"
    words = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PIECE_BITS - 3)
    for row in frame.select(column).mapInArrow(marked, schema).groupBy("piece").applyInArrow(merged, schema).collect():
        words[row.piece * size : (row.piece + 1) * size] = np.frombuffer(row.held, np.uint8)
    return Bloom(bits, words)
