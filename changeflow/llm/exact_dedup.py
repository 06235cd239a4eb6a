"""Exact deduplication through counting quotient filters.

Every partition sums its documents' fingerprints up in a counting quotient filter: a fingerprint
is cut into a block, a quotient and a remainder, and a filter holds each block's remainders sorted
by quotient, with a count. Filters of one block merge without loss by sorting their remainders
together and adding counts. Only fingerprints whose merged count is above one are suspects; their
documents go on to byte verification, a grouping by the normalised text itself. Documents with a
fingerprint of their own are known to be unique without moving their text.

A partition sends each fingerprint once, so a hot group of copies weighs no more in a merge than
the number of partitions; the verification groups by text and combines before it shuffles.
"""

import math

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from .tables import SPACE_RUN, text_of

QUOTIENT_BITS = 16
REMAINDER_BITS = 32
ROWS_PER_BLOCK = 50_000


def normalised(docs):
    """The text with every run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(docs), SPACE_RUN, " ")


def block_bits(rows):
    """How many bits name a block, so that a block has about ``ROWS_PER_BLOCK`` fingerprints."""
    return min(16, max(4, math.ceil(math.log2(max(1, rows / ROWS_PER_BLOCK)))))


def fingerprint(text, bits):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits - QUOTIENT_BITS - REMAINDER_BITS)


def _filters(keys, counts):
    """Filters of sorted, distinct fingerprints, one row for each block."""
    block = keys >> np.uint64(QUOTIENT_BITS + REMAINDER_BITS)
    quotient = (keys >> np.uint64(REMAINDER_BITS)).astype(np.uint16)
    remainder = keys.astype(np.uint32)
    names, first = np.unique(block, return_index=True)
    ends = [*first[1:], len(keys)]
    parts = [(b, a, e) for b, a, e in zip(names, first, ends)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(b) for b, _, _ in parts], pa.int64()),
            pa.array([quotient[a:e].tobytes() for _, a, e in parts], pa.binary()),
            pa.array([remainder[a:e].tobytes() for _, a, e in parts], pa.binary()),
            pa.array([counts[a:e].astype(np.int64).tobytes() for _, a, e in parts], pa.binary()),
        ],
        names=["block", "quotients", "remainders", "counts"],
    )


def _merged(keys, counts):
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def build(batches):
    """One filter of a partition's fingerprints, merged batch by batch."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        more = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        if len(more):
            keys, counts = _merged(
                np.concatenate([keys, more]),
                np.concatenate([counts, np.ones(len(more), np.int64)]),
            )
    if len(keys):
        yield _filters(keys, counts)


def repeated(merged):
    """The fingerprints of a block that more than one document has."""
    block = np.uint64(merged.column("block")[0].as_py())
    quotients, remainders, counts = (
        np.frombuffer(b"".join(merged.column(name).to_pylist()), kind)
        for name, kind in (("quotients", np.uint16), ("remainders", np.uint32), ("counts", np.int64))
    )
    keys = (
        (block << np.uint64(QUOTIENT_BITS + REMAINDER_BITS))
        | (quotients.astype(np.uint64) << np.uint64(REMAINDER_BITS))
        | remainders.astype(np.uint64)
    )
    keys, counts = _merged(keys, counts)
    return pa.table({"suspect": keys[counts > 1].view(np.int64)})


def suspects(texts, bits):
    """Fingerprints shared by several rows of ``texts(norm)``."""
    filters = texts.select(fingerprint(texts["norm"], bits)).mapInArrow(
        build, "block long, quotients binary, remainders binary, counts binary"
    )
    return filters.groupBy("block").applyInArrow(repeated, "suspect long")


def exact_groups(docs, bits=None):
    """One row per group of equal texts with more than one row.

    Columns: text_sha256, keep_id (smallest doc_id, null only if no row has one), group_size,
    n_first (rows that carry keep_id: more than one where a row is repeated).
    """
    texts = docs.select(docs["doc_id"], normalised(docs).alias("norm"))
    if bits is None:
        bits = block_bits(docs.count())
    found = suspects(texts, bits)
    checked = texts.join(found, fingerprint(texts["norm"], bits) == found["suspect"], "left_semi")
    by_row = checked.groupBy("norm", "doc_id").agg(F.count("*").alias("n"))
    return (
        by_row.groupBy("norm")
        .agg(
            F.min("doc_id").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.coalesce(F.min_by("n", "doc_id"), F.sum("n")).alias("n_first"),
        )
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", "n_first")
    )


def exact_dedup(docs, bits=None):
    """Every row of ``docs`` with the row that stays of its group of equal texts.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Rows that repeat both id and text all
    name themselves as the one that stays; ``drop_copies`` keeps one of them. An empty table gives
    an empty result; a row without an id stays only if no row of its group has one.
    """
    rows = docs.select(docs["doc_id"], F.sha2(normalised(docs), 256).alias("text_sha256"))
    groups = exact_groups(docs, bits).withColumnRenamed("text_sha256", "group_sha256")
    joined = rows.join(groups, rows["text_sha256"] == groups["group_sha256"], "left")
    alone = F.col("group_sha256").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("group_size")).alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs, bits=None):
    """``docs`` with one row of every group of equal texts, all columns as they were."""
    groups = exact_groups(docs, bits).select(
        F.col("text_sha256").alias("__sha"),
        F.col("keep_id").alias("__keep"),
        F.col("n_first").alias("__n_first"),
    )
    sha = F.sha2(normalised(docs), 256)
    copies = groups.select("__sha", "__keep")
    stays = docs.join(
        copies,
        (sha == copies["__sha"]) & ~docs["doc_id"].eqNullSafe(copies["__keep"]),
        "left_anti",
    )
    repeats = groups.where("__n_first > 1").select("__sha")
    single = stays.join(repeats, sha == repeats["__sha"], "left_anti")
    twice = stays.join(repeats, sha == repeats["__sha"], "left_semi")
    once = twice.withColumn("__once", sha).dropDuplicates(["__once"]).drop("__once")
    return single.unionByName(once)
