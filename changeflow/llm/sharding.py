"""Shards by extendible hashing: a directory over hash-prefix bits, split only where too large.

Every document has 60 hash bits. The directory starts with one bucket for all; a bucket above the
byte limit splits on its next bit, and only such buckets do. A document's shard is therefore the
shortest prefix of its bits whose documents fit the limit together.

The sizes of all prefixes come from sums over the longest prefix looked at, added up pair by pair
towards the root, so the documents' own rows are read twice: once to be summed (combined before
the shuffle) and once to be assigned. Leaves that are still too large at that length are looked at
again with more bits, alone. A bucket that no bit can split, one document above the limit or rows
with the same id, is reported with ``fits`` false, whole.
"""

import math

import pyspark.sql.functions as F

from changeflow.session import written

HASH_BITS = 60
BITS_PER_LOOK = 12
BYTE_LIMIT = 64 << 20


def hash_bits(doc_id):
    """60 bits of the id's MD5; a null id hashes like the text ``null``."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(bits, depth):
    return F.call_function("shiftright", bits, F.lit(HASH_BITS) - depth)


def directory(sizes, limit):
    """The buckets of ``sizes(bits, n_bytes)``: prefix, depth, shard_bytes, n_docs, fits.

    The first look goes a few bits below the depth at which buckets fit on average.
    """
    total = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    spark = sizes.sparkSession
    root, look = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 4))
    rest, found = sizes, None
    while True:
        leaves = written(
            rest.groupBy(_prefix(F.col("bits"), F.lit(look)).alias("leaf")).agg(
                F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_docs")
            ),
            "shard-leaves",
        )
        levels = leaves.select(
            F.explode(F.sequence(F.lit(root), F.lit(look))).alias("depth"), "*"
        ).select("depth", F.expr(f"shiftright(leaf, {look} - depth)").alias("prefix"), "n_bytes", "n_docs")
        summed = levels.groupBy("depth", "prefix").agg(
            F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("n_docs")
        )
        ends = (F.col("shard_bytes") <= limit) | (F.col("depth") >= HASH_BITS)
        closed = summed.where(ends)
        parents = closed.select(
            (F.col("depth") + 1).alias("above_depth"), F.col("prefix").alias("above_prefix")
        )
        buckets = closed.join(
            parents,
            (F.col("depth") == F.col("above_depth"))
            & (F.expr("shiftright(prefix, 1)") == F.col("above_prefix")),
            "left_anti",
        ).withColumn("fits", F.col("shard_bytes") <= limit)
        found = buckets if found is None else found.unionByName(buckets)
        if look >= HASH_BITS:
            break
        large = leaves.where(F.col("n_bytes") > limit).select("leaf")
        if large.isEmpty():
            break
        rest = rest.join(large, _prefix(F.col("bits"), F.lit(look)) == F.col("leaf"), "left_semi")
        root, look = look + 1, min(HASH_BITS, look + BITS_PER_LOOK)
    return written(found, "shard-directory")


def name_of(prefix, depth):
    """The bits of a bucket as text; the root is empty."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def shards(docs, limit=BYTE_LIMIT):
    """Assign every row of ``docs`` to a shard of at most ``limit`` bytes of text.

    Returns doc_id, n_bytes, shard (its bits), depth, shard_bytes, shard_docs, fits. Null text has no
    bytes. An empty table gives an empty result.
    """
    sizes = docs.select(
        docs["doc_id"],
        hash_bits(docs["doc_id"]).alias("bits"),
        F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return assign(sizes, directory(sizes.select("bits", "n_bytes"), limit))


def assign(sizes, buckets):
    """Look every row up in the directory.

    The directory has few depths; each is an equi-join on a prefix of that length, made one join
    by exploding a row over the depths present.
    """
    depths = sorted(r.depth for r in buckets.select("depth").distinct().collect())
    if not depths:
        depths = [0]
    keyed = sizes.select(
        "*", F.explode(F.array(*[F.lit(d) for d in depths])).alias("key_depth")
    ).withColumn("key_prefix", F.expr(f"shiftright(bits, {HASH_BITS} - key_depth)"))
    return keyed.join(
        buckets,
        (F.col("key_depth") == F.col("depth")) & (F.col("key_prefix") == F.col("prefix")),
        "inner",
    ).select(
        "doc_id",
        "n_bytes",
        name_of(F.col("prefix"), F.col("depth")).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        "shard_bytes",
        F.col("n_docs").alias("shard_docs"),
        "fits",
    )


def write_shards(docs, assigned, path):
    """Write whole documents to one folder per shard, named by its bits.

    The folder's column is ``shard``, or ``shard_folder`` where documents have a ``shard`` of their own.
    """
    folder = "shard"
    while folder in [c.lower() for c in docs.columns]:
        folder += "_folder"
    by_id = assigned.select(
        F.col("doc_id").alias("__assigned_id"), F.concat(F.lit("b"), F.col("shard")).alias(folder)
    ).distinct()
    (
        docs.join(by_id, docs["doc_id"].eqNullSafe(by_id["__assigned_id"]))
        .drop("__assigned_id")
        .repartition(folder)
        .write.partitionBy(folder)
        .parquet(path)
    )
