"""The partition a queue puts a record in, as column arithmetic."""

from pyspark.sql import functions as F

# Fixed values of the 32-bit murmur2 hash that queue clients use for keys.
SEED = 0x9747B28C
MIX = 0x5BD1E995
_LOW = 0xFFFFFFFF


def _given(value, use):
    # Names a value, so that an expression with several uses of it computes it once.
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _times(value):
    # Both factors stay below 2**32 and 2**31, so the product fits a bigint.
    return (value * F.lit(MIX)).bitwiseAND(F.lit(_LOW))


def _folded(value, bits):
    return _given(value, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, bits)))


def murmur2(data):
    """The 32-bit murmur2 hash of a binary column as an unsigned bigint; null for null.

    Four bytes at a time, the first one lowest, in bigints that hold 32 bits; the time is in proportion to
    the bytes.
    """
    return _given(data, _hash)


def _hash(data):
    size = F.octet_length(data).cast("bigint")

    def little_endian(start, n):
        digits = F.hex(F.substring(data, start + 1, F.lit(n)))
        pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))]
        return F.conv(F.concat(*pairs), 16, 10).cast("bigint")

    def step(held, word):
        mixed = _times(_folded(_times(word), 24))
        return _times(held).bitwiseXOR(mixed)

    whole = F.floor(size / 4).cast("int")
    words = F.when(
        whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: little_endian(i * 4, 4))
    ).otherwise(F.array().cast("array<bigint>"))
    held = F.aggregate(words, F.lit(SEED).cast("bigint").bitwiseXOR(size), step)
    left, start = size % 4, whole * 4
    tail = F.lit(None).cast("bigint")
    for n in (3, 2, 1):
        tail = F.when(left == n, little_endian(start, n)).otherwise(tail)
    held = _given(held, lambda h: F.when(left == 0, h).otherwise(_times(h.bitwiseXOR(tail))))
    return _folded(_times(_folded(held, 13)), 15)


def key_partition(key, partitions):
    """The partition of a text key: its hash without the sign bit, by the number of partitions."""
    positive = murmur2(F.encode(key, "utf-8")).bitwiseAND(F.lit(0x7FFFFFFF))
    return (positive % partitions).cast("int")


def spread_partition(columns, partitions):
    """Any partition, each as likely, but the same one whenever a record is made again."""
    return F.pmod(F.xxhash64(*columns), F.lit(partitions).cast("bigint")).cast("int")
