"""Partitions of records: known hashes, keys of any length, retries."""

import pytest
from pyspark.sql import functions as F

from changeflow.functions import murmur2
from changeflow.operators.envelope import queue_records

# Hashes that queue clients publish for these keys.
KNOWN = {
    "21": -973932308,
    "foobar": -790332482,
    "a-little-bit-long-string": -985981536,
    "a-little-bit-longer-string": -1486304829,
    "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971,
    "abc": 479470107,
}


def plain(data):
    low = 0xFFFFFFFF
    held = 0x9747B28C ^ len(data)
    for i in range(0, len(data) - len(data) % 4, 4):
        word = int.from_bytes(data[i : i + 4], "little") * 0x5BD1E995 & low
        held = (held * 0x5BD1E995 & low) ^ ((word ^ word >> 24) * 0x5BD1E995 & low)
    rest = data[len(data) - len(data) % 4 :]
    if rest:
        held = (held ^ int.from_bytes(rest, "little")) * 0x5BD1E995 & low
    held = (held ^ held >> 13) * 0x5BD1E995 & low
    return held ^ held >> 15


def hashes(spark, keys):
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    return {r.key: r.h for r in table.select("key", murmur2(F.encode("key", "utf-8")).alias("h")).collect()}


def test_known_hashes(spark):
    assert hashes(spark, KNOWN) == {k: h & 0xFFFFFFFF for k, h in KNOWN.items()}
    assert {k: plain(k.encode()) for k in KNOWN} == {k: h & 0xFFFFFFFF for k, h in KNOWN.items()}


def test_keys_of_every_length_and_kind(spark):
    keys = ["x" * n for n in range(40)] + ["ü" * n for n in range(1, 9)] + ["表.名", "\x00", "y" * 100_001]
    assert hashes(spark, [*keys, None]) == {None: None, **{k: plain(k.encode()) for k in keys}}


def messages(spark, n):
    return spark.range(n).select(
        F.col("id").alias("seq"), F.lit(0).alias("row_index"), F.lit("s").alias("schema_name"),
        (F.col("id") % 3).cast("string").alias("table_name"), F.lit("{}").alias("value"), F.lit(7).alias("ts_s"),
    )


@pytest.mark.parametrize("partitioner", ["spread", "key"])
def test_records_are_dealt_evenly_and_alike_each_time(spark, partitioner):
    records = queue_records(messages(spark, 6000), "log", partitions=6, partitioner=partitioner)
    first, again = ({r.key: r.partition for r in records.collect()} for _ in range(2))
    counts = [list(first.values()).count(p) for p in range(6)]
    assert first == again and sum(counts) == 6000 and min(counts) > 850
    if partitioner == "key":
        assert all(p == (plain(k.encode()) & 0x7FFFFFFF) % 6 for k, p in first.items())


def test_a_table_stays_in_one_partition_only_by_its_key(spark):
    sent = messages(spark, 300)
    by_key = queue_records(sent, "log", "table", partitions=50, partitioner="key")
    assert by_key.select("key", "partition").distinct().count() == 3
    assert queue_records(sent, "log", "table", partitions=50).select("partition").distinct().count() > 40
    lost = queue_records(sent.withColumn("seq", F.lit(None).cast("long")), "log", partitions=4, partitioner="key")
    assert lost.filter("partition IS NULL OR partition NOT BETWEEN 0 AND 3").isEmpty()
    assert queue_records(sent, "log").columns == ["topic", "key", "value", "timestamp"]
    with pytest.raises(ValueError):
        queue_records(sent, "log", partitions=4, partitioner="other")
