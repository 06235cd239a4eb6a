"""The landed change log as a table or a stream, and where to start in it."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.operators.intervals import locate
from changeflow.operators.ordered import block_of, running_total
from changeflow.operators.transaction_sets import segments
from changeflow.schemas import CHANGE_SCHEMA


#: Column with the text of a record that could not be read.
MALFORMED = "malformed"


def read_changes(spark, path, file_format="parquet", schema=CHANGE_SCHEMA):
    """The change log as a table."""
    return spark.read.format(file_format).schema(schema).load(path)


def stream_changes(
    spark, path, file_format="parquet", schema=CHANGE_SCHEMA, max_files=None, glob=None
):
    """The change log as a stream; ``max_files`` per micro-batch holds it back."""
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def kafka_changes(spark, servers, topic, max_offsets=None, schema=CHANGE_SCHEMA):
    """The change log as a stream of JSON records of a Kafka topic.

    Needs the Kafka connector package on the cluster.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return parsed_records(reader.load(), schema)


def parsed_records(records, schema=CHANGE_SCHEMA):
    """Changes from JSON texts in ``value``, with the text of a malformed one in ``malformed``.

    A record that is no change has nulls everywhere else; ``well_formed`` and ``malformed`` tell the two
    apart, and the relay sets the malformed aside.
    """
    with_text = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    text = F.col("value").cast("string")
    parsed = F.from_json(text, with_text, {"columnNameOfCorruptRecord": MALFORMED})
    broken = F.coalesce(
        F.col(f"_c.{MALFORMED}"), F.when(F.col("_c.seq").isNull(), F.coalesce("_t", F.lit("")))
    )
    return records.select(parsed.alias("_c"), text.alias("_t")).select(
        *[F.when(broken.isNull(), F.col(f"_c.{c}")).alias(c) for c in schema.fieldNames()],
        broken.alias(MALFORMED),
    )


def well_formed(changes):
    """The changes that could be read, without the column that tells."""
    if MALFORMED not in changes.columns:
        return changes
    return changes.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)


def malformed(changes):
    """The texts that could not be read as a change."""
    return changes.filter(F.col(MALFORMED).isNotNull()).select(MALFORMED)


def from_position(changes, binlog_file, binlog_pos):
    """Changes at or after a log position.

    File names are zero-padded; a name that has outgrown its padding is longer and
    comes later, so names compare by length, then as text. The first condition follows
    from the second; alone it prunes a log that is partitioned by ``binlog_file``.
    """
    file, pos = F.col("binlog_file"), F.col("binlog_pos")
    longer, equal = F.length(file) > len(binlog_file), F.length(file) == len(binlog_file)
    from_file = ((file >= binlog_file) & equal) | longer
    return changes.filter(from_file & ((file != binlog_file) | (pos >= binlog_pos)))


def number_changes(changes, width=1 << 20):
    """Add a dense ``seq`` to a landed log, from file, position and place in the event list.

    Rows are counted per file and block of positions, and numbered inside such a block, so
    no file goes through one task. File names order by length, then as text.
    """
    blocked = changes.withColumns(
        {
            "_one": F.lit(1).cast("bigint"),
            "_length": F.length("binlog_file"),
            "_block": block_of("binlog_pos", width),
            "_all": F.lit(0),
        }
    )
    return (
        running_total(
            blocked,
            "_one", ["_all"], ["binlog_pos"], ["_length", "binlog_file", "_block"], "seq",
        )
        .withColumn("seq", F.col("seq") - 1)
        .drop("_one", "_length", "_block", "_all")
    )


def skip_executed(changes, executed, width=1 << 20):
    """Changes whose transaction the executed set does not contain.

    ``executed`` holds inclusive intervals ``gno_start .. gno_end`` per server, which may overlap. They are
    brought to the fewest intervals, and these with the gaps between them are looked up by dyadic
    pieces: a set of one interval is one lookup by server whatever its length, and Spark broadcasts
    a small set.
    """
    found = locate(
        changes, ["server_uuid"], "gno", segments([executed], lambda held: held, width), "gno_start", "gno_end", ["holds"]
    )
    return found.filter(~F.coalesce("holds", F.lit(False))).drop("holds")
