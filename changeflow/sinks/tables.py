"""Writing results. File writes are idempotent per batch."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


def write_change_log(changes, path, partition_by=("binlog_file",)):
    """Land a change log so that a start position prunes whole log files."""
    changes.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_batch(df, path, batch_id, partition_by=(), file_format="parquet", run=None):
    """Write one batch to its own folder; a retried batch replaces itself.

    ``run`` names the stream the batch number belongs to: another run's batches stay.
    """
    writer = df.write.mode("overwrite").format(file_format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(batch_path(path, batch_id, run))


def batch_path(path, batch_id, run=None):
    return f"{path}/batch_id={batch_id}" if run is None else f"{path}/run={run}/batch_id={batch_id}"


def landed(spark, path, schema):
    """What batches have written under ``path``; no rows where none has yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_checkpoints(saved, path, batch_id=0, run=None):
    """Append saved transaction ids, with their log position where it is known.

    Call it after the batch's rows are written.
    """
    position = [c for c in ("binlog_file", "binlog_pos") if c in saved.columns]
    write_batch(
        saved.select(
            "server_uuid", F.col("seq").alias("saved_seq"), "ts_s", "gtid_set", *position
        ),
        path,
        batch_id,
        run=run,
    )


def write_kafka(records, servers, **options):
    """Send records to Kafka, at least once; needs the Kafka connector package."""
    (
        records.write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .options(**options)
        .save()
    )
