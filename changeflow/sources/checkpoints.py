"""Saved progress."""

from pyspark.sql import functions as F

from changeflow.functions import set_ranges, trim_space


def read_checkpoint(checkpoints):
    """The last saved transaction id, one row always.

    An empty table gives the empty set, which means: start from the beginning.
    """
    return checkpoints.agg(
        F.coalesce(trim_space(F.max_by("gtid_set", "saved_seq")), F.lit("")).alias("gtid_set"),
        F.max("saved_seq").alias("saved_seq"),
    )


def read_checkpoints(checkpoints):
    """The last saved transaction id of every server, one row each.

    An empty table gives no row, which means: start every server from the beginning.
    """
    return checkpoints.groupBy("server_uuid").agg(
        trim_space(F.max_by("gtid_set", "saved_seq")).alias("gtid_set"),
        F.max("saved_seq").alias("saved_seq"),
    )


def executed_ranges(sets, column="gtid_set"):
    """The inclusive intervals of transaction-set texts, as ``skip_executed`` takes them.

    Overlapping intervals, also of different rows, are kept as they are. An entry that
    names no interval, and a null or empty text, adds nothing.
    """
    return sets.select(F.explode(set_ranges(F.col(column))).alias("_r")).select("_r.*").distinct()
