"""Reading the standard tables, and columns that several operators share."""

import pyspark.sql.functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df, column="text"):
    """The text, empty where it is null."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def lower_ascii(column):
    """A-Z as a-z; every other character stays."""
    return F.translate(column, UPPER, UPPER.lower())


def row_key(df):
    """Names a row by its id and its text, so that rows sharing an id stay apart."""
    return F.xxhash64(df["doc_id"], text_of(df))


def keep_rows(docs, decisions, how="left_semi"):
    """Rows of ``docs`` whose row key is (``left_anti``: is not) in ``decisions.row_key``."""
    wanted = decisions.select(decisions["row_key"].alias("__wanted_row"))
    return docs.join(wanted, row_key(docs) == wanted["__wanted_row"], how)
