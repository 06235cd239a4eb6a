"""The column catalog from a table of columns."""

from pyspark.sql import functions as F

from changeflow.operators.catalog import TABLE
from changeflow.operators.filters import allowed


def catalog_scan(catalog_columns, schemas=(), tables=()):
    """One row per allowed table, with its columns in order.

    ``catalog_columns`` has ``ordinal`` and ``column_name`` per table, as an
    ``information_schema.columns`` table does.
    """
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "column_name")))
    return (
        catalog_columns.filter(allowed(schemas, tables))
        .groupBy(*TABLE)
        .agg(listed.alias("_c"))
        .select(
            *TABLE,
            F.col("_c.column_name").alias("columns"),
            F.size("_c").alias("n_cols"),
        )
    )


def jdbc_catalog_columns(spark, url, **options):
    """The columns of a MySQL-compatible source; needs its JDBC driver.

    The allow-lists of ``catalog_scan`` are pushed down to the source.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable="information_schema.columns", **options)
        .load()
        .select(
            F.col("TABLE_SCHEMA").alias("schema_name"),
            F.col("TABLE_NAME").alias("table_name"),
            F.col("ORDINAL_POSITION").cast("int").alias("ordinal"),
            F.col("COLUMN_NAME").alias("column_name"),
        )
    )
