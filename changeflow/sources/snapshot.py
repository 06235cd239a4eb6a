"""The initial dump of tables, ahead of their changes."""

from functools import reduce

from pyspark.sql import functions as F

from changeflow.functions import bytes_to_text, table_key


def snapshot_rows(table, schema_name, table_name, ts_s=0, value_type="string"):
    """Every row of a table as an insert message.

    ``value_type`` is that of the change log's row values: ``string`` or
    ``variant``. Bytes become text either way.
    """
    table = bytes_to_text(table)
    values_type = f"array<{value_type}>"
    return table.select(
        F.lit(0).alias("phase"),
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(ts_s).cast("bigint").alias("ts_s"),
        F.lit(schema_name).alias("schema_name"),
        F.lit(table_name).alias("table_name"),
        F.lit("insert").alias("action"),
        F.lit(None).cast(values_type).alias("old_row"),
        F.array(*[F.col(c).cast(value_type) for c in table.columns]).alias("new_row"),
    )


def in_scope(schema_name, table_name, databases=(), tables=()):
    """Whether the dump covers a table: of the listed databases, or of the listed
    tables if exactly one database is listed; nothing listed covers all."""
    if databases and schema_name not in databases:
        return False
    if tables and len(databases) == 1:
        return table_name in tables
    return True


def bootstrap(tables_by_name, rows, databases=(), tables=(), ts_s=0, from_seq=None):
    """Snapshot rows of the tables in scope (phase 0), then the changes (phase 1).

    ``from_seq`` is the first change after the dump: earlier ones are in its rows already.

    ``tables_by_name`` maps ``(schema, table)`` to a DataFrame. Order the result
    by ``(phase, seq)``; snapshot rows have no order among themselves.
    """
    value_type = rows.schema["new_row"].dataType.elementType.simpleString()
    dumps = [
        snapshot_rows(frame, schema, name, ts_s, value_type)
        for (schema, name), frame in tables_by_name.items()
        if in_scope(schema, name, databases, tables)
    ]
    if from_seq is not None:
        rows = rows.filter(F.col("seq") >= from_seq)
    changes = rows.withColumn("phase", F.lit(1)).select(
        "phase", "seq", "ts_s", "schema_name", "table_name", "action", "old_row", "new_row"
    )
    union = reduce(lambda a, b: a.unionByName(b), [*dumps, changes])
    return union.withColumn("key", table_key())
