"""Shapes of the tables the operators read and write."""

from pyspark.sql import types as T

ROW_ACTIONS = ("insert", "update", "delete")

#: One row per change event. ``seq`` numbers the events of a log in order, without
#: large gaps: blocks of ``seq`` values stand for blocks of rows; ``sources.number_changes`` makes such
#: numbers. ``row_images`` holds positional values; update events alternate before and after images.
#: ``query`` to ``status_vars`` are set for DDL only. Unsigned 32-bit source values
#: (timestamps, positions) do not fit INT and are BIGINT.
CHANGE_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts_s", T.LongType()),
        T.StructField("server_uuid", T.StringType()),
        T.StructField("gno", T.LongType()),
        T.StructField("binlog_file", T.StringType()),
        T.StructField("binlog_pos", T.LongType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("error_code", T.IntegerType()),
        T.StructField("execution_time", T.LongType()),
        T.StructField("status_vars", T.BinaryType()),
        T.StructField("row_images", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

#: Column catalog, one row per table (or per table version, by ``valid_from``).
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("n_cols", T.IntegerType()),
        T.StructField("valid_from", T.LongType()),
    ]
)

#: Saved progress, one row per kept transaction id.
CHECKPOINT_SCHEMA = T.StructType(
    [
        T.StructField("server_uuid", T.StringType()),
        T.StructField("saved_seq", T.LongType()),
        T.StructField("ts_s", T.LongType()),
        T.StructField("gtid_set", T.StringType()),
        T.StructField("binlog_file", T.StringType()),
        T.StructField("binlog_pos", T.LongType()),
    ]
)

#: Row messages as the relay stores them; images are kept for those not delivered only.
ROW_LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("row_index", T.IntegerType()),
        T.StructField("ts_s", T.LongType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("old_row", T.ArrayType(T.StringType())),
        T.StructField("new_row", T.ArrayType(T.StringType())),
        T.StructField("value", T.StringType()),
    ]
)

_TYPED_ROW = T.ArrayType(T.VariantType())


def typed(schema):
    """A schema with typed row values (VARIANT) in place of texts."""
    kinds = {"old_row": _TYPED_ROW, "new_row": _TYPED_ROW, "row_images": T.ArrayType(_TYPED_ROW)}
    return T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType), f.nullable) for f in schema.fields])
