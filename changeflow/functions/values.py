"""Column functions over row values."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_key(schema_name="schema_name", table_name="table_name"):
    return F.concat_ws(".", F.col(schema_name), F.col(table_name))


def body_bytes(body):
    """Length in bytes, not characters."""
    return F.octet_length(body)


def named_values(columns, row):
    """Map column names to positional values; null unless the lengths agree."""
    return F.when(F.size(columns) == F.size(row), F.map_from_arrays(columns, row))


def bytes_to_text(df):
    """Decode every binary column, and binaries inside arrays, to text.

    Do this before values become JSON or VARIANT: both would show base64.
    """
    binary_array = T.ArrayType(T.BinaryType())
    nested_array = T.ArrayType(binary_array)

    def decoded(field):
        if isinstance(field.dataType, T.BinaryType):
            return F.col(field.name).cast("string").alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            if field.dataType.simpleString() == binary_array.simpleString():
                return F.col(field.name).cast("array<string>").alias(field.name)
            if field.dataType.simpleString() == nested_array.simpleString():
                return F.col(field.name).cast("array<array<string>>").alias(field.name)
        return F.col(field.name)

    return df.select(*[decoded(field) for field in df.schema.fields])
