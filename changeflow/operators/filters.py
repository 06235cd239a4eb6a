"""Allow-lists and routing."""

from functools import reduce

from pyspark.sql import functions as F


def _all_of(conditions):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def allowed(schemas=(), tables=()):
    """Predicate: schema and table are both listed; an empty list lists all.

    Table names are compared without their schema, so a listed name matches in
    every listed schema.
    """
    conditions = []
    if schemas:
        conditions.append(F.col("schema_name").isin(*schemas))
    if tables:
        conditions.append(F.col("table_name").isin(*tables))
    return _all_of(conditions)


def allow_rows(changes, schemas=(), tables=()):
    """Row changes of the allowed tables."""
    return changes.filter((F.col("action") != "ddl") & allowed(schemas, tables))


def allow_ddl(changes, schemas=(), tables=(), ddl_ignores_table_list=False):
    """DDL changes of the allowed schemas.

    DDL carries no table name to test, so a table list lets none through
    unless ``ddl_ignores_table_list`` is set.
    """
    ddl = F.col("action") == "ddl"
    if tables and not ddl_ignores_table_list:
        return changes.filter(ddl & F.lit(False))
    return changes.filter(ddl & allowed(schemas))


def allow_changes(changes, schemas=(), tables=(), ddl_ignores_table_list=False):
    """Rows and DDL of the allowed tables in one pass over the log."""
    keep_rows = (F.col("action") != "ddl") & allowed(schemas, tables)
    if tables and not ddl_ignores_table_list:
        return changes.filter(keep_rows)
    return changes.filter(keep_rows | ((F.col("action") == "ddl") & allowed(schemas)))


def route(messages, kind):
    """Messages of one kind: ``position``, ``gtid``, ``ddl`` or ``rows``."""
    return messages.filter(F.col("kind") == kind)
