"""Resolving rows against the column catalog."""

from pyspark.sql import functions as F

from changeflow.operators.filters import allowed
from changeflow.operators.intervals import locate
from changeflow.operators.ordered import ASOF_ROWS, BLOCK_ROWS, asof_join, block_of, levels_of, next_after
from changeflow.session import written

TABLE = ["schema_name", "table_name"]


def prepare_catalog(catalog):
    """Add the columns in name order and where each one sits in a row.

    Done once per table, so that no row sorts its own values.
    """
    by_name = F.array_sort(
        F.transform(
            F.col("columns"), lambda name, i: F.struct(name.alias("name"), i.alias("at"))
        )
    )
    return catalog.withColumn("_by_name", by_name).select(
        *catalog.columns,
        F.col("_by_name.name").alias("sorted_columns"),
        F.col("_by_name.at").alias("sorted_at"),
    )


def catalog_lookup(rows, catalog):
    """Rows of known tables, with the catalog's columns.

    No broadcast hint: Spark broadcasts a catalog whose size it knows to be
    under its limit, and otherwise joins by sort-merge, where adaptive
    execution splits the partition of a hot table.
    """
    return rows.join(catalog, TABLE, "inner")


def unknown_tables(rows, catalog):
    """Rows of tables the catalog does not have."""
    return rows.join(catalog, TABLE, "left_anti")


def arity_ok():
    """Predicate: the row images have as many values as the catalog columns.

    Checks the old image of an update as well as the new one. A missing image does not
    fit; null for an unknown table.
    """

    def fits(row):
        return F.coalesce(F.size(row), F.lit(-1)) == F.col("n_cols")

    return fits("new_row") & ((F.col("action") != "update") | fits("old_row"))


def arity_mismatch(resolved):
    return resolved.filter(~arity_ok())


def upsert_catalog(versions, schemas=(), tables=()):
    """The newest version of every allowed table."""
    newest = (
        versions.filter(allowed(schemas, tables))
        .groupBy(*TABLE)
        .agg(F.max(F.struct("valid_from", "columns", "n_cols")).alias("_v"))
    )
    return newest.select(*TABLE, "_v.columns", "_v.n_cols", "_v.valid_from")


def resolve_latest(changes, versions):
    """Changes with the newest schema of their table, whatever their age."""
    return changes.join(upsert_catalog(versions), TABLE, "left")


def resolve_as_of(changes, versions, width=BLOCK_ROWS):
    """Changes with the schema that was valid at their own ``seq``.

    A version holds from its ``valid_from`` up to the next one of its table. Of versions with one
    ``valid_from`` the largest counts. A long history meets the changes in one union, so that each change is
    shuffled once (``asof_join``). Of one that fits a task, a change at or after its table's newest version is
    settled by an equi-join on the table alone and earlier ones are looked up by ``locate``: Spark broadcasts
    a short history and the log stays where it is. ``width`` bounds the blocks in which a table's rows are put in
    order.

    Resolve events before exploding their rows: all rows of an event share it.
    """
    single = written(distinct_versions(versions), "versions")
    # Only a table can be put in order; a stream meets a long history by joins too.
    if not changes.isStreaming and levels_of(single, ["_block"]):
        dated = single.filter("valid_from IS NOT NULL")
        fields = ["columns", "n_cols", "valid_from"]
        return asof_join(changes, dated, TABLE, "seq", "valid_from", fields, min(width, ASOF_ROWS))
    spans = written(version_spans(single, width), "version-spans")
    newest = spans.filter("_next IS NULL").select(
        *[F.col(c).alias(f"_newest_{c}") for c in TABLE], F.col("valid_from").alias("_newest_from")
    )
    closed = spans.filter("_next IS NOT NULL").select(
        *TABLE, F.col("valid_from").alias("_closed_from"), (F.col("_next") - 1).alias("_until")
    )
    headed = changes.join(newest, _same_table(changes, newest, "_newest_"), "left")
    is_newest = F.col("seq") >= F.col("_newest_from")
    found = locate(headed, TABLE, "seq", closed, "_closed_from", "_until", ["_closed_from"], settled=is_newest)
    placed = found.withColumn("_from", F.when(is_newest, F.col("_newest_from")).otherwise(F.col("_closed_from")))
    held = spans.select(
        *[F.col(c).alias(f"_v_{c}") for c in TABLE], F.col("valid_from").alias("_v_from"), "columns", "n_cols"
    )
    valid = _same_table(placed, held, "_v_") & (placed["_from"] == held["_v_from"])
    return placed.join(held, valid, "left").select(
        *[placed[c] for c in changes.columns], "columns", "n_cols", F.col("_from").alias("valid_from")
    )


def distinct_versions(versions):
    """One version per table and ``valid_from``, the largest."""
    largest = versions.groupBy(*TABLE, "valid_from").agg(F.max(F.struct("columns", "n_cols")).alias("_v"))
    return largest.select(*TABLE, "valid_from", "_v.columns", "_v.n_cols")


def version_spans(single, width=BLOCK_ROWS):
    """Distinct versions with the ``valid_from`` of the next one of their table in ``_next``."""
    placed = single.withColumn("_block", block_of("valid_from", width))
    return next_after(placed, "valid_from", TABLE, ["valid_from"], levels_of(single, ["_block"]), "_next").drop("_block")


def _same_table(left, right, prefix):
    schema, table = (left[c].eqNullSafe(right[f"{prefix}{c}"]) for c in TABLE)
    return schema & table
