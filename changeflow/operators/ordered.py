"""Order-dependent operators that never put a whole key into one task.

A plain window over ``partitionBy(key).orderBy(pos)`` sorts all rows of a key in
one task; a hot key would then hold a third of the data. The operators here cut
each key into blocks by columns that grow with the order, and run the window
inside a block. What came before a block enters it as one extra row, so the rows
are shuffled once, by key and block, and joined to nothing. The extra rows come
from one summary row per block, which are scanned the same way, block level by
block level; the coarsest level ends in a plain window over few rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 20
#: Positions in a block of an as-of join.
ASOF_ROWS = BLOCK_ROWS // 8
#: A table of at most so many rows is put in order as it is: no key of it can hold more.
PLAIN_ROWS = 1 << 16


def block_of(position, width=BLOCK_ROWS):
    """First position of the block an integer position lies in.

    A unique position fills a block with at most ``width`` rows.
    """
    return F.col(position) - F.pmod(F.col(position), F.lit(width).cast("bigint"))


def levels_of(table, columns):
    """The block columns that ``table`` needs: none where all its rows fit a task.

    Counts the rows, so the table should be a written one.
    """
    return list(columns) if table.count() > PLAIN_ROWS else []


def next_multiple(position, step):
    """The first multiple of ``step`` that is not before an integer position."""
    return F.col(position) + F.pmod(-F.col(position), F.lit(step).cast("bigint"))


def explode_ticks(spans, first, last, step, name, columns, at_once=4096):
    """One row per multiple of ``step`` from ``first`` to ``last``, with ``columns``.

    A long span is cut first, so no row ever holds more than ``at_once`` ticks, or
    one number per so many.
    """
    piece = F.lit(step * at_once).cast("bigint")
    cut = spans.select(
        *columns, last.alias("_last"), F.explode(F.sequence(first, last, piece)).alias("_from")
    )
    upto = F.least(F.col("_last"), F.col("_from") + piece - step)
    return cut.select(
        *columns,
        F.explode(F.sequence("_from", upto, F.lit(step).cast("bigint"))).alias(name),
    )


def _position(order):
    # A single column keeps the aggregate's buffer fixed-width, hence hashed.
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _with_entering_row(df, entering, side):
    """Add one row per block, before (-1) or after (1) the block's own rows."""
    return df.withColumn("_side", F.lit(0)).unionByName(
        entering.withColumn("_side", F.lit(side)), allowMissingColumns=True
    )


def running_total(df, value, keys, order, levels, name):
    """Inclusive running sum of ``value`` per ``keys`` in ``order``.

    ``levels`` lists block columns from coarse to fine. Each must not decrease
    along ``order``, and the finest, together with the coarser ones, must bound
    the rows of a block.
    """
    block = list(keys)
    ordering = list(order)
    summand = F.col(value)
    if levels:
        *coarser, finest = levels
        block = [*keys, *coarser, finest]
        totals = df.groupBy(*block).agg(F.sum(value).alias("_total"))
        totals = running_total(totals, "_total", keys, [finest], coarser, "_upto")
        entering = totals.select(*block, (F.col("_upto") - F.col("_total")).alias("_before"))
        df = _with_entering_row(df, entering, -1)
        ordering = ["_side", *ordering]
        summand = F.coalesce(F.col("_before"), F.col(value))
    frame = (
        Window.partitionBy(*block)
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = df.withColumn(name, F.sum(summand).over(frame))
    return summed.filter("_side = 0").drop("_side", "_before") if levels else summed


def last_before(df, columns, keys, order, levels):
    """Add ``_in_<column>``: the last non-null value strictly before each row."""
    block = list(keys)
    ordering = list(order)
    if levels:
        *coarser, finest = levels
        block = [*keys, *coarser, finest]
        position = _position(order)
        ends = df.groupBy(*block).agg(
            *[
                F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c)
                for c in columns
            ]
        )
        reaching = last_before(ends, columns, keys, [finest], coarser)
        entering = reaching.select(*block, *[F.col(f"_in_{c}").alias(c) for c in columns])
        df = _with_entering_row(df, entering, -1)
        ordering = ["_side", *ordering]
    frame = (
        Window.partitionBy(*block)
        .orderBy(*ordering)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = df.withColumns(
        {f"_in_{c}": F.last(c, ignorenulls=True).over(frame) for c in columns}
    )
    return found.filter("_side = 0").drop("_side") if levels else found


def carry_forward(df, columns, keys, order, levels):
    """Replace each null of ``columns`` by the last non-null value before it."""
    carried = last_before(df, columns, keys, order, levels)
    return carried.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_in_{c}")) for c in columns}
    ).drop(*[f"_in_{c}" for c in columns])


def next_after(df, column, keys, order, levels, name):
    """Add the ``column`` of the row that follows in ``order``, null after the last."""
    block = list(keys)
    ordering = list(order)
    if levels:
        *coarser, finest = levels
        block = [*keys, *coarser, finest]
        starts = df.groupBy(*block).agg(F.min_by(column, _position(order)).alias(column))
        reaching = next_after(starts, column, keys, [finest], coarser, "_following")
        entering = reaching.select(*block, F.col("_following").alias(column))
        df = _with_entering_row(df, entering, 1)
        ordering = ["_side", *ordering]
    followed = df.withColumn(
        name, F.lead(column).over(Window.partitionBy(*block).orderBy(*ordering))
    )
    return followed.filter("_side = 0").drop("_side") if levels else followed


def asof_join(left, right, keys, left_on, right_on, columns, width=ASOF_ROWS):
    """Left rows with ``columns`` of the last right row of the same keys whose
    ``right_on`` is not after ``left_on``; nulls where there is none.

    Both sides meet in one union, so neither is broadcast and the plan is the
    same for a short and a long history. A block holds at most ``width`` distinct
    positions.
    """
    def side(frame, at, number, **filled):
        return frame.select(
            *keys, F.col(at).alias("_at"), F.lit(number).alias("_right_first"),
            *[column.alias(name) for name, column in filled.items()],
        )

    both = side(right, right_on, 0, _c=F.struct(*columns)).unionByName(
        side(left, left_on, 1, _row=F.struct(*left.columns)), allowMissingColumns=True
    )
    blocked = both.withColumn("_block", block_of("_at", width))
    order = ["_at", "_right_first"]
    filled = carry_forward(blocked, ["_c"], keys, order, ["_block"])
    return filled.filter("_right_first = 1").select(
        "_row.*", *[F.col(f"_c.{c}").alias(c) for c in columns]
    )

