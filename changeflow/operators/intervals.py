"""Looking numbers up in intervals, with an index that grows with the intervals and not with the numbers.

An interval is cut into dyadic pieces: aligned blocks of 2**width numbers, at most two of each width, so
80 for an interval up to 10**12. A number lies in one block of each width, so it is looked up by one
equi-join key per width that its keys' intervals use.
"""

from pyspark.sql import functions as F

from changeflow.operators.ordered import asof_join
from changeflow.session import written

TOP = 62
LAST = (1 << TOP) - 1


def _shifted(value, width):
    return F.call_function("shiftright", value, width)


def dyadic_pieces(start, end):
    """The pieces of ``start .. end`` (inclusive, below 2**62) as an array of (width, number)."""

    def of_width(width):
        low, high = -_shifted(-start, width), _shifted(end + 1, width)

        def piece(odd, number):
            taken = (low < high) & (odd.bitwiseAND(F.lit(1).cast("bigint")) == 1)
            return F.when(taken, F.struct(width.alias("width"), number.alias("number")))

        return F.array(piece(low, low), piece(high, high - 1))

    # No piece is wider than its interval; one width more covers the logarithm's rounding.
    most = F.least(F.floor(F.log2(F.greatest(end - start + 1, F.lit(1)))) + 1, F.lit(TOP)).cast("int")
    widths = F.sequence(F.lit(0), most)
    return F.filter(F.flatten(F.transform(widths, of_width)), lambda p: p.isNotNull())


def locate(frame, keys, value, intervals, start, end, columns, settled=None):
    """Rows of ``frame`` with ``columns`` of the interval of their ``keys`` that holds ``value``.

    The intervals of a key must be disjoint and leave no gap from the first to the last; then a number
    between these meets exactly one piece. Rows outside, with a null value or of a key without intervals
    get nulls; so do rows for which ``settled`` holds, which are not looked up. Null keys are equal.

    Pieces are written as a table, so Spark knows their size: it broadcasts few, and the frame stays where
    it is. Every interval adds at most two pieces per width; every row is tried once per width in use
    for its key, without leaving its task. Pieces beyond Spark's broadcast limit would have every try
    shuffled: then rows and intervals meet in one union, in which a row is shuffled once (``asof_join``).
    A stream cannot be put in order and keeps its tries.
    """
    pieces = written(
        intervals.select(
            *[F.col(k).alias(f"_of_{k}") for k in keys],
            F.col(start).alias("_start"),
            F.col(end).alias("_end"),
            F.explode(dyadic_pieces(F.col(start), F.least(F.col(end), F.lit(LAST)))).alias("_p"),
            *columns,
        ).select("*", F.col("_p.width").alias("_width"), F.col("_p.number").alias("_number")).drop("_p"),
        "interval-pieces",
    )
    if not frame.isStreaming and not _broadcasts(pieces):
        return _in_order(frame, keys, value, intervals, start, end, columns, settled)
    heads = pieces.groupBy(*[F.col(f"_of_{k}").alias(f"_head_{k}") for k in keys]).agg(
        F.collect_set("_width").alias("_widths"), F.min("_start").alias("_low"), F.max("_end").alias("_high")
    )
    looked_up = F.col(value).between(F.col("_low"), F.col("_high"))
    if settled is not None:
        looked_up = looked_up & ~F.coalesce(settled, F.lit(False))
    keyed = frame.join(heads, _equal(frame, heads, keys, "_head_"), "left").withColumn(
        "_try", F.explode_outer(F.when(looked_up, F.col("_widths")))
    )
    keyed = keyed.withColumn("_at", _shifted(F.col(value), F.col("_try")))
    met = _equal(keyed, pieces, keys, "_of_") & (keyed["_try"] == pieces["_width"]) & (keyed["_at"] == pieces["_number"])
    # Every row that is looked up meets one piece, so its other tries can be dropped.
    return (
        keyed.join(pieces, met, "left")
        .filter(F.col("_try").isNull() | F.col("_start").isNotNull())
        .select(*[frame[c] for c in frame.columns], *columns)
    )


def _broadcasts(table):
    """Whether Spark broadcasts a written table by its size."""
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def _in_order(frame, keys, value, intervals, start, end, columns, settled):
    """``locate`` by the last interval that starts at or before ``value``."""
    held = intervals.filter(F.col(start) <= F.col(end)).select(
        *keys, F.col(start).alias("_start"), F.col(end).alias("_end"), *columns
    )
    is_settled = F.lit(False) if settled is None else F.coalesce(settled, F.lit(False))
    found = asof_join(frame.withColumn("_settled", is_settled), held, keys, value, "_start", ["_end", *columns])
    inside = (F.col(value) <= F.col("_end")) & ~F.col("_settled")
    return found.select(*frame.columns, *[F.when(inside, F.col(c)).alias(c) for c in columns])


def _equal(left, right, keys, prefix):
    found = F.lit(True)
    for k in keys:
        found = found & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return found
