"""Beta-binomial shrinkage of grouped outcomes towards the rate of the level above."""

import pyspark.sql.functions as F

WEAKEST, STRONGEST = 2.0, 1000.0


def strength(groups):
    """Prior strength of a level, by the method of moments, as a scalar column.

    ``groups`` has n and s of each group and ``parent``, the rate of the level above. The more groups
    differ beyond chance, the weaker the prior; it stays within limits, and is strongest where
    nothing can be told.
    """
    mean = F.col("parent")
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2) / (mean * (1 - mean)))
    room = F.sum(F.col("n") - 1)
    excess = (spread - F.count("*")) / room
    weak = F.least(F.greatest(1 / excess - 1, F.lit(WEAKEST)), F.lit(STRONGEST))
    usable = F.when(room > 0, F.when(excess > 0, weak).otherwise(F.lit(STRONGEST))).otherwise(F.lit(STRONGEST))
    return groups.where("n > 0").agg(usable.alias("k")).scalar()


def shrunk(groups):
    """``groups`` with k and the posterior rate p."""
    with_k = groups.withColumn("k", strength(groups))
    return with_k.withColumn("p", (F.col("s") + F.col("k") * F.col("parent")) / (F.col("n") + F.col("k")))


def overall(groups):
    """The rate over all groups, with one outcome of each kind added, as a scalar column."""
    good, all_ = (F.coalesce(F.sum(c), F.lit(0)) for c in ("s", "n"))
    return groups.agg(((good + 1.0) / (all_ + 2.0)).alias("rate")).scalar()
