"""Connected components of a graph given as edges, by alternating star operations.

Each round lets every node point to the smallest node it knows (large star: for its larger
neighbours; small star: for its smaller ones), which only needs minima per node and equi-joins: no
neighbourhood is ever gathered, so a hub may hold a third of all edges. Rounds are written tables,
and the number of rounds grows with the logarithm of the longest path.
"""

import pyspark.sql.functions as F

from changeflow.session import written


def _star(edges, larger):
    """Point the larger (or the other) neighbours of each node to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    if larger:
        pairs = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = both.where("v < u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        pairs = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return pairs.where("u <> v").distinct()


def _state(edges):
    row = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def components(edges):
    """``node, root`` for every node of ``edges(u, v)`` that is not its component's smallest.

    The smallest node of a component is its root.
    """
    current = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    state = _state(current)
    while state[0]:
        current = written(_star(_star(current, True), False), "edges")
        before, state = state, _state(current)
        if before == state:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
