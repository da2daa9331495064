"""Connected components of an edge table, by alternating stars.

Defined cases: repeated edges, edges of a node to itself and edges with a null
end change nothing; an empty table has no components; other columns are ignored.
The order of rows and ties do not matter, as a component is named by its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _toward_least(pairs: DataFrame) -> DataFrame:
    """pairs (x, y) with m, the least of x and its ys."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return pairs.join(least, "x")


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x > y").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node with an edge can reach, itself left out.

    Large stars link a node's greater neighbours to its least one, small stars
    its lesser ones; both keep the components, and in turn they end in one star
    a component after about log(nodes) rounds. A hub is no hot group: its least
    neighbour is a partial aggregate, and the join on it can be split.
    Each round is written to the shared folder, which cuts the lineage.
    """
    now = written(_edges(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _edges(_toward_least(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")))
        star = _toward_least(large)
        small = _edges(star.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(star.select("x", F.col("m").alias("y"))))
        before, now = now, written(small)
        forget(before)
        row = now.agg(F.count("*"), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.shiftright(F.xxhash64("y", "x"), 32))).first()
        if tuple(row) == mark:
            return now.select(F.col("x").alias("node"), F.col("y").alias("component"))
        mark = tuple(row)
