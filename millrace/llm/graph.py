"""Connected components of a table of links, by alternating stars.

Each round points every node at the least of its neighbours, first for the larger neighbours, then
for the smaller ones; after a logarithmic number of rounds every component is a star around its least
node. Minima are taken by grouped aggregation, so a hub's links are combined before they are shuffled,
and the joins back are plain equi-joins, which the engine splits where a hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable by links, for nodes that have a link to another node."""

    def down(pairs: DataFrame) -> DataFrame:
        """Each pair once, as (u, v) with u above v."""
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    now = written(down(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "stars")
    while True:
        # Stars: every upper node has one lower node, which is no upper node itself.
        forked = now.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).filter("lo < hi").select("u")
        chained = now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi")
        if forked.union(chained).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        both = now.union(now.select("v", "u"))
        least = both.groupBy(F.col("u").alias("m")).agg(F.min("v").alias("lo")).select("m", F.least("m", "lo").alias("lo"))
        large = written(down(both.filter("v > u").join(least, F.col("u") == F.col("m")).select(F.col("v").alias("u"), F.col("lo").alias("v"))), "stars")
        released(now)
        least = large.groupBy(F.col("u").alias("m")).agg(F.min("v").alias("lo"))
        small = large.join(least, F.col("u") == F.col("m")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("lo").alias("v")), F.struct("u", F.col("lo").alias("v")))).alias("p")).select("p.u", "p.v")
        now = written(down(small), "stars")
        released(large)
