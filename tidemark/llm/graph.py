"""Connected components of an edge table by alternating stars, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import compact, cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the component's smallest node.

    Each round points every neighbour of a node to the smallest one it knows, first those above the
    node, then those below. Minima are combined before the shuffle, and a node with very many
    neighbours meets its minimum in a join that Spark can split, so no task holds a whole neighbourhood.
    Edges stay distributed; each round's result is written to the shared folder. Loops and repeated
    edges are allowed; an edge with a null end is dropped.
    """
    star = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    state = None
    while True:
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, star, rows = now, compact(star, now[0]), 2 * now[0]
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = compact(both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, large["u"] == least["k"]).select("u", "v", "m")
        # a round makes two edges of one at most
        star = cut(compact(small.select("u", F.col("m").alias("v")).unionByName(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), rows))
