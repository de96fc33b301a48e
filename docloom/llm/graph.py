"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.stored import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; root is the smallest node it reaches.

    Large and small stars in turn: each node's larger neighbours are tied to the smallest
    one, then its smaller neighbours. Edges never multiply and the rounds grow with the
    logarithm of the graph. Every round is a stored table, so a lost executor costs a read,
    and so are the smallest neighbours: a node with very many edges is then an ordinary skewed
    join key, which Spark splits.
    Self-loops and null ends are left out; repeated edges do no harm.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        both = stored(pairs, "edges")
        # the state is the edge set: equal count and hash sum mean that nothing moved
        now = tuple(both.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return both.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        pairs = _small_star(_large_star(both)).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).union(pairs.select("v", "u"))
    least = stored(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
    return both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    pairs = stored(pairs, "stars")
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))
