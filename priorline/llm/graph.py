"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.common import stage


def _directed(pairs: DataFrame) -> DataFrame:
    """Each pair once, larger node first."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node it sees."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of ``pairs`` (columns a, b); the component is its least node.

    Each round keeps at most as many edges as came in, nothing is gathered per node, and a hub is an
    ordinary skewed join.  The number of rounds grows with the logarithm of the longest chain.
    Rows with a null end and self-pairs are ignored; an empty table gives an empty table.
    """
    pairs = pairs.filter("a IS NOT NULL AND b IS NOT NULL")
    edges, seen = stage(_directed(pairs), "edges"), None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        edges = stage(_directed(_small_star(_directed(_large_star(edges)))), "edges")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
