"""Connected components by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    """``x, m``: the smallest of each node and its neighbours in (x, y)."""
    return edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours hang on the smallest node around it. ``edges`` has each edge once, larger node first."""
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    return both.filter("y > x").join(_least(both).hint("merge"), "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours hang on the smallest of them."""
    least = _least(edges)
    moved = edges.join(least.hint("merge"), "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.unionByName(least.select("x", F.col("m").alias("y"))).filter("x <> y").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Does every node hang on one other node at most, and nothing on a node that hangs? Then each centre is the smallest of its component."""
    ends = edges.select(F.col("x").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("y").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or hangs = 1 and holds = 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every node of the edges; the component is its smallest node.

    The rounds grow with the squared logarithm of the nodes at most, whatever their ids, and
    no round makes more edges than there were. A node with very many neighbours is added up
    before the shuffle, and AQE splits its rows in the join. Rounds go through the shared
    checkpoint folder; nothing comes to the driver but whether they are done. Edges may repeat and
    point either way; nodes of no edge have no row.
    """
    x, y = F.col(a), F.col(b)
    stars = edges.select(F.greatest(x, y).alias("x"), F.least(x, y).alias("y")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    stars = cut_lineage(stars)
    while not _are_stars(stars):
        stars = cut_lineage(_small_star(_large_star(stars)))
    roots = stars.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return stars.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots)
