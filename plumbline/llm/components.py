"""Connected components of a table of edges, by alternating large-star and small-star steps.

Every step is a minimum by node and a join; edges never leave the executors. The steps double the reach
of each node's smallest neighbour, so their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), numbers; the root is the component's least node."""
    stars = stored(_tidy(edges).distinct(), "edges")
    mark = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        stars = stored(_small_star(_large_star(stars)), "edges")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def star_steps(edges: DataFrame, steps: int) -> DataFrame:
    """(a, b), a > b, after some steps: edges between the same components, drawn to their least nodes."""
    stars = _tidy(edges)
    for _ in range(steps):
        stars = stored(_small_star(_large_star(stars)), "edges")
    return stars.select(F.col("u").alias("a"), F.col("v").alias("b"))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the least node around it. Edges are (u, v), u > v."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("center"), F.least("u", "m").alias("m")
    )
    larger = around.where("v > u").join(least, F.col("u") == F.col("center"))
    smaller = least.where("m < center").select(F.col("center").alias("u"), F.col("m").alias("v"))
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smaller).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the least of them."""
    least = edges.groupBy(F.col("u").alias("center")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("center")).where("v > m")
    own = least.select(F.col("center").alias("u"), F.col("m").alias("v"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()
