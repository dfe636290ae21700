"""Joining the leaves of a packed tree: pairs of nodes from the root down, without the hopeless ones.

Leaves are numbered in the order of a sequence; ``FANOUT`` neighbours have one parent, whose box holds
theirs. The recursion pairs a node with itself and with later nodes, and each step replaces the pairs
that may hold a match with the pairs of their children. A level is one join, whatever its size. Levels
and their pairs are stored, as a plan over all of them has its levels many times over, and the driver
plans, describes and keeps it anew with each of its stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import stored

FANOUT = 16

Side = Callable[[str], Column]


def leaf_pairs(
    leaves: DataFrame,
    space: list[str],
    box: dict[str, Callable[[Column], Column]],
    may_match: Callable[[Side, Side], Column],
) -> DataFrame:
    """(*space, a, b) with a <= b: the pairs of leaves of a space whose boxes may match.

    ``leaves`` has the columns of ``space``, ``leaf`` (from 0 in each space) and the columns of the
    boxes; ``box`` tells how each of these is combined for a parent. ``may_match`` gets two functions
    from a column's name to that column of either side, and must hold for a pair of boxes that
    contains a match.
    """
    levels = [leaves.select(*space, F.col("leaf").alias("node"), *box)]
    last = leaves.agg(F.max("leaf")).first()[0] or 0
    while last >= 1:
        last //= FANOUT
        parent = F.floor(F.col("node") / FANOUT).alias("node")
        above = (
            levels[-1]
            .groupBy(*space, parent)
            .agg(*(combine(F.col(c)).alias(c) for c, combine in box.items()))
        )
        levels.append(stored(above, "level"))
    top = levels.pop()
    pairs = top.select(*space, F.col("node").alias("a"), F.col("node").alias("b"))

    def renamed(level: DataFrame, side: str) -> DataFrame:
        return level.select(
            *(F.col(c).alias(f"{side}_{c}") for c in space),
            F.col("node").alias(f"{side}_node"),
            F.floor(F.col("node") / FANOUT).alias(f"{side}_parent"),
            *(F.col(c).alias(f"{side}_{c}") for c in box),
        )

    def joins(side: str) -> Column:
        on = F.col(side) == F.col(f"{side}_parent")
        for c in space:
            on = on & (F.col(c) == F.col(f"{side}_{c}"))
        return on

    while levels:
        level = levels.pop()
        near = (F.col("a_node") <= F.col("b_node")) & may_match(
            lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")
        )
        pairs = (
            pairs.join(renamed(level, "a"), joins("a"))
            .join(renamed(level, "b"), joins("b"))
            .where(near)
            .select(*space, F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        )
        if levels:
            pairs = stored(pairs, "node-pairs")
    return pairs

