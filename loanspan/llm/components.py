"""Connected components of a link table by alternating large and small stars.

Each step is one shuffle of the links by node, which an aggregate and its join with the links share;
nothing is gathered by component, and the number of steps grows with the logarithm of the graph's depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import written


def _with_least(links: DataFrame) -> DataFrame:
    """`links` with `m`, the least neighbour of u or u itself; both sides of the join read one shuffle."""
    dealt = links.repartition("u")
    return dealt.join(dealt.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour; links may repeat."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them.

    All of `links` lead to smaller nodes, so the least is a neighbour: in place of its link with
    itself it gets that with the node.
    """
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return _with_least(links).select(moved.alias("u"), F.col("m").alias("v")).distinct()


def _state(links: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), digest).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    `links` has two bigint columns u, v. Nulls and loops are ignored, repeated links count once,
    no links give no rows. Every step is written in the shared folder, so a lost executor repeats
    one step at most. To add links to components found before, `stars` of these stand for all of
    their links.
    """
    current = written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    state = _state(current)
    while state[0]:
        following = written(_small_star(_large_star(current)))
        now = _state(following)
        if now == state:
            break
        current, state = following, now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def stars(roots: DataFrame) -> DataFrame:
    """Links (u, v) of every node and its root, of what `components` returns: the same components."""
    return roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
