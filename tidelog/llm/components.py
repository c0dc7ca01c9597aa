"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step hangs every node on the least node it can see, and the steps end when
the table no longer changes, after about the logarithm of the longest path.
Links never leave the executors; each step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """The least neighbour ``m`` of each node ``a``.

    A node may have very many neighbours.  Spark splits such a node's rows in a
    join only if both sides come straight from an exchange.  An aggregate by the
    join's key would be joined where it stands, so it is made by another
    expression of the key, and this side, a row for each node, is dealt out again.
    """
    return pairs.groupBy(F.bitwise_not("a").alias("k")).agg(F.min("b").alias("m")).select(F.bitwise_not("k").alias("a"), "m")


def _large_star(links: DataFrame) -> DataFrame:
    """Links (a > b): every greater neighbour of a node moves to that node's least neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links (a > b): the lesser neighbours of a node, and the node itself, move to the least of them."""
    least = _least(links)
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) long links -> (node, root) for every node with a link; the root is the least node of its component.

    Links may come in any direction and be repeated; self-links and nulls are
    ignored.  Without links the result is empty.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = materialize(now.where("a <> b").distinct(), "links")
    before = _digest(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), "links")
        after = _digest(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
