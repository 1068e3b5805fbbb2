"""Connected components of a link table, by alternating stars.

Every round replaces links by links to the smallest neighbour, first among larger neighbours, then
among smaller ones (large-star and small-star).  A round is two grouped minima and two equi-joins, so
no neighbourhood is ever gathered in one place; the number of rounds grows with the logarithm of the
component size.  Each round is cut with a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.plans.storage import cut_lineage


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(smallest.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` that is not itself a root; root is the smallest.

    Links may repeat, point either way or join a node with itself; links with a null end are ignored.
    No links give no rows.
    """
    current = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _signature(current)
    while before[0]:
        current = cut_lineage(_small_star(_large_star(current).distinct()).distinct())
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
