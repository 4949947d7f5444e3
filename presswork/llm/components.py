"""Connected components of a link table, as DataFrame operations.

Alternating rounds: every node tells its larger neighbours its smallest neighbour, then
every node keeps one link to its smallest neighbour and passes the others on. The number
of links never grows by more than the number of nodes and the number of rounds grows with
the logarithm of the component size, also for chains. Minimum links are pre-aggregated before their shuffle; the join with
them has one row per node on one side, so adaptive execution can split a hot node. Each
round is a written table in the shared folder: lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import stored


def _state(links: DataFrame) -> tuple:
    """Number of links and an order-free checksum of them."""
    return tuple(
        links.agg(
            F.count("*"),
            F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")),
            F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")),
        ).first()
    )


def _to_smaller(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _to_least(links: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
    return others.unionByName(least).distinct().withColumnRenamed("m", "v")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); root is the smallest node reachable.

    Links work both ways; loops, repeats and links with a null end add nothing, so a node
    that has no other is not in the result. No links: no rows.
    """
    ordered = links.filter("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    now = stored(ordered.distinct(), "links")
    before, state = None, _state(now)
    while state[0] and state != before:
        now = stored(_to_least(_to_smaller(now)), "links")
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
