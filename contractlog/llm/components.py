"""Connected components of a link table, by alternating star contractions.

Each round replaces links by shorter ones that keep the components (the large-star
and small-star steps of Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014). Both steps take a minimum by node, which Spark combines before it
shuffles, and an equi-join that adaptive execution can split, so a node with a third
of all links costs no single task. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contractlog.llm.common import Scratch

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(
        F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")
    ).select("l.a", "l.b").where("a <> b")


def _settled(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none to a lesser one itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of links(a, b); component: the least node it reaches.

    Null ends and loops are ignored; repeated links count once; no links give no rows.
    """
    current = scratch.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    for k in range(1, MOST_ROUNDS):
        if _settled(current):
            break
        large = _large_star(current).distinct()
        current = scratch.write(_small_star(large).distinct(), f"{name}-{k}")
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    # settled: every link leads from a node to the least node of its component
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
