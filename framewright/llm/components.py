"""Connected components of a graph held as a table of links.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Every step groups by node with
partial aggregation and joins the minimum back, so no component is gathered in
one task; a hub's links (pairs of longs) meet in one partition of that join until
it passes the session's skew threshold, where Spark splits it.  Each round is
written to the shared folder, which cuts the lineage and outlives lost executors,
in as few files as its links need: Hadoop's local file system starts processes
for each file that it makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import forget, written

#: Links to a file of a round, about, where that makes fewer files than the shuffle has partitions.
FILE_LINKS = 100_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b").select("a", "b", "m")
    moved = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).union(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return moved.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node that has a link; a component is its smallest node.

    Null ends and links of a node with itself are ignored; direction and
    repetition do not matter; an empty table gives an empty table.
    """
    edges = written(
        links.where(F.col(a) != F.col(b))
        .select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b"))
        .distinct()
    )
    before, cores = _state(edges), edges.sparkSession.sparkContext.defaultParallelism
    for _ in range(rounds):
        last, edges = edges, written(_small(_large(edges)).coalesce(max(cores, before[0] // FILE_LINKS)))
        forget(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
