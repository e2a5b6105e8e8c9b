"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitally.session import Scratch


def _to_smallest(links: DataFrame) -> DataFrame:
    """Every neighbour of a node, and the node itself, linked to the smallest of them.

    The minimum per node is aggregated before the shuffle, so a node may have any number
    of neighbours; the join back is one that can be split where a node has many.
    """
    least = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return links.join(least, "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stars = _to_smallest(both).where(F.col("b") > F.col("a"))
    return stars.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.where("a <> b").unionByName(own).distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a, b``): the smallest node it reaches.

    Links may stand in either direction and repeat; a link of a node to itself says
    nothing. Each round rewrites the links so that they lead to smaller nodes, and the
    links are written to the shared folder after it; the end is a star per component, which
    a round leaves as it is. Nulls are not nodes. Links of earlier rounds are removed; the last
    stay in ``scratch``, or for good.
    """
    scratch = Scratch(links.sparkSession, "components") if scratch is None else scratch
    down = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    now = scratch.written(down.distinct(), "links")
    before = None
    while True:
        mark = now.agg(
            F.count("*").alias("n"),
            F.bit_xor(F.xxhash64("a", "b")).alias("h"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
        ).first()
        if tuple(mark) == before or mark["n"] == 0:
            break
        before = tuple(mark)
        after = scratch.written(_small_star(_large_star(now)), "links")
        scratch.drop(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
