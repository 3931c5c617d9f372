"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.util import materialise


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (all greater ones, or all not greater and itself)
    move to the least of the node and its neighbours."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("least"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        out = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the least node reachable.

    ``links``: columns a and b, integers, in any direction and number. Links of
    a node to itself and null ends link nothing. Each round is written to the
    shared folder; rounds grow with the logarithm of the longest path. Neither
    links nor nodes come to the driver, only a count and a checksum a round.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "links")  # a round reads them several times
    before, n = None, links.count()
    while True:
        # a round has no more links than nodes, of which there are two a link at most
        links = materialise(_stars(_stars(links, True), False), "stars", 2 * n)
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = mark, mark[0]
