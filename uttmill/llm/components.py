"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every node but the smallest of its component, and that smallest node.

    Each round is written to the checkpoint folder, and only its size and digest come to
    the driver. Null ends make no edge; an empty table gives an empty result.
    """
    now, last = cut_lineage(_sides(edges.where("a is not null and b is not null"))), None
    while True:
        digest = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if digest == last or not digest[0]:
            return now
        last = digest
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that both sides of the join are shuffles and Spark can split a hub
        lowest = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")))
        large = both.join(lowest, "a").where("b > a").select("b", F.least("m", "a").alias("m"))
        large = cut_lineage(_sides(large.select(F.col("b").alias("a"), F.col("m").alias("b"))))
        lowest = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(_sides(small.union(lowest.select("a", F.col("m").alias("b")))))
