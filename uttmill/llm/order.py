"""Places of rows in the order of their group, whatever the size of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows of the table of partition offsets that may be broadcast (about 10 MB)
BROADCAST_STARTS = 100_000


def places(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place in the group from 0, and ``size``, the rows of the group.

    The rows are sorted by range over group and order, and written: partition and row are then
    facts on disk. A group may fill many partitions. A place is the row in its partition plus
    the group's rows in the partitions before, from a table with one row per group and
    partition, which has no more rows than there are groups and partitions together.
    Rows equal in group and order keep any places among them.
    """
    lined = cut_lineage(rows.orderBy(F.col(group), *order)).withColumn("_at", F.monotonically_increasing_id())
    lined = lined.withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        lined.groupBy(group, "_part")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(
            group, "_part",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(Window.partitionBy(group)).alias("size"),
        )
    )
    starts = cut_lineage(starts)
    if starts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    return lined.join(starts, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
