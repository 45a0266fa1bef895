"""Sharding by minimax contiguous partition: the smallest capacity, found by binary search.

The atoms are hash bins of texts in the order of their digests, so equal texts share an
atom and no text is ever in two shards. There are always ``ATOMS`` atoms, at every size of
the corpus; only their sizes reach the driver. A binary search finds the smallest capacity
with which a greedy pass over the atoms needs no more than the given shards. The cuts hold
that capacity, and among the cuts that do each one is as near an even share as it can be.

Slots number the rows of a shard without gaps: rows are counted in ``PARTS`` parts of a
shard, the counts give each part its first slot, and a part is numbered in the order of ids.

Null texts count as empty ones and share their group; null ids come first. Rows that repeat
have slots of their own. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SHARDS = 40
ATOM_DIGITS = 4
ATOMS = 16**ATOM_DIGITS
PARTS = 1024
ROW_BYTES = 16


def fits(ends: np.ndarray, capacity: int, shards: int) -> bool:
    """Do ``shards`` shards of ``capacity`` hold the atoms, filled greedily? ``ends``: prefix sums."""
    start = 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, start + capacity, side="right"))
        if at == len(ends):
            return True
        start = int(ends[at - 1]) if at else start
    return False


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity at which contiguous shards hold all atoms."""
    ends = np.cumsum(sizes)
    if not len(sizes):
        return 0
    low, high = int(sizes.max()), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if fits(ends, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The first atom of each shard but the first; no shard exceeds the smallest capacity."""
    n = len(sizes)
    capacity = smallest_capacity(sizes, shards)
    ends = np.r_[0, np.cumsum(sizes)]
    # the first atom from which the rest fits into so many shards
    earliest = [n]
    for _ in range(shards - 1):
        at = int(np.searchsorted(ends, ends[earliest[-1]] - capacity, side="left"))
        earliest.append(at)
    out, start = [], 0
    for rest in range(shards - 1, 0, -1):
        even = ends[start] + (ends[n] - ends[start]) / (rest + 1)
        at = int(np.searchsorted(ends, even, side="left"))
        at = min(at, n)
        # the nearer end, but no shard without rows while rows are left
        if ends[at - 1] > ends[start] and even - ends[at - 1] < ends[at] - even:
            at -= 1
        most = int(np.searchsorted(ends, ends[start] + capacity, side="right")) - 1
        start = max(start, min(max(at, earliest[rest]), most))
        out.append(start)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, ATOM_DIGITS), 16, 10).cast("int").alias("atom"),
    )
    rows = cut_lineage(rows)  # texts are read once
    sizes = np.zeros(ATOMS, dtype=np.int64)
    for atom, size in rows.groupBy("atom").agg(F.sum("size")).collect():  # ATOMS rows at most
        sizes[atom] = size
    firsts = F.array(*[F.lit(c) for c in cuts(sizes, shards)]) if shards > 1 else F.array().cast("array<int>")
    atom = F.col("atom")
    rows = rows.withColumn("shard", F.size(F.filter(firsts, lambda first: first <= atom))).drop("atom")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PARTS)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.join(counts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(inside) - 1).alias("slot")
    )
