"""SimHash near-duplicates: fingerprints in BK-trees, one tree per shard.

A fingerprint has 64 bits. It is cut into ``radius + 2`` blocks; two fingerprints that
differ in at most ``radius`` bits agree in two blocks at least, so a shard holds the
fingerprints that agree in a pair of blocks. In each shard a BK-tree keeps the children of
a node by their integer Hamming distance to it, and a search follows only the edges within
the radius of the distance to the node. The tree of a shard is built where its probes are,
since the trees together grow with the corpus and are no broadcast.

A shard with more than ``TREE_NODES`` fingerprints is cut into trees of that size, and every
fingerprint of the shard probes every tree: none is left out.

From each tree only the links that join two groups go on (a spanning forest), never all
pairs, and Spark joins them to components. Equal fingerprints are one node from the start.

Null and empty texts have no words and the fingerprint zero, linked like any other. Fewer
words than a shingle make one shingle of all words. Rows that repeat stay rows. A null id
is never a component's id unless the component has no other. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import cut_lineage
from .components import stars
from .texts import encoded, portions

SHINGLE_WORDS = 3
RADIUS = 2
TREE_NODES = 1024
BLOCK = 1 << 16


def simhash(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text; A-Z count as a-z, shingles with their repeats."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = words if width == 1 else [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    h = np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed 64-bit number."""

    def run(batches):
        for batch in portions(batches, 1):
            found = np.array([simhash(t, width) for t in encoded(batch.column(1).to_pylist())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Numbers under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            at = self.children[at].setdefault((self.values[at] ^ value).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """The positions of the values at most ``radius`` away."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            at = open_nodes.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            open_nodes += [child for edge, child in self.children[at].items() if abs(edge - distance) <= radius]
        return found


class Groups:
    """Union and find over the positions of a shard."""

    def __init__(self):
        self.parent: list[int] = []

    def add(self) -> int:
        self.parent.append(len(self.parent))
        return self.parent[-1]

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def block_masks(radius: int) -> list[int]:
    """The bits of each pair of the ``radius + 2`` blocks, as signed numbers."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [(1 << e) - (1 << s) for s, e in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (x | y for x, y in combinations(blocks, 2))]


def _in_trees(rows: DataFrame, shard: list[str], tree_nodes: int) -> DataFrame:
    """Rows of shards with several nodes, dealt to trees: adds low, high (a pair of trees) and probe.

    ``rows`` has the shard columns and ``node``; a shard above ``tree_nodes`` has several
    trees, and each of its nodes meets every one of them.
    """
    sizes = rows.groupBy(*shard).agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, shard).withColumn("trees", F.ceil(F.col("n") / tree_nodes).cast("int"))
    rows = rows.withColumn("tree", F.pmod(F.xxhash64("node"), "trees").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    return rows.select(
        *shard, "node", F.least("tree", "other").alias("low"), F.greatest("tree", "other").alias("high"),
        (F.col("tree") > F.col("other")).alias("probe"),
    )


def _linked(rows: DataFrame, shard: list[str], radius: int) -> DataFrame:
    """(a, b): nodes whose fingerprints differ in at most ``radius`` bits.

    Only the links that join two groups of a pair of trees.
    """

    def run(batches):
        now, tree, groups, members = None, BKTree(), Groups(), []
        for batch in batches:
            a, b = [], []
            for *key, probe, fp, node in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    now, tree, groups, members = key, BKTree(), Groups(), []
                value = fp & 0xFFFFFFFFFFFFFFFF
                me = groups.add()
                if key[-2] == key[-1] or probe:
                    for hit in tree.within(value, radius):
                        place, other = members[hit]
                        if groups.find(place) != groups.find(me):
                            groups.join(place, me)
                            a.append(node)
                            b.append(other)
                if not probe:
                    tree.add(value)
                    members.append((me, node))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    shard = [*shard, "low", "high"]
    rows = rows.select(*shard, "probe", "fp", "node")
    return rows.repartition(*shard).sortWithinPartitions(*shard, "probe", "node").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(a, b): fingerprints (column ``fp``, each once) that differ in 1 to ``radius`` bits, enough to join all that are linked."""
    masks = F.array(*[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(block_masks(radius))])
    shard = ["pair", "bits"]
    rows = _in_trees(nodes.select(F.col("fp").alias("node"), F.inline(masks)), shard, tree_nodes)
    return _linked(rows.withColumn("fp", F.col("node")), shard, radius)


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component_id) from (node, least id) and the links between nodes."""
    star = stars(edges)
    member = star.select(F.col("a").alias("node"), F.col("b").alias("root"))
    member = member.union(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    member = member.join(nodes, "node")
    label = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = member.join(label, "root").select("node", "component_id")
    named = nodes.join(member, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    # written, so that the join with the rows of a very common node is one that Spark can split
    return cut_lineage(named)


def near_duplicates(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    tree_nodes: int = TREE_NODES,
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links of at most ``radius`` bits reach."""
    prints = cut_lineage(fingerprints(docs, width, id_col, text_col))
    nodes = prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"))
    named = _named(nodes, links(nodes.select(F.col("node").alias("fp")), radius, tree_nodes))
    return prints.join(named, prints["fp"] == named["node"]).select("doc_id", "fp", "component_id")


def one_of_each(
    docs: DataFrame,
    width: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    id_col: str = "doc_id",
    text_col: str = "text",
    tree_nodes: int = TREE_NODES,
) -> DataFrame:
    """One row of each component of ``near_duplicates``, all columns.

    A row is known by a digest of all its columns, so rows with null or repeated ids are rows like
    others. The row with the smallest id stays (null last, then the smallest digest), and
    of rows equal in all columns one. The texts are shuffled once, by that digest.
    """
    mark = "_digest"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))

    def run(batches):
        for batch in portions(batches, 2):
            found = np.array([simhash(t, width) for t in encoded(batch.column(2).to_pylist())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "digest", "fp"])

    rows = marked.select(F.col(id_col).cast("long").alias("doc_id"), F.col(mark).alias("digest"), F.col(text_col).cast("string").alias("text"))
    prints = cut_lineage(rows.mapInArrow(run, "doc_id long, digest string, fp long"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    nodes = prints.groupBy(F.col("fp").alias("node")).agg(first.alias("least"))
    named = _named(nodes, links(nodes.select(F.col("node").alias("fp")), radius, tree_nodes))
    kept = named.select(F.col("component_id.digest").alias(mark)).distinct()
    return marked.join(kept, mark, "left_semi").dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
