"""Merkle manifest of a data set, with proofs, by slot pivot.

A row is a leaf: the digest of its fields. The leaves of a group (source) ascend by id; every
``FANOUT`` consecutive nodes become the digest of their concatenation until one node is left,
the *subroot*. The subroots, by group, make a tree in the same way, and its top is the *root*.

A level is a *slot pivot*: nodes are grouped by parent, and conditional aggregates spread the
children into one column per slot. The columns concatenated are hashed to the parent; all but
the own slot's column are the siblings of a child, kept as what stands before and after it.
``CLIMB`` levels share one exchange, as nodes are dealt by the block that they will end in,
a few hundred nodes, so a group of any size is many blocks. The siblings inside a block travel with the
block's rows; those above it come from the node table of the blocks, which is hundreds of times
smaller. No proof is shuffled with a row.

Null fields count as ``-``, null groups are a group of their own, before all others, and null
ids come before all ids. Rows of a group with the same id stand by their leaves, so equal rows have
equal leaves, places next to each other, and proofs of their own, of which either may get either. An
empty table gives an empty result; empty and long texts are values like others. Columns that
are not fields are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .order import places

FANOUT = 3
#: levels between two exchanges; blocks hold FANOUT ** CLIMB nodes
CLIMB = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Byte count, colon, value; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return digest(*[field(c) for c in fields.values()])


def climbed(nodes: DataFrame, proofs: bool = False, levels: int = CLIMB) -> DataFrame:
    """The nodes ``levels`` levels up: tree, size, pos, digest.

    ``nodes``: tree, size (nodes of the tree), pos, digest, and with ``proofs`` an ``item``;
    then each result has ``below``: the items under it, each with its steps up to the result.
    A tree of one node stays as it is.
    """
    own = "digest"
    if proofs:
        nodes = nodes.withColumn("below", F.array(F.struct("item", F.array().cast(STEPS).alias("steps"))))
        own += ", below"
    pivot = [F.expr(f"first(CASE WHEN pos % {FANOUT} = {s} THEN struct({own}) END, true) AS slot{s}") for s in range(FANOUT)]
    parent = ["tree", "block", f"ceil(size / {FANOUT}) AS size", "parent AS pos", f"CASE WHEN size > 1 THEN {PARENT} ELSE slot0.digest END AS digest"]
    if proofs:
        parent.append(f"CASE WHEN size > 1 THEN flatten(array_compact(array({', '.join(map(_stepped, range(FANOUT)))}))) ELSE slot0.below END AS below")
    rows = nodes.selectExpr("tree", "size", "pos", *own.split(", "), f"floor(pos / {FANOUT**levels}) AS block")
    rows = rows.repartition("tree", "block")
    for _ in range(levels):
        rows = rows.groupBy("tree", "block", "size", F.expr(f"floor(pos / {FANOUT}) AS parent")).agg(*pivot).selectExpr(*parent)
    return rows.drop("block")


def _children(slots) -> str:
    """SQL for the digests in some slots, one after the other."""
    return "concat('', " + ", ".join(f"coalesce(slot{s}.digest, '')" for s in slots) + ")" if slots else "''"


#: SQL for the digest of a parent
PARENT = f"sha2({_children(range(FANOUT))}, 256)"


def _stepped(slot: int) -> str:
    """SQL for the items below a slot, one step longer; null if no child has it."""
    step = f"struct({_children(range(slot))} AS before, {_children(range(slot + 1, FANOUT))} AS after)"
    return f"transform(slot{slot}.below, x -> struct(x.item AS item, concat(x.steps, array({step})) AS steps))"


class Forest:
    """Trees over nodes (tree, size, pos, digest, and any further columns, kept as items)."""

    def __init__(self, nodes: DataFrame):
        rest = [c for c in nodes.columns if c not in ("tree", "size", "pos", "digest")]
        self.rounds = [nodes.select("tree", "size", "pos", "digest", F.struct(*rest).alias("item"))]
        while True:
            upper = cut_lineage(climbed(self.rounds[-1]))
            if upper.where(F.col("size") > 1).isEmpty():
                break
            self.rounds.append(upper.withColumn("item", F.struct("pos")))
        #: one row per tree: tree, top
        self.tops = upper.select("tree", F.col("digest").alias("top"))

    def paths(self, above: DataFrame) -> DataFrame:
        """Every item with all its steps, and the columns of ``above`` (tree, steps, and others), which says what comes over the tops."""
        path = above.withColumn("pos", F.lit(0).cast("long"))
        others = [c for c in above.columns if c not in ("tree", "steps")]
        for nodes in reversed(self.rounds):
            joined = climbed(nodes, proofs=True).select("tree", "pos", "below").join(path, ["tree", "pos"])
            path = joined.select("tree", F.explode("below").alias("one"), "steps", *others).select(
                "tree", "one.item.*", F.concat("one.steps", "steps").alias("steps"), *others
            )
        return path


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf leads to with these siblings."""
    return F.aggregate(steps, start, lambda node, s: digest(s["before"], node, s["after"]))


def siblings(steps: Column) -> Column:
    """All siblings of a leaf, from its level up, left to right."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: F.array(s["before"], s["after"]))), "")


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None
) -> DataFrame:
    """One row per document: doc_id, source, leaf, subroot, root, steps (its proof), and found_leaf.

    ``changed`` gives other values of fields, as they were found when the data were looked at again;
    ``found_leaf`` is the digest of the row with these.
    """
    now = {c: F.col(c) for c in fields}
    found = now | (changed or {})
    leaves = docs.select(
        F.col(id_col).alias("doc_id"),
        # '' is the null group, before '=' and the names of the others
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        leaf(now).alias("leaf"),
        leaf(found).alias("found_leaf"),
    )
    leaves = places(cut_lineage(leaves), "tree", [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("found_leaf")])
    groups = Forest(leaves.withColumn("digest", F.col("leaf")))
    subroots = groups.tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("top").alias("digest"))
    whole = Forest(places(subroots, "tree", [F.col("group")]))
    above = whole.tops.select("tree", F.array().cast(STEPS).alias("steps"), F.col("top").alias("root"))
    tops = whole.paths(above).select(F.col("group").alias("tree"), "steps", "root").join(groups.tops, "tree")
    rows = groups.paths(tops.select("tree", "steps", "root", F.col("top").alias("subroot")))
    group = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
    return rows.select("doc_id", group.alias("source"), "leaf", "subroot", "root", "steps", "found_leaf")


def verified(rows: DataFrame) -> DataFrame:
    """``manifest`` rows with proof_sha256, folded_root (of the leaf as found) and verified."""
    out = rows.withColumn("proof_sha256", F.sha2(siblings(F.col("steps")), 256)).withColumn("folded_root", folded(F.col("found_leaf"), F.col("steps")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
