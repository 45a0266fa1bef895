"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the digest of its content (the *blob*). The
ledger holds the pairs of blob and rule version that were scanned, with what was found. A
scan reads only the blobs whose pair is not in the ledger, each once however many paths
have it, and joins the findings back to all paths and versions.

Rules are regular expressions over UTF-8 bytes, leftmost and non-overlapping for each kind;
their offsets are code points, ends exclusive. The rule version is a digest of the rules.

Null texts are empty: their blob is that of the empty text and has no findings. Rows that
repeat share a blob and all get its findings. Null ids stay. Columns besides id and text
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .texts import portions


@dataclass(frozen=True)
class Rule:
    """``group``: the part whose length must reach ``least`` characters, 0 for the whole match."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    any_case: bool = False


#: the base kinds, in their order
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
RULES = BASE + (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)
FINDINGS = "array<struct<kind:int,start:int,end:int>>"
SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: bytes, compiled: list[tuple[re.Pattern, int, int]]) -> list[dict[str, int]]:
    """The findings of a text by start, then kind."""
    found = []
    for kind, (pattern, least, group) in enumerate(compiled):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), kind, m.end()))
    if found and not text.isascii():
        points = np.r_[0, np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)]
        found = [(int(points[s]), kind, int(points[e])) for s, kind, e in found]
    return [{"kind": kind, "start": s, "end": e} for s, kind, e in sorted(found)]


def compiled(rules: tuple[Rule, ...]) -> list[tuple[re.Pattern, int, int]]:
    return [(re.compile(r.pattern.encode(), re.IGNORECASE if r.any_case else 0), r.least, r.group) for r in rules]


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob, text): rows addressed by their content."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("blob"), text.alias("text"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"):
    """The new ledger entries: (blob, rules, findings) of the unseen blobs of ``docs``.

    One row stands for each blob: the copies are counted before any text moves, and texts
    move only to be scanned once.
    """
    version = rule_version(rules)
    rows = versions(docs, id_col, text_col)
    # of equal rows any one serves: a number tells them apart within the scan
    one = rows.groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("one"))
    if ledger is not None:
        one = one.join(ledger.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    one = one.select("blob", F.col("one.doc_id").alias("doc_id"))
    unseen = rows.join(one, (rows["blob"] == one["blob"]) & rows["doc_id"].eqNullSafe(one["doc_id"]), "left_semi").select("blob", "text")

    def run(batches):
        machines = compiled(rules)
        for batch in portions(batches, 1):
            found = [find(t.encode("utf-8", "surrogatepass"), machines) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["blob", "findings"])

    # rows equal in id and text are the same blob twice: one entry
    found = unseen.mapInArrow(run, f"blob string, findings {FINDINGS}")
    return found.groupBy("blob").agg(F.first("findings").alias("findings")).select("blob", F.lit(version).alias("rules"), "findings")


def secrets_of(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"):
    """(findings of all rows, the ledger with the new entries).

    The first: doc_id, blob, and ``findings`` (kind as a position in ``rules``, start, end).
    """
    version = rule_version(rules)
    new = cut_lineage(scan(docs, ledger, rules, id_col, text_col))
    whole = new if ledger is None else ledger.select(*new.columns).union(new)
    # only blobs with findings travel; the others have none
    hits = whole.where((F.col("rules") == version) & (F.size("findings") > 0)).select("blob", "findings")
    rows = versions(docs, id_col, text_col).select("doc_id", "blob")
    found = rows.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    return found, whole


def digest_line(findings, rules: tuple[Rule, ...] = RULES):
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ","
    )
