"""License scans: exact phrases, and a fuzzy search for short notices.

A text is looked at as its words: A to Z in lower case, words of ASCII letters, digits and all
characters beyond ASCII, joined by single spaces. Base phrases are found where their words
stand one after the other.

Notices are found with up to ``edits`` changed, missing or added characters. By the pigeonhole
principle a notice with e edits holds one of its e + 1 pieces unchanged, so the exact pieces of
all notices (one Aho-Corasick automaton) are *seeds*: each says where its notice can lie, give or
take e characters. Overlapping places of a notice are one *window*, in which the ``regex``
library matches the whole notice with bounded errors and reports span and edits. Of hits that
overlap, the one with the fewest edits counts (then the longer, then the first in order), so a
notice that resembles another does not give its label too.

The span of a hit is widened to whole words. The score of a text is 1 with a base phrase, else the
best 1 - edits / length of its hits, else 0.

Null texts are empty: no words, no label, score 0. Texts of any length are searched whole. Null
and repeated ids stay row by row. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left as bisect
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import portions

#: base phrases and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: one edit is allowed for so many characters of a notice, and so many at most
CHARS_PER_EDIT = 12
MOST_EDITS = 5


@dataclass(frozen=True)
class Notice:
    """``words``: the notice as words in lower case with single spaces."""

    label: str
    words: str

    @property
    def edits(self) -> int:
        return min(MOST_EDITS, len(self.words) // CHARS_PER_EDIT)


def _families() -> tuple[Notice, ...]:
    """Short forms of the six attribution licenses, which differ in a word or two."""
    kinds = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
    verbs = ("licensed under", "released under")
    return tuple(Notice(f"cc-{kind.replace(' ', '-')}", f"{verb} cc {kind} {version} 0") for kind in kinds for verb in verbs for version in (3, 4))


# fixed values: opening lines of public licenses
NOTICES = (
    Notice("mit", "released under the mit license"),
    Notice("mit", "licensed under the mit license"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("apache", "released under the apache license version 2 0"),
    Notice("gpl", "licensed under the gnu general public license version 2"),
    Notice("gpl", "licensed under the gnu general public license version 3"),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Notice("lgpl", "licensed under the gnu lesser general public license"),
    Notice("agpl", "licensed under the gnu affero general public license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Notice("bsd", "released under the bsd license"),
    Notice("bsd", "licensed under the bsd license"),
    Notice("isc", "released under the isc license"),
    Notice("isc", "licensed under the isc license"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Notice("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Notice("mpl", "licensed under the mozilla public license version 2 0"),
    Notice("epl", "made available under the terms of the eclipse public license"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
    Notice("boost", "distributed under the boost software license version 1 0"),
    Notice("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    Notice("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    Notice("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Notice("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Notice("cc0", "dedicated to the public domain under the creative commons zero 1 0 universal license"),
    *_families(),
)

#: byte values: letters to lower case, all that separates words to space
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
HITS = pa.list_(
    pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("length", pa.int32())])
)
RESULT = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())), ("hits", HITS), ("score", pa.float64()),
    ]
)
RESULT_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "hits array<struct<label:string,start:long,end:long,edits:int,length:int>>, score double"
)


def base_places(line: bytes, phrases=BASE) -> list[tuple[int, str]]:
    """(first word, label) of each place of a phrase in words joined by single spaces."""
    found = []
    padded = b" " + line + b" "
    for phrase, label in phrases:
        wanted = b" " + phrase.encode() + b" "
        at, word, counted = padded.find(wanted), 0, 0
        while at >= 0:
            word += padded.count(b" ", counted, at)
            counted = at
            found.append((word, label))
            at = padded.find(wanted, at + 1)
    return found


class Search:
    """The seeds of all notices, and a machine for each."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        self.machines = []
        places = defaultdict(list)
        for n, notice in enumerate(notices):
            length, parts = len(notice.words), notice.edits + 1
            cuts = [length * i // parts for i in range(parts + 1)]
            for start, end in zip(cuts, cuts[1:]):
                places[notice.words[start:end]].append((n, start, end))
            self.machines.append(regex.compile(rf"(?b)(?:{regex.escape(notice.words)}){{e<={notice.edits}}}"))
        for piece, where in places.items():
            self.seeds.add_word(piece, where)
        self.seeds.make_automaton()

    def windows(self, line: str) -> dict[int, list[list[int]]]:
        """Where each notice can lie; places that overlap are one."""
        found: dict[int, list[list[int]]] = {}
        for last, where in self.seeds.iter(line):
            for n, start, end in where:
                notice = self.notices[n]
                begin = last + 1 - end - notice.edits
                stop = last + 1 - end + len(notice.words) + notice.edits
                spans = found.setdefault(n, [])
                if spans and begin <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], begin)
                    spans[-1][1] = max(spans[-1][1], stop)
                else:
                    spans.append([begin, stop])
        return found

    def best(self, n: int, line: str, begin: int, stop: int):
        """The matches of a notice in a window: the best one, then those beside it."""
        rest = [(begin, stop)]
        while rest:
            begin, stop = rest.pop()
            m = self.machines[n].search(line, begin, stop) if begin < stop else None
            if m:
                yield m
                rest += [(begin, m.start()), (m.end(), stop)]

    def hits(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) of the hits that stay, in order."""
        found = []
        for n, spans in self.windows(line).items():
            for begin, stop in spans:
                for m in self.best(n, line, max(0, begin), min(len(line), stop)):
                    found.append((sum(m.fuzzy_counts), -len(self.notices[n].words), n, m.start(), m.end()))
        stay: list[tuple[int, int, int, int]] = []
        for edits, _, n, s, e in sorted(found):
            at = bisect(stay, (s,))
            if (at == 0 or stay[at - 1][1] <= s) and (at == len(stay) or stay[at][0] >= e):
                stay.insert(at, (s, e, edits, n))
        return stay


def in_text(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in the line of words, widened to whole words, as code points of the text."""
    lined, starts, ends = 0, [], []
    places = []
    for m in regex.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text):
        starts.append(lined)
        ends.append(lined + m.end() - m.start())
        places.append(m.span())
        lined = ends[-1] + 1
    # the word that ends after the first character, and the one that starts before the last
    return [(places[bisect(ends, s + 1)][0], places[bisect(starts, e) - 1][1]) for s, e in spans]


def scan(text: str | None, search: Search) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(FOLD).split()
    line = b" ".join(words)
    places = base_places(line)
    shown = line.decode("utf-8", "surrogatepass")
    hits = search.hits(shown)
    spans = in_text(text, [(s, e) for s, e, _, _ in hits]) if hits else []
    found = [
        {"label": search.notices[n].label, "start": a, "end": b, "edits": edits, "length": len(search.notices[n].words)}
        for (a, b), (_, _, edits, n) in zip(spans, hits)
    ]
    starts = [w for w, _ in places]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": sorted({label for _, label in places}),
        "hits": found,
        "score": 1.0 if places else max((1 - h["edits"] / h["length"] for h in found), default=0.0),
    }


def licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, hits, score.

    ``hits``: label, start and end in code points of the text, edits, and the length of the notice.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        search = Search(notices)
        for batch in portions(batches, 1):
            found = [scan(t, search) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[c.name] for f in found], c.type) for c in RESULT]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *RESULT.names])

    return rows.mapInArrow(run, f"doc_id {kind}, {RESULT_DDL}")


def labels(row_hits="hits", base="base_labels"):
    """Base labels and those of the hits, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.col(base), F.transform(row_hits, lambda h: h["label"]))))
