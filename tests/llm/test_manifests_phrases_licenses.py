"""Merkle manifests, collocations and license scans against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttmill.llm import collocations as C
from uttmill.llm import licenses as L
from uttmill.llm import merkle as M
from uttmill.llm.order import places
from uttmill.llm.quotient_filter import Space

from .conftest import SCHEMA, prose

# ---- places


def test_places_are_the_row_numbers_of_a_plain_window(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else rng.choice("bcd"), rng.randint(0, 10**6), i) for i in range(3000)]
    got = places(spark.createDataFrame(rows, "g string, o long, i long").repartition(7), "g", [F.col("o"), F.col("i")]).collect()
    want = {}
    for g in "abcd":
        mine = sorted((o, i) for gg, o, i in rows if gg == g)
        want |= {i: (k, len(mine)) for k, (_, i) in enumerate(mine)}
    assert {r.i: (r.pos, r.size) for r in got} == want


# ---- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_tree(nodes):
    """The top, and for each leaf its steps (before, after)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, pos in enumerate(at):
            first = pos // 3 * 3
            steps[i].append(("".join(nodes[first:pos]), "".join(nodes[pos + 1 : first + 3])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [pos // 3 for pos in at]
    return nodes[0], steps


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        odd = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        found = r["text"].replace("\n", "") if odd and r["text"] is not None else r["text"]
        leaf = plain_leaf(r, r["text"])
        groups["" if r["source"] is None else "=" + r["source"]].append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), plain_leaf(r, found), r["doc_id"]))
    names = sorted(groups, key=lambda g: g.encode())
    trees = {g: plain_tree([x[0][2] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for g, up in zip(names, above):
        for x, steps in zip(sorted(groups[g], key=lambda x: x[:2]), trees[g][1]):
            whole, node = steps + up, x[1]
            for before, after in whole:
                node = sha(before, node, after)
            out.append((x[2], x[0][2], trees[g][0], root, sha(*(b + a for b, a in whole)), node, node == root))
    return out


def query_rows(docs):
    odd = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = M.verified(M.manifest(docs, changed={"text": text}))
    return [tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_manifest_with_odd_rows(odd):
    assert ordered(query_rows(odd)) == ordered(plain_manifest([r.asDict() for r in odd.collect()]))


def test_manifest_of_uneven_groups(spark):
    rng = random.Random(2)
    sources = ["big"] * 800 + ["s1"] * 9 + ["s2"] * 10 + ["s3"] * 3 + ["one", None, "é", "Z", "zz"]
    rows = [(i, f"line {rng.random()}\nline", "en", s, 5) for i, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert ordered(query_rows(docs)) == ordered(plain_manifest([r.asDict() for r in docs.collect()]))


def test_manifest_of_nothing_and_of_clashing_columns(none, odd, clashing):
    assert query_rows(none) == []
    more = clashing.withColumns({c: F.lit("x") for c in ("tree", "pos", "digest", "below", "item", "steps", "leaf", "block", "size")})
    assert ordered(query_rows(more)) == ordered(query_rows(odd))


def test_a_proof_fails_for_any_other_leaf(odd):
    rows = M.verified(M.manifest(odd, changed={"lang": F.lit("xx")}))
    assert rows.where("verified").count() == 0
    assert M.verified(M.manifest(odd)).where("NOT verified").count() == 0


# ---- quotient filters


@pytest.mark.parametrize("width", [1, 5, 9, 17, 31, 32])
@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_filters_are_lossless_and_merge(n, width):
    rng = np.random.default_rng(n * width)
    ids = rng.integers(0, 2**width, size=(2000, n))
    ids = np.concatenate([ids, np.repeat(ids[:3], 400, axis=0), np.zeros((1, n), int), np.full((1, n), 2**width - 1)])
    space = Space(n, width)
    assert (space.ids(*space.keys(ids)) == ids).all()
    want = Counter(map(tuple, ids.tolist()))
    keys = space.counted(*space.keys(ids))
    for bits in (0, 3, 9):
        parts = [space.loaded(slab, blob) for slab, blob in space.filters(*keys, bits)]
        whole = [np.concatenate(p) for p in zip(*parts)]
        assert dict(zip(map(tuple, space.ids(*whole[:2]).tolist()), whole[2].tolist())) == want
        high, low, counts = space.counted(*(np.concatenate([w, w]) for w in whole))
        assert dict(zip(map(tuple, space.ids(high, low).tolist()), (counts // 2).tolist())) == want


def test_filters_are_compact():
    space = Space(2, 17)
    ids = np.random.default_rng(5).integers(0, 2**17, size=(20000, 2))
    blobs = space.filters(*space.counted(*space.keys(ids)), 0)
    assert sum(len(b) for _, b in blobs) < 20000 * 6  # a key and a counter are 16 bytes


# ---- collocations


def plain_phrases(rows, least, per_lang, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(
                len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()
            )
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def talk(seed, words=400, vocabulary=60):
    rng = random.Random(seed)
    own = [w for w in prose(9, 400).split()][:vocabulary] + ["Über", "A1", "é"]
    out = []
    for _ in range(words):
        out.append(rng.choices(own, [1 / (i + 1) for i in range(len(own))])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]))
    return "".join(out)


@pytest.fixture(scope="module")
def talks(spark):
    rows = [("en" if i % 4 else "fr", talk(i)) for i in range(40)] + [(None, talk(77))] * 4 + [("en", None), ("de", ""), (None, None), ("en", " \n. ")]
    return rows, spark.createDataFrame(rows, "lang string, text string").repartition(3).cache()


@pytest.mark.parametrize(("fan", "chunk_bytes", "per_lang"), [(8, 8 << 20, 2000), (8, 3000, 50), (2, 1500, 2000), (1, 3000, 7)])
def test_collocations_against_plain_counting(talks, fan, chunk_bytes, per_lang, monkeypatch):
    monkeypatch.setattr(C, "FAN_BITS", fan)
    rows, docs = talks
    got = C.collocations(docs, least=12, per_lang=per_lang, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 12, per_lang)


def test_collocations_of_nothing_and_of_odd_rows(none, odd, odd_rows, clashing):
    assert C.collocations(none).collect() == []
    want = plain_phrases([(r[2], r[1]) for r in odd_rows], 30, 2000)
    assert sorted(map(tuple, C.collocations(odd).collect())) == want
    assert sorted(map(tuple, C.collocations(clashing).collect())) == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5 * 10**15
    grams = spark.createDataFrame([("en", [0, 1], big)], "lang string, ids array<long>, f long")
    words = spark.createDataFrame([("en", "a", big + 1, 0), ("en", "b", 3 * big, 1)], "lang string, word string, f long, id long")
    row = C.scored(grams, words).head()
    assert row.score == 2000000 * big // (4 * big + 1)


# ---- licenses


def nearest(notice: str, line: str) -> int:
    """The fewest edits between the notice and any stretch of the line."""
    row = [0] * (len(line) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j in range(1, len(line) + 1):
            new.append(min(row[j - 1] + (c != line[j - 1]), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(text: str, edits: int, rng: random.Random) -> str:
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(at, rng.choice("abcdefgh"))
        else:
            del out[at]
    return re.sub(" +", " ", "".join(out)).strip()


def test_every_notice_within_its_edits_is_found():
    rng = random.Random(3)
    search = L.Search()
    seen = Counter()
    for n, notice in enumerate(L.NOTICES):
        alone = L.Search((notice,))
        for edits in range(notice.edits + 3):
            for _ in range(6):
                line = f"{prose(rng.randrange(99), 6)} {changed(notice.words, edits, rng)} {prose(rng.randrange(99), 6)}"
                least = nearest(notice.words, line)
                hits = alone.hits(line)
                assert bool(hits) == (least <= notice.edits), (notice, line)
                if hits:
                    assert min(h[2] for h in hits) == least
                    seen[least] += 1
                    assert search.hits(line)
    assert seen[1] > 100 and seen[3] > 30


def test_the_notice_with_fewest_edits_gives_the_label():
    search = L.Search()
    for notice in L.NOTICES:
        found = {L.NOTICES[h[3]].label for h in search.hits(f"we say it is {notice.words} and more")}
        assert found == {notice.label}, notice


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), sorted({label for _, label in found})


BASE_TEXTS = [
    "Released under the MIT License.", "MIT license MIT License; mit-license", "The GNU General\nPublic  LICENSE", "general public license general public license",
    "mitlicense", "mit licenses", "xmit license", "é MIT Ünï license", "apache\x00license", "Apache License, Version 2.0", "", None, "mit", "MİT license", "a" * 50000 + " mit license",
    "mit license " * 3000,
]


def test_base_phrases_against_plain_words(spark, odd):
    docs = spark.createDataFrame(list(enumerate(BASE_TEXTS)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    rows = L.licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    want = [(r.doc_id, *plain_base(r.text)) for r in docs.collect()]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))


def test_spans_are_code_points_of_the_text(spark):
    text = "Ünï — see: Licenced  under the Apache-License, version 2.0!\nDone."
    docs = spark.createDataFrame([(1, text, "x", "y")], "doc_id long, text string, hits string, label string")
    row = L.licenses(docs).withColumn("labels", L.labels()).head()
    assert [text[h.start : h.end] for h in row.hits] == ["Licenced  under the Apache-License, version 2.0"]
    assert row.labels == ["apache"] and row.score == 1.0 and row.hits[0].edits == 1
    fuzzy = L.scan("This is freee and unencumbered software releazed into the public domain", L.Search())
    assert [h["label"] for h in fuzzy["hits"]] == ["unlicense"] and 0.9 < fuzzy["score"] < 1 and not fuzzy["n_base"]


def test_clean_texts_have_no_label(small, none):
    assert L.licenses(none).collect() == []
    rows = L.licenses(small).select(L.labels().alias("labels"), "score").collect()
    line = re.compile(r"licen[sc]e", re.I)
    told = sum(bool(line.search(r.text)) for r in small.select("text").collect())
    assert sum(bool(r.labels) for r in rows) <= told
    assert all((r.score > 0) == bool(r.labels) for r in rows)
