"""Mixing, sharding, scores and the whole pipeline against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from uttmill.llm import classifier as K
from uttmill.llm.mixing import WEIGHTS, mixed_documents, mixture, targets
from uttmill.llm.sharding import ATOMS, cuts, fits, sharded, smallest_capacity

from .test_near_duplicates import plain_fingerprint
from .conftest import prose

# ---- mixing


def plain_targets(sizes):
    """Shared by weight; what is above three times a source is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        free = [s for s in order if s not in full]
        share = sum(weight[s] for s in free)
        found = {s: rest * weight[s] / share for s in free}
        over = [s for s in free if found[s] > 3 * sizes[s]]
        if not over:
            return {**found, **full}
        full.update({s: 3.0 * sizes[s] for s in over})


def plain_mix(rows, seed=8):
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for k, r in enumerate(rows)}
    sizes = defaultdict(int)
    for k, r in enumerate(rows):
        sizes[r[3]] += size[k]
    goal, out = plain_targets(dict(sizes)), {}
    for source in sizes:
        mine = [k for k, r in enumerate(rows) if r[3] == source]
        epochs = int(goal[source] // sizes[source]) if sizes[source] else 0
        budget, at = goal[source] - epochs * sizes[source], 0

        def key(k):
            text, i = rows[k][1] or "", rows[k][0]
            u = (int(hashlib.md5("|".join([str(seed)] + ([] if i is None else [str(i)])).encode()).hexdigest()[:13], 16) + 1) / 2**52
            share = sum(c not in "#*$%&|<>!" for c in text) / max(len(text), 1)
            return (-math.log(u) / max(0.05, share**4), (i is not None, str(i)), zlib.crc32(text.encode()))

        cut = None
        for k in sorted((k for k in mine if size[k]), key=key):
            if at + size[k] <= budget or (at < budget and 2 * (budget - at) > size[k]):
                cut = key(k)
            at += size[k]
        for k in mine:
            out[k] = epochs + (cut is not None and size[k] > 0 and key(k) <= cut)
    return [(r[0], size[k], sizes[r[3]], round(goal[r[3]], 6), out[k]) for k, r in enumerate(rows)]


def mixed(df, **more):
    return sorted([(r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies) for r in mixture(df, **more).collect()], key=str)


def test_mixture(odd, odd_rows, small, none):
    assert mixed(odd) == sorted(plain_mix(odd_rows), key=str)
    rows = [tuple(r) for r in small.select("doc_id", "text", "lang", "source").collect()]
    assert mixed(small) == sorted(plain_mix(rows), key=str)
    assert mixed(none) == []


def test_mix_is_near_its_targets(small):
    by = defaultdict(list)
    for r in mixture(small).select("source_size", "target", "taken", "size").collect():
        by[(r.source_size, r.target)].append((r.taken, r.size))
        assert r.taken <= 3 * r.size
    for (_, target), docs in by.items():
        assert abs(sum(t for t, _ in docs) - target) <= max(s for _, s in docs) / 2 + 1


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"x": 3}, {str(i): 7**i for i in range(8)}])
def test_targets(spark, sizes):
    rows = [(s is None, s or "", n) for s, n in sizes.items()]
    found = targets(spark.createDataFrame(rows, "no_source boolean, source string, source_size long")).collect()
    want = plain_targets(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for r in found:
        assert math.isclose(r.target, want[None if r.no_source else r.source], rel_tol=1e-12)
        assert 0 <= r.epochs <= 3


def test_mixed_documents(odd, clashing, none):
    counts = Counter()
    for r in mixture(odd).collect():
        counts[(r.doc_id, r.size)] += r.copies
    for df in (odd, clashing):
        out = mixed_documents(df)
        assert out.columns == df.columns
        sizes = out.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).collect()
        assert Counter(tuple(r) for r in sizes) == +counts
    assert mixed_documents(none).count() == 0


def test_quality_leads_to_more(spark):
    rows = [(i, prose(i, 50) if i % 2 else prose(i, 50).replace(" ", "%%% "), "en", s, 1) for s in ("a", "b", "c") for i in range(ord(s) * 1000, ord(s) * 1000 + 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixture(df).where("copies = 1 and target < source_size").groupBy((F.col("doc_id") % 2).alias("good")).count().collect()
    counts = {r.good: r["count"] for r in taken}
    assert counts[1] > 2 * counts.get(0, 0)


# ---- sharding


def plain_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    ends = [0, *np.cumsum(sizes).tolist()]
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


def test_capacity():
    rng = random.Random(1)
    for _ in range(60):
        sizes = np.array([rng.choice([0, 1, 5, 30, 200]) for _ in range(rng.randint(1, 25))])
        shards = rng.randint(1, 6)
        capacity = smallest_capacity(sizes, shards)
        assert capacity == plain_capacity(sizes, shards)
        ends = np.cumsum(sizes)
        assert fits(ends, capacity, shards)
        edges = [0, *cuts(sizes, shards), len(sizes)]
        assert edges == sorted(edges) and len(edges) == shards + 1
        assert max(int(sizes[a:b].sum()) for a, b in zip(edges, edges[1:])) <= capacity


def test_one_heavy_atom_leaves_no_shard_idle():
    sizes = np.ones(ATOMS, dtype=np.int64)
    sizes[30000] = ATOMS // 2
    edges = [0, *cuts(sizes, 40), ATOMS]
    parts = [int(sizes[a:b].sum()) for a, b in zip(edges, edges[1:])]
    assert min(parts) > 0 and sorted(parts)[-2] < 2 * ATOMS / 40


def test_shards(odd, odd_rows, clashing, small, none):
    for df, rows in ((odd, odd_rows), (clashing, odd_rows), (small, [tuple(r) for r in small.collect()])):
        found = sharded(df).collect()
        facts = [(r.doc_id, r.size, r.text_crc32) for r in found]
        assert Counter(facts) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
        slots, groups = defaultdict(list), defaultdict(set)
        for r in found:
            slots[r.shard].append(r.slot)
            groups[r.text_crc32].add(r.shard)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(g) == 1 for g in groups.values()) and set(slots) <= set(range(40))
        assert sorted(map(tuple, sharded(df).collect()), key=str) == sorted(map(tuple, found), key=str)
    assert sharded(none).count() == 0
    assert {r.shard for r in sharded(small, 1).collect()} == {0}


# ---- scores


def test_interactions_by_pairs():
    rng = np.random.default_rng(1)
    texts = [prose(i, 30).encode() for i in range(5)] + [b""]
    f = K.features(texts, rng.random((6, 1)) * 100)
    width = f.dense.shape[1]
    m = K.Machine(0.1, rng.normal(0, 1, K.WORD_SLOTS + width).astype(np.float32), rng.normal(0, 1, (K.WORD_SLOTS + width, K.RANK)).astype(np.float32), f.dense.mean(0), f.dense.std(0) + 1)
    raw, _ = m.sums(f, m.dense(f.dense))
    for row in range(6):
        x = np.zeros(K.WORD_SLOTS + width)
        x[f.slots[f.starts[row] : f.starts[row + 1]]] = f.values[f.starts[row] : f.starts[row + 1]]
        x[K.WORD_SLOTS :] = m.dense(f.dense)[row]
        on = np.flatnonzero(x)
        pairs = sum(float(m.vectors[i] @ m.vectors[j]) * x[i] * x[j] for n, i in enumerate(on) for j in on[n + 1 :])
        assert math.isclose(raw[row], 0.1 + m.linear @ x + pairs, rel_tol=1e-3, abs_tol=1e-3)


def test_gradient_lowers_loss():
    f = K.features([(("good " if i % 2 else "bad ") + prose(i, 20)).encode() for i in range(200)], np.zeros((200, 1)))
    y = np.array([i % 2 for i in range(200)], dtype=float)
    scores = K.fit(f, y).scores(f)
    assert ((scores > 0.5) == (y == 1)).mean() > 0.95
    assert np.array_equal(scores, K.fit(f, y).scores(f))


def test_scores(spark, odd, odd_rows, clashing, none):
    labels = spark.createDataFrame([(0, 1), (2, 0), (7, 1), (13, 0), (13, 1), (None, 1), (8, None)], "doc_id long, quality int")
    machine = K.train(odd, labels)
    found = K.scored(odd, machine).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in odd_rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert sorted(map(str, K.scored(clashing, machine).collect())) == sorted(map(str, found))
    assert K.scored(none, machine).count() == 0
    assert {r.score for r in K.scored(odd, K.train(odd, labels.limit(0))).collect()} == {0.5}
    # labels of held out rows change nothing
    flipped = labels.where("doc_id is not null").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(str, K.scored(odd, K.train(odd, flipped)).collect())) == sorted(map(str, found))


def test_a_repeated_id_is_one_row_of_the_fit(spark):
    docs = [(i, prose(i, 80), 400) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    plain = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    again = spark.createDataFrame(docs + [docs[3]] * 200 + [docs[7]] * 50, "doc_id long, text string, n_chars long")
    one, two = (K.scored(plain, K.train(d, labels)).collect() for d in (plain, again))
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = K.scored(docs, K.train(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([(r.predicted == r.quality) for r in rows]) > 0.93
    assert np.mean([g > b for g in good for b in bad]) > 0.95


# ---- pipeline


def test_pipeline(spark, odd_rows, tmp_path):
    rng = random.Random(2)
    bench = [(i, prose(800 + i, 25)) for i in range(3)]
    rows = [(i, prose(i, 100 + i % 40), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(5)]  # exact copies
    near = []
    for i in range(5, 10):
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "edited"
        near.append((200 + i, " ".join(words), "en", "s1", 1))
    leaky = [(300 + i, f"{prose(700 + i, 60)} {bench[i][1]} {prose(750 + i, 60)}", "en", "s2", 1) for i in range(3)]
    junk = [(400, "a few words", "en", "s0", 1), (401, "same line again " * 60, "en", "s0", 1), (402, None, None, None, None), (403, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows + near + leaky + junk, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    now, left = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        left.append(sorted(r.doc_id for r in now.collect()))
    whole = [r[0] for r in rows + near + leaky]
    assert left[0] == sorted(whole)
    # exact copies go, and those edited ones whose fingerprints differ in two bits at most
    alone = [near_row[0] for near_row in near if all((plain_fingerprint(near_row[1]) ^ plain_fingerprint(r[1])).bit_count() > 2 for r in rows + near if r is not near_row)]
    assert left[1] == sorted({*range(60), 300, 301, 302, *alone})
    assert left[2] == sorted({*range(60), *alone})
    assert set(left[3]) <= {*range(60), *alone} and max(Counter(left[3]).values()) <= 3
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in result) == left[3]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
