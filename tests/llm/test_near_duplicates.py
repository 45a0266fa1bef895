"""Fingerprints, BK-trees and components against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from uttmill.llm.components import stars
from uttmill.llm.simhash import BKTree, block_masks, links, near_duplicates, one_of_each, simhash

from .conftest import prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [sum(xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit, c in enumerate(counts) if 2 * c > len(shingles))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius]
    found = components(near, range(len(rows)))
    least = {}
    for k, c in found.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return sorted([(rows[k][0], prints[k], least.get(found[k])) for k in range(len(rows))], key=str)


def got(df, **more):
    return sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in near_duplicates(df, **more).collect()], key=str)


def test_fingerprint(odd_rows):
    for _, text, *_ in odd_rows:
        assert simhash((text or "").encode()) == plain_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).head()[0] % 2**64 == xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("trees", [1, 4096])
def test_components_of_rows(odd, odd_rows, clashing, none, trees):
    want = expected([r[:2] for r in odd_rows])
    assert got(odd, tree_nodes=trees) == want
    assert got(clashing) == want
    assert got(none) == []


def test_components_of_table(small):
    assert got(small) == expected([tuple(r) for r in small.select("doc_id", "text").collect()])


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_no_link_is_lost(spark, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for _ in range(4):
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << bit
            values.append(v)
    signed = sorted({v - 2**64 if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    for trees in (2, 4096):
        found = [tuple(r) for r in links(df, radius, trees).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in found)
        assert components(found, signed) == components(pairs, signed)


def test_blocks_cover_all_bits():
    for radius in (0, 1, 2, 3):
        whole = 0
        for m in block_masks(radius):
            whole |= m & (2**64 - 1)
        assert whole == 2**64 - 1


def test_tree():
    rng = random.Random(3)
    values = [rng.getrandbits(10) for _ in range(200)]
    tree = BKTree()
    assert tree.within(5, 3) == []
    for v in values:
        tree.add(v)
    for q in values[:20]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    found = dict(tuple(r) for r in stars(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def kept_by_hand(rows, radius=2):
    """One row of each component: the smallest id, null last; of equal rows one."""
    prints = [plain_fingerprint(r[1]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius]
    groups = {}
    for k, c in components(near, range(len(rows))).items():
        groups.setdefault(c, []).append(rows[k])
    return [(min((r[0] is None, r[0] or 0) for r in group), group) for group in groups.values()]


def check_kept(docs, rows):
    left = [tuple(r) for r in docs.collect()]
    groups = kept_by_hand(rows)
    assert len(left) == len(groups)
    for least, group in groups:
        mine = [r for r in left if r in group]
        assert len(mine) == 1 and (mine[0][0] is None, mine[0][0] or 0) == least


@pytest.mark.parametrize("trees", [2, 1024])
def test_one_of_each_with_null_and_repeated_ids(spark, odd, odd_rows, none, trees):
    a, b, c = prose(1, 150), prose(2, 150), prose(3, 150)
    rows = [(1, a, 0), (None, a + " end", 1), (None, b, 2), (None, b.upper(), 3), (7, c, 4), (7, a, 5), (8, c, 4), (8, c, 4), (9, None, 6), (None, "", 7)]
    check_kept(one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _digest int"), tree_nodes=trees), rows)
    kept = one_of_each(odd)
    assert kept.columns == odd.columns and one_of_each(none).count() == 0
    check_kept(kept, odd_rows)


def test_one_of_each_keeps_rows_of_a_repeated_id(spark):
    rows = [(5, prose(k, 120)) for k in range(30)] + [(None, prose(100 + k, 120)) for k in range(30)] + [(6, prose(3, 120))]
    left = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, rows[:-1]))
