"""Repeated word windows and byte strings against plain loops over all windows."""

from collections import Counter

import numpy as np
import pytest

from uttmill.llm import chunks as C
from uttmill.llm import texts as T
from uttmill.llm.substring_dedup import remove_repeated_windows
from uttmill.llm.suffix_dedup import remove_repeated_bytes


def by_windows(rows, k):
    lists = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[j : j + k]) for _, w in lists for j in range(len(w) - k + 1))
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if counts[tuple(w[j : j + k])] > 1:
                gone[j : j + k] = [True] * k
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def by_bytes(rows, k):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            s = b[j : j + k]
            if s in seen:
                gone[j : j + k] = b"\1" * k
            seen.add(s)
        spans = sum(1 for j in range(len(b)) if gone[j] and (not j or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def windows(df, **more):
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeated_windows(df, **more).collect()], key=str)


def strings(df, **more):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in remove_repeated_bytes(df, **more).collect()], key=str)


@pytest.mark.parametrize("chunk", [3000, 1 << 22])
def test_odd_rows(odd, odd_rows, chunk):
    rows = [r[:2] for r in odd_rows]
    assert windows(odd, chunk_bytes=chunk, bucket_keys=500) == by_windows(rows, 35)
    assert windows(odd, width=3, chunk_bytes=chunk) == by_windows(rows, 3)
    assert strings(odd, chunk_bytes=chunk, bucket_keys=500) == by_bytes(rows, 100)
    assert strings(odd, width=20, digit=8, chunk_bytes=chunk) == by_bytes(rows, 20)


@pytest.mark.parametrize("single", [1, 4])
def test_keys_that_go_by_junctions(small, odd, odd_rows, single, monkeypatch):
    monkeypatch.setattr(C, "SINGLE", single)
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert C.span_of(single) == 1 and C.span_of(40) == 6
    assert windows(small, chunk_bytes=15_000, bucket_keys=1000) == by_windows(rows, 35)
    assert strings(small, chunk_bytes=15_000, bucket_keys=400) == by_bytes(rows, 100)
    rows = [r[:2] for r in odd_rows]
    assert windows(odd, width=3, chunk_bytes=3000, bucket_keys=300) == by_windows(rows, 3)
    assert strings(odd, width=20, digit=8, chunk_bytes=3000, bucket_keys=100) == by_bytes(rows, 20)


def test_rows_of_a_chunk_grow_with_the_root_of_the_buckets():
    keys = T.mixed(np.arange(60_000, dtype=np.uint64))
    sent = {}
    for buckets in (900, 4000, 16_000, 64_000):
        box = C.Outbox(keys, (keys % np.uint64(buckets)).astype(np.int64), C.span_of(buckets))
        rows = box.rows(7, 0)
        sent[buckets] = len(rows)
        # every key is there once, in the bucket it belongs to, and the answers find their way back
        parts = [p for r in rows for p in (C.unpacked(r[3]) if box.span > 1 else [(r[2], r[3])])]
        found = {b: np.frombuffer(x, dtype=np.uint64) for b, x in parts}
        assert sum(map(len, found.values())) == 60_000 and all((x % np.uint64(buckets) == b).all() for b, x in found.items())
        codes = {r[2]: b"".join((np.frombuffer(x, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).tobytes() for _, x in (C.unpacked(r[3]) if box.span > 1 else [(0, r[3])])) for r in rows}
        assert (box.answers(codes) == (keys & np.uint64(1))).all()
    assert sent[900] == 900 and sent[4000] <= 64 and sent[16_000] <= 127 and sent[64_000] <= 253


def test_null_and_uneven_ids_make_no_large_chunk(spark):
    from .conftest import prose

    rows = [(None if i % 3 == 0 else 10 ** (i % 9) + i, prose(i, 300)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, size = C.in_any_chunks(df, chunk_bytes=size_of(rows) // 20)
    largest = dealt.groupBy("chunk").agg({"text": "count"}).agg({"count(text)": "max"}).head()[0]
    assert size == size_of(rows) and largest < 70
    assert windows(df, width=5, chunk_bytes=20_000, bucket_keys=5000) == by_windows(rows, 5)


def size_of(rows):
    return sum(len(t.encode()) for _, t in rows)


def test_small_table(small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert windows(small, chunk_bytes=40_000, bucket_keys=2000) == by_windows(rows, 35)
    assert strings(small, chunk_bytes=40_000, bucket_keys=2000) == by_bytes(rows, 100)


def test_empty_and_clashing(none, clashing, odd):
    assert windows(none) == [] and strings(none) == []
    assert windows(clashing) == windows(odd) and strings(clashing) == strings(odd)


def test_intervals(odd):
    for r in remove_repeated_windows(odd).collect():
        assert sum(s.last - s.first + 1 for s in r.removed) == r.n_removed
        assert all(a.last + 1 < b.first for a, b in zip(r.removed, r.removed[1:]))
    for r in remove_repeated_bytes(odd).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_window_hashes():
    t = np.random.default_rng(1).integers(0, 5, 200).astype(np.uint64)
    for k in (1, 2, 3, 7, 32, 35, 100):
        h = T.window_hashes(t, k)
        assert len(h) == 200 - k + 1
        same = {}
        for i in range(len(h)):
            assert same.setdefault(tuple(t[i : i + k]), h[i]) == h[i]
        assert len(set(same.values())) == len(same)
    assert len(T.window_hashes(t[:3], 4)) == 0


def test_span_hashes_do_not_depend_on_place():
    b, starts, ends = T.laid_out([b"abc", b"xx abc", b"", b"abc"], b" ")
    h = T.span_hashes(b, np.array([starts[0], starts[1] + 3, starts[3]]), np.array([ends[0], ends[1], ends[3]]))
    assert len(set(h.tolist())) == 1
