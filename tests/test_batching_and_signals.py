import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from uttmill.operators import batching, runs, scores, signals


@pytest.fixture(scope="module")
def utts(spark):
    rng = random.Random(6)
    # a third of all rows has one length
    data = [(f"u{i}", 480 if rng.random() < 0.33 else rng.randrange(1, 3000), rng.choice("ab")) for i in range(2000)]
    return spark.createDataFrame(data, "utt string, n bigint, cat string").cache()


def loop(rows, fits):
    """Batches of a plain loop over sorted rows."""
    batches, held = [], []
    for r in rows:
        if held and not fits(held, r):
            batches.append(held)
            held = []
        held.append(r)
    return batches + [held] if held else batches


def digest_of(utt):
    return hashlib.md5(f"0|{utt}".encode()).hexdigest()


def as_batches(got, category=False):
    found = defaultdict(set)
    for r in got:
        found[(r["cat"] if category else None), r["batch"]].add(r["utt"])
    return dict(found)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize(("bins", "dim", "least"), [(6000, 1, 1), (6000, 4, 1), (6000, 1, 7), (50_000, 1, 3), (900, 1, 1)])
def test_greedy_batches_are_those_of_a_loop(utts, bins, dim, least, descending):
    got = batching.greedy_batches(utts, bins, F.col("n"), dim=dim, min_batch_size=least, descending=descending, hot_rows=100).collect()
    # lengths that stand alone are alike
    rows = sorted(utts.collect(), key=lambda r: ((-1 if descending else 1) * min(r["n"], bins // dim + 1), digest_of(r["utt"])))
    fits = lambda held, r: len(held) < least or (len(held) + 1) * max(x["n"] for x in [*held, r]) * dim <= bins
    want = {(None, i): {r["utt"] for r in held} for i, held in enumerate(loop(rows, fits))}
    assert as_batches(got) == want


def test_greedy_batches_by_category_with_nulls(spark, utts, partitions):
    odd = utts.unionByName(spark.createDataFrame([("x1", 10, None), ("x2", 20, None), ("x3", 0, None)], utts.schema))
    got = batching.greedy_batches(odd, 6000, F.col("n"), category=["cat"]).collect()
    want = {}
    for cat in ("a", "b", None):
        rows = sorted((r for r in odd.collect() if r["cat"] == cat), key=lambda r: (max(1, r["n"]), digest_of(r["utt"])))
        fits = lambda held, r: (len(held) + 1) * max(1, r["n"]) <= 6000
        want |= {(cat, i): {r["utt"] for r in held} for i, held in enumerate(loop(rows, fits))}
    assert as_batches(got, True) == want
    none = batching.greedy_batches(odd.where("n < 0"), 6000, F.col("n"))
    assert none.count() == 0


def test_greedy_folded_batches_are_those_of_a_loop(utts):
    got = batching.greedy_folded(utts, 40, [F.col("n")], [500], min_batch_size=9).collect()
    rows = sorted(utts.collect(), key=lambda r: (-(r["n"] // 500), digest_of(r["utt"])))
    fits = lambda held, r: len(held) < max(9, 40 // (1 + held[0]["n"] // 500))
    assert as_batches(got) == {(None, i): {r["utt"] for r in held} for i, held in enumerate(loop(rows, fits))}
    assert all(r["fold"] == r["n"] // 500 for r in got)


def test_greedy_batches_are_fuller_than_classes(utts):
    greedy = batching.batch_fill(batching.greedy_batches(utts, 60_000, F.col("n")), ["batch"], F.col("n"), 60_000).first()
    classes = batching.batch_fill(batching.batch_by_bins(utts, 60_000, F.col("n")), ["length_class", "batch"], F.col("n"), 60_000).first()
    assert greedy["rows"] == classes["rows"] == 2000
    assert greedy["fill"] > 0.9 > classes["fill"] and greedy["batches"] < classes["batches"]
    assert 0 <= greedy["padding"] < 0.2


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_no_batch_is_above_its_bins(utts, hot_rows, partitions):
    got = batching.batch_by_bins(utts, 6000, F.col("n"), category=["cat"], hot_rows=hot_rows)
    batches = defaultdict(list)
    for r in got.collect():
        batches[r["cat"], r["length_class"], r["batch"]].append(r)
    assert sum(map(len, batches.values())) == 2000
    for rows in batches.values():
        longest = max(r["n"] for r in rows)
        assert len(rows) == 1 or len(rows) * longest <= 6000
    # and the batches do not depend on how hot groups are cut
    plain = batching.batch_by_bins(utts, 6000, F.col("n"), category=["cat"])
    assert sorted(plain.collect()) == sorted(got.select(plain.columns).collect())


def test_folded_batches(utts):
    got = batching.batch_folded(utts, 12, [F.col("n"), F.col("n")], [800, 2000])
    sizes = defaultdict(list)
    for r in got.collect():
        sizes[r["fold"], r["batch"]].append(r["n"])
    for (fold, _), lengths in sizes.items():
        assert len(lengths) <= max(1, 12 // (fold + 1))
        assert all(n // 800 == fold for n in lengths)


def test_split_is_contiguous_and_even(utts):
    splits = defaultdict(list)
    for r in batching.split_keys(utts, 7).collect():
        splits[r["split"]].append(r["utt"])
    assert sorted(splits) == list(range(7))
    assert max(map(len, splits.values())) - min(map(len, splits.values())) <= 1
    for i in range(6):
        assert max(splits[i]) < min(splits[i + 1])
    assert {r["split"] for r in batching.split_keys(utts.limit(3), 7).collect()} == {0, 1, 2}


def test_rank_slice_refuses_small_batches(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "batch int, place int")
    for action in ("collect", "count"):
        with pytest.raises(PySparkException, match="smaller than the number of workers"):
            getattr(batching.rank_slice(df, ["batch"], "place", 2), action)()


@pytest.mark.parametrize("category", [[], ["cat"]])
def test_batches_large_enough_for_all_workers(utts, category):
    got = batching.batch_by_bins(utts, 20_000, F.col("n"), category=category, min_batch_size=4)
    keys = [*category, "length_class", "batch"]
    sizes = [r["count"] for r in got.groupBy(*keys).count().collect()]
    assert sum(sizes) == 2000 and min(sizes) >= 4
    placed = batching.order_batches(got.withColumn("n", F.col("n")), keys, "n")
    assert batching.rank_slice(placed, keys, "place", 4).groupBy("rank").count().count() == 4
    folded = batching.batch_folded(utts, 12, [F.col("n")], [800], category=category, min_batch_size=4)
    assert min(r["count"] for r in folded.groupBy(*category, "fold", "batch").count().collect()) >= 4


def test_chunk_lengths():
    assert batching.chunk_lengths("300,400") == [300, 400]
    assert batching.chunk_lengths("3-5") == [3, 4, 5]
    assert batching.chunk_lengths(500) == [500]


def framed(x, length, shift, centered, padded):
    if centered:
        x = np.pad(x, length // 2)
    if padded:
        x = np.pad(x, (0, (-(len(x) - length) % shift) % length))
    return [list(x[s : s + length]) for s in range(0, len(x) - length + 1, shift)]


@pytest.mark.parametrize("centered", [True, False])
@pytest.mark.parametrize("padded", [True, False])
@pytest.mark.parametrize("shift", [3, 4, 7])
def test_frames(spark, centered, padded, shift):
    waves = {f"w{n}": [float(i + 1) for i in range(n)] for n in (4, 9, 17)}
    df = spark.createDataFrame(list(waves.items()), "utt string, x array<double>")
    got = defaultdict(dict)
    for r in signals.frame_table(df, "x", 4, shift, centered=centered, padded=padded).collect():
        got[r["utt"]][r["frame"]] = r["samples"]
    for utt, x in waves.items():
        want = framed(np.array(x), 4, shift, centered, padded)
        assert [got[utt][i] for i in range(len(want))] == want and len(got[utt]) == len(want)


def test_short_row_is_an_error_for_frames(spark):
    df = spark.createDataFrame([("a", [1.0])], "utt string, x array<double>")
    with pytest.raises(PySparkException, match="too few samples for a frame: a"):
        signals.frame_table(df, "x", 4, 2).collect()


def test_silence_and_short_rows_are_active(spark):
    df = spark.createDataFrame([("zero", [0.0] * 20), ("short", [0.5]), ("half", [0.0] * 16 + [1.0] * 16)], "utt string, x array<double>")
    active = {r["utt"]: r["m"] for r in df.select("utt", signals.activity_mask(F.col("x"), 0.01, 4, 2).alias("m")).collect()}
    assert active["zero"] == [True] * 20 and active["short"] == [True]
    assert active["half"][:14] == [False] * 14 and active["half"][16:] == [True] * 16
    power = df.where("utt = 'half'").select(signals.active_power(F.col("x"), 0.01, 4, 2)).first()[0]
    assert 0.8 < power <= 1.0


def test_noise_wraps_and_is_cut(spark):
    rows = [("wrap", [1.0, 2.0, 3.0], 7, 2), ("same", [1.0, 2.0, 3.0], 3, 0), ("cut", [1.0, 2.0, 3.0, 4.0, 5.0], 2, 1)]
    df = spark.createDataFrame(rows, "k string, noise array<double>, n int, o bigint")
    got = {r["k"]: r["f"] for r in df.select("k", signals.fitted_noise(F.col("noise"), F.col("n"), F.col("o")).alias("f")).collect()}
    assert got["wrap"] == list(np.pad([1.0, 2.0, 3.0], (2, 2), mode="wrap"))
    assert got["same"] == [1.0, 2.0, 3.0] and got["cut"] == [2.0, 3.0]


def test_reflection(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    got = [r[0] for r in df.select(signals.fitted_source(F.col("x"), F.lit(9))).collect()]
    assert got == [list(np.pad([1.0, 2.0, 3.0], (0, 6), "reflect")), list(np.pad([1.0, 2.0, 3.0, 4.0], (0, 5), "reflect"))]


def test_score_must_match_labels(spark):
    sheet = "utt string, syllables array<struct<st:double,et:double,syllable:string,note:bigint,phones:string>>"
    label = "utt string, labels array<struct<start:string,end:string,phone:string>>"
    sheets = spark.createDataFrame([("u", [(0.0, 1.0, "la", 60, "l_a"), (1.0, 2.0, "—", 61, "a")])], sheet)
    good = spark.createDataFrame([("u", [("0", "0.5", "l"), ("0.5", "1", "a"), ("1", "2", "a")])], label)
    rows = scores.score_label_align(sheets, good, 16000, 1600).orderBy("index").collect()
    assert [(r["phone"], r["duration_phn"], r["duration_ruled_phn"], r["slur"], r["phn_count"]) for r in rows] == [
        ("l", 5, 3, 0, 2),
        ("a", 5, 8, 0, 2),
        ("a", 10, 10, 1, 1),
    ]
    bad = spark.createDataFrame([("u", [("0", "0.5", "l"), ("0.5", "1", "o"), ("1", "2", "a")])], label)
    with pytest.raises(PySparkException, match="score and labels differ: u"):
        scores.score_label_align(sheets, bad, 16000, 1600).collect()


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_markers_pair_with_the_next_one(spark, hot_rows):
    rng = random.Random(8)
    data = [(rng.choice("xyz") if i % 3 else "hot", i, rng.choice(["start", "end", "other"])) for i in range(400)]
    df = spark.createDataFrame(data, "job string, at bigint, marker string")
    got = runs.pair_markers(df, "job", ["at"], "marker", "start", "end", ["at"], hot_rows)
    by_job = defaultdict(list)
    for job, at, marker in data:
        if marker != "other":
            by_job[job].append((at, marker))
    want = {
        (job, a[0], b[0])
        for job, marks in by_job.items()
        for a, b in zip(marks, marks[1:])
        if a[1] == "start" and b[1] == "end"
    }
    assert {(r["job"], r["at"], r["end_at"]) for r in got.collect()} == want


def test_whole_numbers_are_added_up(spark):
    states = spark.createDataFrame(
        [(1, "w", 0, "float32", 1.0), (2, "w", 0, "float32", 2.0), (1, "n", 0, "int64", 3.0), (2, "n", 0, "int64", 4.0)],
        "epoch int, name string, idx int, dtype string, value double",
    )
    epochs = spark.createDataFrame([(1,), (2,)], "epoch int")
    assert {r["name"]: r["value"] for r in runs.average_parameters(states, epochs, 2).collect()} == {"w": 1.5, "n": 7.0}


def test_chunks_compute_the_values_once(spark):
    # values that are dear to make
    df = spark.createDataFrame([("a", "x" * 9), ("b", "xy")], "utt string, t string")
    made = df.select("utt", F.transform(F.split("t", ""), lambda c: F.ascii(c).cast("bigint")).alias("y"))
    chunks = batching.chunk_sequences(made, "y", "utt", "4", 0.5, 3)
    assert str(chunks._jdf.queryExecution().optimizedPlan().toString()).count("transform(") == 1
    assert sorted((r["utt"], r["start"], len(r["chunk"])) for r in chunks.collect()) == [("a", 0, 4), ("a", 2, 4), ("a", 4, 4)]
