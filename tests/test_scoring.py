import math
import random
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from uttmill.functions import edits, gram_blocks, grams
from uttmill.functions.assignment import assign
from uttmill.functions.edits import align_all, align_counts
from uttmill.functions.text import tokenize
from uttmill.operators import ngrams, scoring
from uttmill.plans.evaluation import score_experiment


def plain_alignment(ref, hyp, weights):
    """Table of (cost, corr, sub, del, ins); ties go to the diagonal, then del, then ins."""
    ws, wd, wi = weights
    row = [(j * wi, 0, 0, 0, j) for j in range(len(hyp) + 1)]
    for token in ref:
        above, row = row, []
        for j in range(len(hyp) + 1):
            c, k, s, d, i = above[j]
            best = (c + wd, k, s, d + 1, i)
            if j:
                c, k, s, d, i = above[j - 1]
                hit = hyp[j - 1] == token
                diagonal = (c + (0 if hit else ws), k + hit, s + (not hit), d, i)
                if diagonal[0] <= best[0]:
                    best = diagonal
                c, k, s, d, i = row[j - 1]
                if c + wi < best[0]:
                    best = (c + wi, k, s, d, i + 1)
            row.append(best)
    return row[-1][1:]


@pytest.mark.parametrize("weights", [(4, 3, 3), (1, 1, 1), (5, 2, 3)])
def test_alignment_against_a_plain_table(weights):
    rng = random.Random(1)
    for _ in range(300):
        ref = [rng.randrange(4) for _ in range(rng.randrange(14))]
        hyp = [rng.randrange(4) for _ in range(rng.randrange(14))]
        got = align_counts(np.array(ref, dtype=np.int64), np.array(hyp, dtype=np.int64), weights)
        assert got == plain_alignment(ref, hyp, weights)


def test_pairs_advance_together():
    rng = random.Random(2)
    sides = [[np.array([rng.randrange(4) for _ in range(rng.randrange(20))], dtype=np.int64) for _ in range(80)] for _ in "rh"]
    got = align_all(*sides, (4, 3, 3))
    assert [tuple(r) for r in got.tolist()] == [plain_alignment(list(r), list(h), (4, 3, 3)) for r, h in zip(*sides)]


def test_null_side_is_empty(spark):
    df = spark.createDataFrame([(["a"], None), (None, ["b", None]), (None, None)], "r array<string>, h array<string>")
    rows = scoring.with_edit_counts(df, F.col("r"), F.col("h")).collect()
    assert [(r["corr"], r["sub"], r["del"], r["ins"]) for r in rows] == [(0, 0, 1, 0), (0, 0, 0, 2), (0, 0, 0, 0)]


def test_bleu_and_chrf_by_hand(spark):
    df = spark.createDataFrame([("1", ["the", "cat", "sat"], ["the", "cat", "sits", "now"])], "k string, r array<string>, h array<string>")
    row = scoring.corpus_bleu(df, "k", F.col("r"), F.col("h")).first()
    # 2 of 4 words, 1 of 3 pairs; no triple of 2 and no quadruple of 1: 1/(2*2) and 1/(4*1)
    want = 100 * math.exp((math.log(2 / 4) + math.log(1 / 3) + math.log(1 / 4) + math.log(1 / 4)) / 4)
    assert math.isclose(row["bleu"], want) and row["brevity"] == 1.0
    assert scoring.corpus_bleu(df, "k", F.col("r"), F.col("h"), smooth="none").first()["bleu"] == 0
    assert scoring.corpus_bleu(df, "k", F.col("r"), F.array(F.lit("x"))).first()["bleu"] == 0
    texts = spark.createDataFrame([("1", "abc", "ab d")], "k string, r string, h string")
    score = scoring.corpus_chrf(texts, "k", F.col("r"), F.col("h")).first()
    # abc against abd: letters 2/3, pairs 1/2, triples 0 on both sides
    mean = (2 / 3 + 1 / 2 + 0) / 3
    assert math.isclose(score["chrf"], 100 * mean) and score["orders"] == 3


def test_counts_add_up(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", "a"), ("a", ""), ("", "")], "r string, h string")
    tokens = df.select(tokenize(F.col("r"), "word").alias("r"), tokenize(F.col("h"), "word").alias("h"))
    for r in scoring.with_edit_counts(tokens, F.col("r"), F.col("h")).collect():
        assert r["corr"] + r["sub"] + r["del"] == len(r["r"])
        assert r["corr"] + r["sub"] + r["ins"] == len(r["h"])


def test_perfect_scores(spark):
    refs = spark.createDataFrame([("1", "s", "a b c d e"), ("2", "s", "f g h i j")], "utt string, spk string, ref string")
    hyps = refs.select("utt", F.col("ref").alias("hyp"))
    report = {r["metric"]: r["value"] for r in score_experiment(refs, hyps, "x").collect()}
    assert report["word_error_rate"] == 0 and report["char_error_rate"] == 0
    assert math.isclose(report["bleu"], 100) and math.isclose(report["chrf"], 100)


def test_missing_hypothesis_counts_as_deleted(spark):
    refs = spark.createDataFrame([("1", "s", "a b"), ("2", "s", "c d")], "utt string, spk string, ref string")
    hyps = spark.createDataFrame([("1", "a b")], "utt string, hyp string")
    report = {r["metric"]: (r["n"], r["value"]) for r in score_experiment(refs, hyps, "x").collect()}
    assert report["word_error_rate"] == (4, 50.0)
    # characters: "a b" has 3 and "c d" has 3
    assert report["char_error_rate"] == (6, 50.0)


def test_permutation_of_three_speakers(spark):
    refs = spark.createDataFrame([("u", [["a"], ["b"], ["c"]])], "utt string, refs array<array<string>>")
    hyps = spark.createDataFrame([("u", [["c"], ["a"], ["x", "b"]])], "utt string, hyps array<array<string>>")
    row = scoring.permutation_score(refs, hyps).first()
    assert row["assignment"] == [1, 2, 0] and row["errors"] == 1


def test_assignments_against_all_permutations():
    rng = np.random.default_rng(5)
    for _ in range(400):
        cols = int(rng.integers(1, 7))
        rows = int(rng.integers(1, cols + 1))
        cost = rng.integers(0, int(rng.integers(2, 12)), size=(rows, cols))
        best = min((sum(int(cost[i, j]) for i, j in enumerate(p)), p) for p in permutations(range(cols), rows))
        assert tuple(assign(cost)) == best[1]


def test_twelve_speakers_in_a_plan_of_fixed_size(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    refs = [[rng.choice(words) for _ in range(12)] for _ in range(12)]
    turn = list(range(12))
    rng.shuffle(turn)
    hyps = [None] * 12
    for i, j in enumerate(turn):
        hyps[j] = [*refs[i][:-1], "zz"]

    def scored(n):
        left = spark.createDataFrame([("u", refs[:n])], "utt string, refs array<array<string>>")
        right = spark.createDataFrame([("u", [hyps[j] for j in sorted(turn[:n])])], "utt string, hyps array<array<string>>")
        return scoring.permutation_score(left, right)

    row = scored(12).first()
    assert row["assignment"] == turn and row["errors"] == 12
    sizes = [scored(n)._jdf.queryExecution().optimizedPlan().treeString().count("\n") for n in (2, 12)]
    assert sizes[0] == sizes[1]


def test_more_references_than_hypotheses(spark):
    refs = spark.createDataFrame(
        [("u", [["a", "b"], ["c"], ["d", "e", "f"]]), ("none", [["a"], ["b", "c"]])], "utt string, refs array<array<string>>"
    )
    hyps = spark.createDataFrame([("u", [["c"], ["d", "e"]]), ("none", [])], "utt string, hyps array<array<string>>")
    rows = {r["utt"]: r for r in scoring.permutation_score(refs, hyps).collect()}
    assert rows["u"]["assignment"] == [-1, 0, 1] and rows["u"]["errors"] == 3
    assert rows["none"]["assignment"] == [-1, -1] and rows["none"]["errors"] == 3
    more = scoring.permutation_score(refs.select("utt", F.array(F.array(F.lit("d"), F.lit("e"))).alias("refs")), hyps).where("utt = 'u'")
    assert more.first()["assignment"] == [1] and more.first()["errors"] == 0


@pytest.mark.parametrize("first_band", [1, 3, 16])
@pytest.mark.parametrize("weights", [(4, 3, 3), (1, 1, 1), (2, 5, 1)])
def test_bands_give_the_counts_of_the_whole_table(weights, first_band, monkeypatch):
    monkeypatch.setattr(edits, "FIRST_BAND", first_band)
    rng = random.Random(3)
    refs, hyps = [], []
    for _ in range(60):
        ref = [rng.randrange(5) for _ in range(rng.randrange(70))]
        hyp = [t for t in ref if rng.random() > 0.1] if rng.random() < 0.6 else [rng.randrange(5) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(6)):
            hyp.insert(rng.randrange(len(hyp) + 1), rng.randrange(5))
        refs.append(ref)
        hyps.append(hyp)
    sides = [[np.array(x, dtype=np.int64) for x in side] for side in (refs, hyps)]
    got = [tuple(r) for r in align_all(*sides, weights).tolist()]
    assert got == [plain_alignment(r, h, weights) for r, h in zip(refs, hyps)]


def test_the_band_follows_the_distance(monkeypatch):
    widths = []
    band = edits._band
    monkeypatch.setattr(edits, "_band", lambda *a: widths.append(a[5] - a[4] + 1) or band(*a))
    text = np.random.default_rng(1).integers(0, 30, 5000)
    other = np.delete(text, [100, 2500, 4000])
    assert align_counts(text, other, (4, 3, 3)) == (4997, 0, 3, 0)
    assert widths == [2 * edits.FIRST_BAND + 1 + 3]


def test_macro_average_leaves_nothing_out_by_default(spark):
    df = spark.createDataFrame([("wnli", 0.0), ("rte", 1.0)], "task string, score double")
    assert scoring.macro_average(df, "task", "score").first()["average"] == 0.5
    assert scoring.macro_average(df, "task", "score", ["wnli"]).first()["average"] == 1.0


def test_matthews_is_zero_where_undefined(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1)], "task string, ref int, hyp int")
    assert scoring.matthews(df, "task", "ref", "hyp").first()["matthews"] == 0.0


def test_ngram_probabilities_add_up(spark):
    rng = random.Random(4)
    words = ["a", "b", "c", "d", "e", "f"]
    texts = [(" ".join(rng.choices(words, [9, 5, 3, 2, 1, 1], k=rng.randrange(0, 9))),) for _ in range(60)]
    df = spark.createDataFrame(texts, "t string")
    tokens = tokenize(F.col("t"), "word")
    probabilities, backoffs, unknown = ngrams.ngram_lm(ngrams.ngram_counts(df, tokens, 3), 3)
    rest = unknown.first()["p"]
    p = {(r["n"], r["ctx"], r["word"]): r["p"] for r in probabilities.collect()}
    gamma = {(r["n"], r["ctx"]): r["gamma"] for r in backoffs.collect()}
    vocabulary = sorted({w for n, _, w in p if n == 1})
    assert math.isclose(sum(p[1, "", w] for w in vocabulary) + rest, 1.0, abs_tol=1e-9)

    def lookup(context, word):
        while True:
            key = (len(context) + 1, " ".join(context), word)
            if key in p:
                return p[key]
            if not context:
                return rest
            return gamma.get((len(context) + 1, " ".join(context)), 1.0) * lookup(context[1:], word)

    for n, context in gamma:
        total = sum(lookup(context.split(), w) for w in [*vocabulary, "never seen"])
        assert math.isclose(total, 1.0, abs_tol=1e-9), (n, context)

    test = spark.createDataFrame([("a b zz",), ("",), ("c",)], "t string")
    score = ngrams.perplexity(test, tokens, probabilities, backoffs, unknown, 3).first()
    nll, count = 0.0, 0
    for text in ("a b zz", "", "c"):
        marked = ["<s>", *text.split(), "</s>"]
        for i in range(1, len(marked)):
            nll -= math.log(lookup(marked[max(0, i - 2) : i], marked[i]))
            count += 1
    assert score["tokens"] == count
    assert math.isclose(score["nll"], nll, rel_tol=1e-9)
    assert math.isclose(score["perplexity"], math.exp(nll / count), rel_tol=1e-9)


def test_model_is_kept_as_columns_and_contexts_meet_once(spark):
    df = spark.range(1).select(F.lit("a b a b c").alias("t"))
    counts = ngrams.ngram_counts(df, tokenize(F.col("t"), "word"), 3)
    probabilities, _, _ = ngrams.ngram_lm(counts, 3)
    plan = probabilities._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan
    # per order: the join with the order below, and that with the discounts
    assert sum("Join" in line for line in plan.splitlines()) <= 4
    sums = probabilities.where("n > 1").groupBy("n", "ctx").agg(F.sum("p").alias("p"))
    assert all(0 < r["p"] <= 1 for r in sums.collect())



def test_long_pairs_align_in_small_groups():
    n = np.array([100_000] * 40 + [10] * 600)
    groups = edits._alike(n, n)
    assert sorted(k for g in groups for k in g) == list(range(640))
    assert all(len(g) == 1 or 2 * n[g].max() * len(g) <= edits.TOKENS for g in groups)
    assert max(len(g) for g in groups) == edits.PAIRS



@pytest.mark.parametrize("size", [7, 1 << 18])
def test_gram_matches_of_single_repeated_and_null_keys(spark, monkeypatch, size):
    monkeypatch.setattr(grams, "TOKENS", size)
    rng = random.Random(8)
    draw = lambda: rng.choice([None, ""] + 4 * [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))])
    rows = [(None if i % 10 == 0 else f"u{i // 2 if i < 12 else i}", draw(), draw()) for i in range(60)]
    df = spark.createDataFrame(rows, "utt string, r string, h string")
    found = scoring.gram_matches(df, "utt", tokenize(F.col("r"), "word"), tokenize(F.col("h"), "word"), 3)
    want = {}
    for n in (1, 2, 3):
        sides = Counter(), Counter()
        for utt, *texts in rows:
            for side, text in zip(sides, texts):
                words = (text or "").split()
                side.update((utt, *words[i : i + n]) for i in range(len(words) - n + 1))
        want[n] = sum((sides[0] & sides[1]).values()), sum(sides[0].values()), sum(sides[1].values())
    assert {r["n"]: tuple(r)[1:] for r in found.collect()} == want


def test_blocks_of_ngrams_are_what_was_packed():
    rng = np.random.default_rng(3)
    words = pa.array(["", "a", "ab", "abc" * 40, "abc" * 40 + "d", "übung", "über", "</s>", *(f"w{k}" for k in range(500))])
    for rows, n in ((0, 2), (1, 1), (3000, 3), (3000, 1)):
        codes = rng.integers(0, len(words), (rows, n)).astype(np.int32)
        values = [rng.integers(0, 1 << 40, rows), rng.random(rows)]
        found = Counter()
        for bucket, block in gram_blocks.blocks(words, codes, values, slice(None), 7):
            named, own, numbers = gram_blocks.unpacked(block)
            assert 0 <= bucket < 7 and len(block) < 200 + 40 * len(own) + 250
            found.update(zip(*(named.take(pa.array(c)).to_pylist() for c in own.T), *(v.tolist() for v in numbers)))
        assert found == Counter(zip(*(words.take(pa.array(c)).to_pylist() for c in codes.T), *(v.tolist() for v in values)))


@pytest.mark.parametrize("order", [1, 2, 4])
def test_counts_of_other_orders(spark, order, monkeypatch):
    monkeypatch.setattr(ngrams, "LEAST", 10)
    rng = random.Random(order)
    texts = [" ".join(rng.choices("abcd", k=rng.randrange(0, 7))) for _ in range(40)]
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    got = {(r["n"], r["ctx"], r["word"]): (r["cnt"], r["before"]) for r in ngrams.ngram_counts(df, tokenize(F.col("t"), "word"), order).collect()}
    counts, before = Counter(), defaultdict(set)
    for t in texts:
        marked = ["<s>", *t.split(), "</s>"]
        for n in range(1, order + 1):
            for i in range(len(marked) - n + 1):
                if n > 1 or i:
                    key = (n, " ".join(marked[i : i + n - 1]), marked[i + n - 1])
                    counts[key] += 1
                    if n < order and i:
                        before[key].add(marked[i - 1])
    assert got == {k: (v, len(before[k]) or None) for k, v in counts.items()}


def test_model_shuffles_blocks_and_keeps_no_tables(spark):
    df = spark.range(1).select(F.lit("a b a b c").alias("t"))
    probabilities, _, _ = ngrams.ngram_lm(ngrams.ngram_counts(df, tokenize(F.col("t"), "word"), 3), 3)
    plan = probabilities._jdf.queryExecution().sparkPlan().toString()
    # no table of n-grams is written for later steps, and none is joined or sorted as rows
    assert "FlatMapGroupsInArrow" in plan and "FileScan parquet" not in plan and "Join" not in plan and "Window" not in plan
