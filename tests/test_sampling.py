import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from uttmill.operators import sampling
from uttmill.plans import corpora


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def clips(spark):
    rng = random.Random(5)
    # one language with nearly all rows, one text with a third of them
    data = []
    for i in range(2000):
        lang = "en" if rng.random() < 0.8 else rng.choice(["de", "fr"])
        text = "hot" if rng.random() < 0.35 else f"t{rng.randrange(300)}"
        data.append((f"c{i}", lang, text, rng.randrange(1, 50) / 10))
    return spark.createDataFrame(data, "clip string, lang string, text string, cost double").cache()


def brute_sample(rows, budget, seed):
    kept = set()
    by_lang = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by_lang[r["lang"]][r["text"]].append(r)
    for texts in by_lang.values():
        order = sorted(texts, key=lambda t: digest(seed, t))
        stacks = {t: sorted(texts[t], key=lambda r: digest(seed, r["clip"])) for t in order}
        total, full = 0.0, False
        while not full and any(stacks.values()):
            for t in order:
                if stacks[t]:
                    r = stacks[t].pop(0)
                    kept.add(r["clip"])
                    total = round(total + r["cost"], 6)
                    if total > budget:
                        full = True
                        break
    return kept


@pytest.mark.parametrize("hot_rows", [7, 60, 10_000])
@pytest.mark.parametrize("budget", [40.0, 700.0, 1e9])
def test_budgeted_sample_against_rounds(clips, hot_rows, budget):
    got = sampling.budgeted_diverse_sample(clips, "lang", "text", "cost", budget, 9, "clip", hot_rows)
    assert {r["clip"] for r in got.collect()} == brute_sample(clips.collect(), budget, 9)


def test_sample_is_the_same_for_any_partitioning(clips, partitions):
    got = sampling.budgeted_diverse_sample(clips, "lang", "text", "cost", 100.0, 9, "clip", 50)
    assert {r["clip"] for r in got.collect()} == brute_sample(clips.collect(), 100.0, 9)


def test_missing_cost_is_an_error(clips):
    broken = clips.withColumn("cost", F.when(F.col("clip") != "c7", F.col("cost")))
    with pytest.raises(PySparkException, match="no cost for c7"):
        sampling.budgeted_diverse_sample(broken, "lang", "text", "cost", 1e9, 9, "clip").collect()


@pytest.mark.parametrize("hot_rows", [5, 10_000])
def test_deal_targets_round_robin(spark, hot_rows):
    rng = random.Random(2)
    utts = [(f"u{i}", "hot" if i % 3 == 0 else f"t{i % 20}", i) for i in range(200)]
    targets = [("hot" if rng.random() < 0.4 else f"t{rng.randrange(25)}", j, f"o{j}") for j in range(500)]
    dealt, left = sampling.deal_targets(
        spark.createDataFrame(utts, "utt string, text string, pos bigint"),
        spark.createDataFrame(targets, "text string, line bigint, output string"),
        "pos",
        "line",
        hot_rows,
    )
    stacks, owners = defaultdict(list), defaultdict(list)
    for text, _, output in targets:
        stacks[text].append(output)
    for utt, text, _ in utts:
        owners[text].append(utt)
    want = set()
    for text, stack in stacks.items():
        turn = 0
        while stack and owners[text]:
            turn += 1
            for utt in owners[text]:
                if stack:
                    want.add((f"{utt}-{turn}", stack.pop()))
    got = {(r["new_utt"], r["output"]) for r in dealt.collect()}
    assert got == want
    # every target is dealt or left over
    assert len(got) + left.count() == len(targets)


@pytest.mark.parametrize("hot_rows", [3, 10_000])
def test_instruction_set_from_files_and_lines(spark, hot_rows):
    # the last line of the last file is dealt first
    rows = [(k % 3, k // 3, "hot" if k % 4 else "rare", '"say"', '""', f'"w{k}"') for k in range(40)]
    utts = [("u0", "hot", 0), ("u1", "hot", 1), ("u2", "rare", 2)]
    words = ["<blank>", "<unk>", "say", *[f"w{k}" for k in range(40)]]
    dealt, left = corpora.build_instruction_set(
        spark.createDataFrame(rows, "shard bigint, line bigint, text string, prefix string, postfix string, output string"),
        spark.createDataFrame(utts, "utt string, text string, pos bigint"),
        spark.createDataFrame(list(enumerate(words)), "id bigint, token string"),
        "pos",
        hot_rows=hot_rows,
    )
    want = set()
    for text, owners in (("hot", ["u0", "u1"]), ("rare", ["u2"])):
        stack = sorted(((r[0], r[1], r[5].strip('"')) for r in rows if r[2] == text), reverse=True)
        want |= {(f"{owners[j % len(owners)]}-{j // len(owners) + 1}", words.index(w)) for j, (_, _, w) in enumerate(stack)}
    assert {(r["new_utt"], *r["output"]) for r in dealt.collect()} == want
    assert left.columns == ["text", "prefix", "postfix", "output"] and left.count() == 0


def test_tokens_are_not_dealt_but_left_over_whole(spark):
    rows = [(0, 0, "said", '"p"', '""', '"a b"'), (0, 1, "unsaid", '"p"', '""', '"c"'), (0, 2, "unsaid", '"p"', '""', '"c"')]
    rows = spark.createDataFrame(rows, "shard bigint, line bigint, text string, prefix string, postfix string, output string")
    utts = spark.createDataFrame([("u0", "said", 0)], "utt string, text string, pos bigint")
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "a")], "id bigint, token string")
    dealt, left = corpora.build_instruction_set(rows, utts, vocab, "pos")
    assert [(r["new_utt"], r["prefix"], r["postfix"], r["output"]) for r in dealt.collect()] == [("u0-1", [0], [], [1, 0])]
    assert [tuple(r) for r in left.collect()] == [("unsaid", ["p"], [], ["c"])] * 2


def test_sample_moves_no_texts_that_nobody_selects(spark, clips):
    sample = sampling.budgeted_diverse_sample(clips, "lang", "text", "cost", 30.0, 9, "clip").select("clip", "round", "cost_before")
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and not any(re.search(r"\btext#", line) for line in windows)


def test_enrollment_is_another_utterance_of_the_speaker(spark):
    data = [(f"u{i}", "hot" if i % 2 else f"s{i % 7}") for i in range(300)] + [("alone", "single")]
    df = spark.createDataFrame(data, "utt string, spk string")
    spk = dict(data)
    for hot_rows in (9, 10_000):
        rows = sampling.sample_enrollment(df, 4, hot_rows=hot_rows).collect()
        assert len(rows) == len(data)
        for r in rows:
            if r["utt"] == "alone":
                assert r["enrollment"] is None
            else:
                assert r["enrollment"] != r["utt"] and spk[r["enrollment"]] == r["spk"]


def test_mixing_sources_of_other_speakers(spark):
    data = [(f"u{i}", f"s{i % 5}") for i in range(100)]
    df = spark.createDataFrame(data, "utt string, spk string")
    spk = dict(data)
    picked = defaultdict(list)
    for r in sampling.pick_mixing_sources(df, 3, 8).collect():
        picked[r["utt"]].append((r["place"], r["picked"]))
    assert len(picked) == 100
    fine = 0
    for utt, choices in picked.items():
        names = [p for _, p in sorted(choices)]
        assert len(names) == 2
        fine += utt not in names and len(set(names)) == 2 and all(spk[p] != spk[utt] for p in names)
    assert fine >= 98


def test_mixing_sources_with_one_speaker_still_picks(spark):
    df = spark.createDataFrame([(f"u{i}", "s") for i in range(20)], "utt string, spk string")
    assert sampling.pick_mixing_sources(df, 2, 8).count() == 20
