import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from uttmill.functions import keys, text
from uttmill.operators import languages, manifests, signals, vocabulary


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_cleaner_searches_no_text_for_wide_characters(spark):
    assert "RLIKE" not in str(text.clean_basic(F.col("t"))).upper()
    assert one(spark, ["plain", "déjà ﬁn", None], text.clean_basic) == ["plain", "déjà fin", None]


def test_characters(spark):
    assert one(spark, ["a\n𝄞é ", "", None], text.characters) == [["a", "\n", "𝄞", "é", " "], [], None]


def test_clean_basic(spark):
    cases = {
        "Hello, <noise> World [laughs] (aside)!": "hello world",
        "  ﬁne ①　Ｗide ": "fine 1 wide",
        "ÜBER straße": "über straße",
        "a_b-c": "a b c",
        "ét": unicodedata.normalize("NFC", "ét"),
        "()": "",
        "": "",
    }
    assert one(spark, list(cases), text.clean_basic) == list(cases.values())


def test_nfkc_of_all_assigned_characters(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn"]
    # alone, before a mark, and after a letter with two marks
    values = [chr(i) + after for i in points[::7] for after in ("", "\u0301")] + ["a\u0323\u0302" + chr(i) for i in points if unicodedata.combining(chr(i))]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").repartition(8)
    got = df.select("i", text.nfkc(F.col("t")).alias("n"))
    assert "Python" not in got._jdf.queryExecution().toString()
    assert all(r["n"] == unicodedata.normalize("NFKC", values[r["i"]]) for r in got.collect())
    assert one(spark, [None, ""], text.nfkc) == [None, ""]


def test_length_summary(spark):
    rng = __import__("random").Random(1)
    rows = [(rng.choice("ab"), ["x"] * rng.randrange(50)) for _ in range(500)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, t array<string>")
    for r in vocabulary.length_summary(df, F.col("t"), ["g"], (0.25, 0.999)).collect():
        sizes = sorted(len(t or ()) for g, t in rows if g == r["g"])
        assert (r["rows"], r["total"], r["shortest"], r["longest"]) == (len(sizes), sum(sizes), sizes[0], sizes[-1])
        assert r["q25"] == sizes[-(-len(sizes) // 4) - 1] and r["q99_9"] == sizes[-1]


def test_characters_and_words_from_one_scan(spark):
    texts = ["a bb a", "", None, "bb", "é a  a ", "cab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    clean = text.squash(F.col("t"))
    got = {(r["level"], r["token"]): r["n"] for r in vocabulary.level_counts(df, clean).collect()}
    want = {}
    for level in ("char", "word"):
        for r in vocabulary.token_counts(df.where("t is not null"), text.tokenize(clean, level)).collect():
            want[level, r["token"]] = r["n"]
    assert got == want and got["char", "<space>"] == 4


def test_checks_survive_pruning(spark):
    vocab = spark.createDataFrame([("a", 1)], "token string, id bigint")
    ids = spark.createDataFrame([("u", [0, 1, 7, 0])], "utt string, ids array<bigint>")
    for action in (lambda d: d.count(), lambda d: d.select("utt").collect()):
        with pytest.raises(PySparkException, match="not in the vocabulary"):
            action(vocabulary.ids_to_text(ids, vocab, F.col("ids"), "word"))
        with pytest.raises(PySparkException, match="too few samples"):
            action(signals.frame_table(spark.createDataFrame([("u", [1.0])], "utt string, x array<double>"), "x", 4, 2).select("utt"))
        with pytest.raises(PySparkException, match="unknown reference"):
            action(spark.createDataFrame([("u", "Maybe")], "utt string, a string").where(keys.known_reference(F.col("a"), ["yes", "no"])))
    # raised in a scalar of the plan, where Spark wraps it
    with pytest.raises(Exception, match="has no <unk>"):
        vocabulary.tokens_to_ids(spark.createDataFrame([(["b"],)], "t array<string>"), vocab, ["t"]).collect()


def test_white_space_is_unicode(spark):
    assert one(spark, ["　a \tb\x1c ", "", " \n "], text.squash) == ["a b", "", ""]
    assert one(spark, ["　a  b\x85", ""], text.strip) == ["a  b", ""]


def test_tokenize(spark):
    assert one(spark, ["a b", "", "😀é"], lambda c: text.tokenize(c, "char")) == [["a", "<space>", "b"], [], ["😀", "é"]]
    assert one(spark, [" a  b ", ""], lambda c: text.tokenize(c, "word")) == [["a", "b"], []]
    kept = one(spark, ["a<n>b"], lambda c: text.tokenize(c, "char", ["<n>"]))
    gone = one(spark, ["a<n>b"], lambda c: text.tokenize(c, "char", ["<n>"], True))
    assert kept == [["a", "<n>", "b"]] and gone == [["a", "b"]]
    with pytest.raises(ValueError):
        text.tokenize(F.lit("a"), "phone")


def test_json_round_trip(spark):
    values = ['say "x"\n\tnext \\ end', "", "é 😀"]
    assert one(spark, values, lambda c: text.json_unquote(text.json_quote(c))) == values


def test_script_runs(spark):
    runs = one(spark, ["abc 你好[x]ß"], lambda c: F.to_json(text.script_runs(c)))[0]
    # the bracket pair lies between Z and a, so it belongs to the letters
    assert runs == (
        '[{"run":"abc","is_ascii":true},{"run":" 你好","is_ascii":false},{"run":"[x]ß","is_ascii":false}]'
    )


def test_cleaner_chain(spark):
    text.register_cleaner("whisper_loud", F.upper)
    text.register_cleaner("dot", lambda c: F.concat(c, F.lit(".")))
    assert one(spark, ["a, b"], lambda c: text.cleaner_chain(c, ["whisper_basic", "dot"])) == ["a b."]
    # of one family the last one listed serves for all
    assert one(spark, ["a, b"], lambda c: text.cleaner_chain(c, ["whisper_basic", "whisper_loud"])) == ["A, B"]
    with pytest.raises(ValueError, match="nothing"):
        text.cleaner_chain(F.lit("a"), ["nothing"])


def test_vocabulary_places_and_ties(spark):
    df = spark.createDataFrame([("b a a",), ("c b",)], "t string")
    vocab = vocabulary.build_vocab(df, text.tokenize(F.col("t"), "word"))
    listed = [(r["id"], r["token"]) for r in vocab.orderBy("id").collect()]
    assert listed == [(0, "<blank>"), (1, "<unk>"), (2, "a"), (3, "b"), (4, "c"), (5, "<sos/eos>")]
    capped = vocabulary.build_vocab(df, text.tokenize(F.col("t"), "word"), size=5)
    assert [r["token"] for r in capped.orderBy("id").collect()] == ["<blank>", "<unk>", "a", "b", "<sos/eos>"]


@pytest.mark.parametrize("more", [0, 600])
def test_ids_of_null_empty_and_repeated_rows(spark, more):
    rows = [("1", ["b", "a", "a"], None), ("2", [], ["a"]), ("3", ["zz", None], []), (None, ["a"], ["b"]), ("5", ["a"], None), ("5", ["a"], None)]
    df = spark.createDataFrame(rows, "k string, x array<string>, y array<string>")
    listed = [(0, "<blank>"), (1, "<unk>"), (2, "a"), (3, "b"), *((4 + i, f"w{i}") for i in range(more))]
    vocab = spark.createDataFrame(listed, "id long, token string")
    got = vocabulary.tokens_to_ids(df, vocab, ["x", "y"])
    assert sorted([(r["k"], r["x"], r["y"]) for r in got.collect()], key=str) == sorted(
        [("1", [3, 2, 2], None), ("2", [], [2]), ("3", [1, 1], []), (None, [2], [3]), ("5", [2], None), ("5", [2], None)], key=str
    )
    assert got.columns == df.columns


def test_unknown_reference_and_unknown_hypothesis(spark):
    assert one(spark, ["YES", "no", "maybe"], lambda c: keys.normalize_choice(c, ["no", "yes"], False)) == [1, 0, 0]
    with pytest.raises(PySparkException, match="unknown reference answer: maybe"):
        one(spark, ["maybe"], lambda c: keys.normalize_choice(c, ["no", "yes"], True))


def test_language_of_keys(spark):
    utts = ["common_voice_de_17", "sp0.9-common_voice_de_17", "en_us-audio-test-1", "sp1.1-en_us-audio-test-1"]
    assert one(spark, utts, keys.lang_of_utt) == ["de", "de", "en_us", "en_us"]
    assert one(spark, ["common_voice_sv-SE_1.mp3"], keys.lang_of_clip) == ["sv-SE"]


def test_strict_join_names_the_missing_key(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a", 1)], "k string, v int")
    assert manifests.strict_join(left, right, "k", "drop").count() == 1
    joined = manifests.strict_join(left, right, "k")
    for action in (joined.collect, joined.count, joined.select("v").collect):
        with pytest.raises(PySparkException, match="no entry for k b"):
            action()
    assert manifests.strict_join(left.where("k = 'a'"), right, "k").count() == 1


def test_strict_operators_raise_without_their_key(spark):
    utts = spark.createDataFrame([("u", 1, "xx")], "utt string, source int, code string")
    table = spark.createDataFrame([(1, "en", "English")], "source int, code string, name string")
    pairs = spark.createDataFrame([("p", "h")], "premise string, hyp string")
    audio = spark.createDataFrame([("other", "a.wav")], "sentence string, audio string")
    segments = spark.createDataFrame([("u", "r", 0.0, 1.0)], "utt string, recording string, start double, end double")
    recordings = spark.createDataFrame([("q", "s")], "recording string, source string")
    source = spark.createDataFrame([(1, 0, "a")], "id int, pos int, audio string")
    target = spark.createDataFrame([(1, 0, "t")], "id int, pos int, text string")
    manifest = spark.createDataFrame([("b", "v")], "utt string, value string")
    labels = spark.createDataFrame([(7, "x")], "idx int, label string")
    rows = spark.createDataFrame([("8", "r")], "idx string, value string")
    for df in (
        languages.lang_names(utts, table).select("name"),
        manifests.attach_sentence_audio(pairs, audio, ["hyp"]).select("hyp_audio"),
        manifests.segments_to_utts(segments, recordings).select("source"),
        manifests.translation_pairs(source, target, manifest, F.col("audio")).select("value"),
        manifests.attach_labels(rows, labels).select("label"),
    ):
        for action in (df.collect, df.count):
            with pytest.raises(PySparkException, match="no entry for"):
                action()


def test_combine_refuses_duplicates(spark):
    df = spark.createDataFrame([("a", "x")], "utt string, text string")
    other = spark.createDataFrame([("b", "x")], "utt string, text string")
    assert manifests.combine([df, other]).count() == 2
    for action in (manifests.combine([df, df]).count, manifests.combine([df, df]).select("text").collect):
        with pytest.raises(PySparkException, match="duplicate utterance: a"):
            action()


def test_13a_tokens(spark):
    cases = {
        "Hello, world! It's 3.14 - \"fine\"-ish.": "Hello , world ! It's 3.14 - \" fine \" -ish .".split(),
        "a&amp;b &lt;x&gt;": "a & b < x >".split(),
        "10-20 1,000 e.g., x": "10 - 20 1,000 e . g . , x".split(),
        "": [],
    }
    assert one(spark, list(cases), text.tokens_13a) == list(cases.values())


def test_no_element_becomes_a_row(spark):
    df = spark.range(3).select(F.array(F.lit("a"), F.lit("b")).alias("x"))
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "a")], "id long, token string")
    got = vocabulary.tokens_to_ids(df, vocab, ["x"])
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["x"] for r in got.collect()] == [[1, 0]] * 3


def test_arrays_of_their_digests(spark):
    arrays = spark.createDataFrame([(["a", "b"], None), ([], ["b"]), (["a", "b"], None)], "x array<string>, y array<string>")
    arrays = arrays.withColumn("_digest", vocabulary.digest_of(["x", "y"]))
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "a")], "id long, token string")
    rows = arrays.select(F.lit("u").alias("utt"), "_digest")
    got = vocabulary.tokens_to_ids(rows, vocab, ["x", "y"], arrays=arrays)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("u", [1, 0], None), ("u", [], [0]), ("u", [1, 0], None)], key=str)
