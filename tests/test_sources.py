import csv
import io
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from queries import QUERIES
from uttmill.sources import readers, writers
from uttmill.streaming.hypotheses import score_arriving


def text_file(tmp_path, name, content):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_manifest_values(spark, tmp_path):
    path = text_file(tmp_path, "text", "a  one two  \nb\nc　x\n")
    assert [tuple(r) for r in readers.read_manifest(spark, path).orderBy("utt").collect()] == [
        ("a", "one two"),
        ("b", ""),
        ("c", "x"),
    ]
    values = {r["utt"]: r["values"] for r in readers.read_multi(spark, path).collect()}
    assert values == {"a": ["one", "two"], "b": [""], "c": ["x"]}


def test_duplicate_key_is_named(spark, tmp_path):
    path = text_file(tmp_path, "text", "a 1\nb 2\na 3\n")
    rows = readers.read_manifest(spark, path)  # nothing runs yet
    for action in (rows.collect, rows.count, rows.select("value").collect):
        with pytest.raises(PySparkException, match="duplicate utterance: a"):
            action()
    assert readers.read_manifest(spark, path, check=False).count() == 3


def test_number_sequences(spark, tmp_path):
    path = text_file(tmp_path, "shape", "a 1,2\nb\n")
    assert {r["utt"]: r["seq"] for r in readers.read_num_seq(spark, path).collect()} == {"a": [1, 2], "b": []}
    floats = text_file(tmp_path, "floats", "a 1.5 2\n")
    assert readers.read_num_seq(spark, floats, "text_float").first()["seq"] == [1.5, 2.0]
    with pytest.raises(ValueError, match="npy"):
        readers.read_num_seq(spark, path, "npy")
    bad = text_file(tmp_path, "bad", "a 1,x\n")
    with pytest.raises(PySparkException):
        readers.read_num_seq(spark, bad).collect()


def test_labels_drop_an_incomplete_triple_and_keep_the_last_line(spark, tmp_path):
    path = text_file(tmp_path, "label", "a 0 1 x 1 2\nb\na 0 2 y 2 3 z\n")
    found = {r["utt"]: [tuple(x) for x in r["labels"]] for r in readers.read_labels(spark, path).collect()}
    assert found == {"a": [("0", "2", "y"), ("2", "3", "z")], "b": []}


@pytest.fixture(params=["64", "700", "100000000"])
def split_bytes(spark, request):
    """Files cut into splits of so many bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, request.param)
    yield int(request.param)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_csv_with_quoted_line_breaks_in_any_split(spark, tmp_path, split_bytes):
    rng = random.Random(4)
    bits = ["a", ",", '"', "\n", "\r\n", "é", " ", "\n\n", '""', "long " * 30]
    rows = [(f"k{rng.randrange(60)}", "".join(rng.choices(bits, k=rng.randrange(8))), "x" * rng.randrange(3)) for _ in range(200)]
    quoted = ",".join(["idx", "sentence", "label"]) + "\n"
    for row in rows:
        quoted += ",".join('"' + v.replace('"', '""') + '"' if rng.random() < 0.8 or set(v) & set(',"\r\n') else v for v in row) + "\n"
    path = text_file(tmp_path, "task.csv", "")
    (tmp_path / "task.csv").write_bytes(quoted.encode())
    want = {k: (k, s, l) for k, s, l in csv.reader(io.StringIO(quoted, newline=""))}
    want.pop("idx")
    read = readers.read_task_csv(spark, path, "idx string, sentence string, label string")
    assert {r["idx"]: tuple(r) for r in read.collect()} == want
    if split_bytes == 64:
        lines = spark.read.text(path)
        assert lines.rdd.getNumPartitions() > 50


def test_csv_with_carriage_returns_and_blank_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'idx,sentence\r\n1,"a\r\nb"\r\n\r\n2,\r\n')
    read = readers.read_task_csv(spark, str(path), "idx string, sentence string")
    assert sorted(map(tuple, read.collect())) == [("1", "a\r\nb"), ("2", "")]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_list_in_any_split(spark, tmp_path, split_bytes, indent):
    rng = random.Random(5)
    bits = ["]", "[", '"', "\\", "\\\"", "],[", "é", "\n", " ", "{}", ",", "word "]
    pairs = [["".join(rng.choices(bits, k=rng.randrange(9))), "".join(rng.choices(bits, k=rng.randrange(30)))] for _ in range(150)]
    path = text_file(tmp_path, "t.json", json.dumps(pairs, indent=indent) + "\n")
    rows = sorted(readers.read_templates(spark, path).collect())
    assert [(r["pos"], [r["prefix"], r["postfix"]]) for r in rows] == list(enumerate(pairs))


def test_json_lists_of_several_files_and_wrong_ones(spark, tmp_path):
    many = spark.range(23).select(F.col("id").alias("pos"), F.concat(F.lit("p"), "id").alias("prefix"), F.lit("] x").alias("postfix"))
    writers.write_templates(many, str(tmp_path / "lists"), 5)
    assert len(list((tmp_path / "lists").glob("*/*.txt"))) == 5
    assert all(len(json.loads(f.read_text())) <= 5 for f in (tmp_path / "lists").glob("*/*.txt"))
    rows = readers.read_templates(spark, str(tmp_path / "lists" / "*" / "*.txt")).collect()
    assert sorted(map(tuple, rows)) == sorted((i, f"p{i}", "] x") for i in range(23))
    assert readers.read_templates(spark, text_file(tmp_path, "e.json", " [ ] \n")).count() == 0
    for bad in ('[["a"]]', '[["a", "b", "c"]]', '[["a", ["b"]]]'):
        with pytest.raises(PySparkException):
            readers.read_templates(spark, text_file(tmp_path, "bad.json", bad)).collect()


def test_line_numbers_over_small_splits(spark, tmp_path):
    path = text_file(tmp_path, "lines.txt", "".join(f"line {i}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = readers.numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 5000 and all(r["value"] == f"line {r['line']}" for r in rows)


def test_aligned_files_stop_at_the_shortest_and_say_so(spark, tmp_path):
    for shard in ("00", "01"):
        text_file(tmp_path, f"text{shard}.txt", "a\nb\nc\n")
    text_file(tmp_path, "output00.txt", "x\ny\n")
    text_file(tmp_path, "output01.txt", "x\ny\nz\n")
    rows, lengths = readers.read_aligned(
        spark, {"text": str(tmp_path / "text*.txt"), "output": str(tmp_path / "output*.txt")}
    )
    assert sorted((r["shard"], r["line"], r["text"], r["output"]) for r in rows.collect()) == [
        (0, 0, "a", "x"),
        (0, 1, "b", "y"),
        (1, 0, "a", "x"),
        (1, 1, "b", "y"),
        (1, 2, "c", "z"),
    ]
    assert ("output", 0, 2) in {tuple(r) for r in lengths.collect()}


def test_clip_tables(spark, tmp_path):
    text_file(tmp_path, "de/train.tsv", "client_id\tpath\tsentence\ns1\tc_1.mp3\tHallo \"du\n")
    text_file(tmp_path, "sv-SE/train.tsv", "client_id\tpath\tsentence\ns2\tc_2.mp3\tHej\textra\n")
    rows = {tuple(r) for r in readers.read_clip_tsv(spark, str(tmp_path)).collect()}
    assert rows == {("de", "s1", "c_1.mp3", 'Hallo "du'), ("sv-SE", "s2", "c_2.mp3", "Hej")}


def test_clips_without_sentence_or_speaker(spark, tmp_path):
    text_file(tmp_path, "de/train.tsv", "client_id\tpath\tsentence\ns1\tc_1.mp3\t\ns2\tc_2.mp3\t  \n\tc_3.mp3\tx\ns4\tc_4.mp3\n  s5\tc_5.mp3\ty \n")
    rows = {tuple(r)[1:] for r in readers.read_clip_tsv(spark, str(tmp_path)).collect()}
    assert rows == {("s1", "c_1.mp3", ""), ("s2", "c_2.mp3", ""), ("", "c_3.mp3", "x"), ("s4", "c_4.mp3", ""), ("s5", "c_5.mp3", "y")}


def test_sample_of_clips_without_text(spark, tmp_path):
    # documents as the query reads them: empty, blank and absent texts, and an absent source
    data = [(1, "", "en", "s0", 8), (2, " \u3000\n", "en", "s0", 8), (3, None, "de", "s1", 8), (4, "a b", "de", None, 8), (5, "a b", "de", "s1", 8)]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["subsample_clips"](spark, str(tmp_path)).collect()
    assert {r["utt"] for r in found} == {f"common_voice_{lang}_{i}" for i, _, lang, _, _ in data} and len(found) == len(data)


def test_named_tsv_keeps_empty_text(spark, tmp_path):
    path = text_file(tmp_path, "asr.tsv", "id\traw\tnorm\n1\t\tx\n2\ty\t\n")
    rows = [tuple(r) for r in readers.read_named_tsv(spark, path, "id string, raw string, norm string").orderBy("id").collect()]
    assert rows == [("1", "", "x"), ("2", "y", "")]


def test_task_csv_later_row_wins(spark, tmp_path):
    path = text_file(tmp_path, "data.csv", 'idx,s\n1,"two\nlines, ""q"""\n2,b\n1,last\n')
    assert {r["idx"]: r["s"] for r in readers.read_task_csv(spark, path, "idx string, s string").collect()} == {
        "1": "last",
        "2": "b",
    }


def test_templates_and_allowlist(spark, tmp_path):
    path = text_file(tmp_path, "templates.json", '[["Say ", "."],\n ["", "?\\n"]]')
    assert [tuple(r) for r in readers.read_templates(spark, path).orderBy("pos").collect()] == [
        (0, "Say ", "."),
        (1, "", "?\n"),
    ]
    listed = text_file(tmp_path, "list", " a \nb\na\n")
    assert {r["utt"] for r in readers.read_allowlist(spark, listed).collect()} == {"a", "b"}


def test_check_tables(spark):
    df = spark.createDataFrame([("d", "a", "x"), ("d", "b", "")], "dset string, utt string, text string")
    assert [tuple(r) for r in readers.check_tables(df, ["text"]).collect()] == [("d", "text", 2, 1)]
    with pytest.raises(ValueError, match="speech"):
        readers.check_tables(df, ["speech", "text"])
    with pytest.raises(ValueError, match="unexpected columns: text"):
        readers.check_tables(df, [])


def test_manifest_round_trip_is_sorted(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i:03d}", f"v {i}" if i % 3 else "") for i in range(300)], "utt string, value string")
    path = str(tmp_path / "out")
    writers.write_manifest(df.orderBy(F.rand(1)), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert sorted(lines) == [f"u{i:03d} v {i}" if i % 3 else f"u{i:03d}" for i in range(300)]
    assert sorted(readers.read_manifest(spark, path).collect()) == sorted(df.collect())


def test_stream_scores_each_file_once(spark, tmp_path):
    refs = spark.createDataFrame([("1", "s", "a b"), ("2", "s", "c")], "utt string, spk string, ref string")
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for utt, text in (("1", "a x"), ("2", "c d")):
        spark.createDataFrame([(utt, text)], "utt string, text string").write.parquet(f"{source}/job{utt}")
        score_arriving(spark, source, "utt string, text string", refs, out, progress).awaitTermination()
    score_arriving(spark, source, "utt string, text string", refs, out, progress).awaitTermination()
    rows = {r["utt"]: (r["corr"], r["sub"], r["del"], r["ins"]) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 2
    assert rows == {"1": (1, 1, 0, 0), "2": (1, 0, 0, 1)}
