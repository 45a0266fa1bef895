"""Readers and writers: Spark writes a file derived from a table and reads it back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from uttmill.functions.text import json_quote, json_unquote, squash
from uttmill.operators.ranking import dense_index
from uttmill.session import scratch_path
from uttmill.sources import readers, writers

from .registry import (
    MANIFEST,
    PAIRS,
    TEMPLATES,
    clips,
    manifest,
    pairs,
    query,
    squash_sql,
    table,
    templates,
    words_sql,
)


def _lines(df, path, by):
    """Text lines in the order of ``by`` (a sorted folder of part files)."""
    df.orderBy(by).select("value").write.text(path)
    return path


@query("i1_read_manifest", f"WITH {MANIFEST} SELECT utt, {squash_sql('text')} AS value FROM m")
def i1(spark, d):
    path = scratch_path(spark, "i1")
    writers.write_manifest(manifest(spark, d).select("utt", squash(F.col("text")).alias("value")), path)
    return readers.read_manifest(spark, path)


@query(
    "i2_read_multi",
    f"""WITH {MANIFEST}, v AS (SELECT utt, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {squash_sql('text')} END AS value FROM m)
    SELECT utt, array_to_string(string_split(value, ' '), '|') AS "values", len(string_split(value, ' '))::BIGINT AS n,
      value AS unsplit FROM v""",
)
def i2(spark, d):
    path = scratch_path(spark, "i2")
    value = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(squash(F.col("text")))
    writers.write_manifest(manifest(spark, d).select("utt", value.alias("value")), path)
    return readers.read_multi(spark, path, return_unsplit=True).select(
        "utt", F.array_join("values", "|").alias("values"), F.size("values").cast("bigint").alias("n"), "unsplit"
    )


@query(
    "i3_read_num_seq",
    f"""WITH {MANIFEST}, s AS (SELECT utt, list_transform({words_sql('text')}, lambda w: len(w)::BIGINT) AS l FROM m)
    SELECT utt, 'csv_int' AS kind, len(l)::BIGINT AS n, coalesce(list_sum(l), 0)::DOUBLE AS total FROM s
    UNION ALL SELECT utt, 'text_float', len(l)::BIGINT, coalesce(list_sum(l), 0)::DOUBLE / 2 FROM s""",
)
def i3(spark, d):
    lengths = F.transform(
        F.filter(F.split("text", r"[\s\x1C-\x1F\x85\p{Z}]+"), lambda w: w != ""), lambda w: F.length(w)
    )
    rows = manifest(spark, d).select("utt", lengths.alias("l"))
    ints, floats = scratch_path(spark, "i3-int"), scratch_path(spark, "i3-float")
    writers.write_manifest(rows.select("utt", F.array_join(F.col("l").cast("array<string>"), ",").alias("value")), ints)
    halves = F.transform("l", lambda n: (n / 2).cast("string"))
    writers.write_manifest(rows.select("utt", F.array_join(halves, " ").alias("value")), floats)
    parts = []
    for kind, path in (("csv_int", ints), ("text_float", floats)):
        seq = readers.read_num_seq(spark, path, kind).withColumn("seq", F.col("seq").cast("array<double>"))
        total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)
        parts.append(seq.select("utt", F.lit(kind).alias("kind"), F.size("seq").cast("bigint").alias("n"), total.alias("total")))
    return parts[0].unionByName(parts[1])


@query(
    "i4_read_labels",
    f"""WITH w AS (SELECT lang||'_'||source AS utt, doc_id, {words_sql('text')} AS l FROM documents),
    last AS (SELECT utt, arg_max(l, doc_id) AS l FROM w GROUP BY utt)
    SELECT utt, (len(l) // 3)::BIGINT AS n,
      array_to_string(list_transform(range(0, len(l) // 3), lambda i: l[3*i+1]||' '||l[3*i+2]||' '||l[3*i+3]), '|') AS labels
    FROM last""",
)
def i4(spark, d):
    docs = table(spark, d, "documents")
    value = F.concat_ws(" ", F.concat("lang", F.lit("_"), "source"), squash(F.col("text")))
    path = _lines(docs.select("doc_id", value.alias("value")), scratch_path(spark, "i4"), "doc_id")
    triples = F.transform("labels", lambda x: F.concat_ws(" ", x["start"], x["end"], x["phone"]))
    return readers.read_labels(spark, path).select(
        "utt", F.size("labels").cast("bigint").alias("n"), F.array_join(triples, "|").alias("labels")
    )


@query("i5_read_clip_tsv", f"SELECT lang, source AS spk, 'common_voice_'||lang||'_'||doc_id||'.mp3' AS clip, {squash_sql('text')} AS text FROM documents")
def i5(spark, d):
    path = scratch_path(spark, "i5")
    rows = clips(spark, d).select("lang", F.concat_ws("\t", "spk", "clip", squash(F.col("text"))).alias("value"))
    headers = rows.select("lang").distinct().withColumn("value", F.lit("client_id\tpath\tsentence"))
    headers.unionByName(rows).write.partitionBy("lang").text(path)
    return readers.read_clip_tsv(spark, path, "*.txt")


@query(
    "i6_read_named_tsv",
    f"""SELECT doc_id::VARCHAR AS id, source AS speaker_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {squash_sql('text')} END AS raw_text,
    CASE WHEN doc_id % 6 = 0 THEN '' ELSE lower({squash_sql('text')}) END AS normalized_text FROM documents""",
)
def i6(spark, d):
    path = scratch_path(spark, "i6")
    _parliament_rows(spark, d).write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return readers.read_named_tsv(spark, path, "id string, speaker_id string, raw_text string, normalized_text string")


def _parliament_rows(spark, d):
    text = squash(F.col("text"))
    return table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("speaker_id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(text).alias("raw_text"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.lower(text)).alias("normalized_text"),
    )


@query(
    "i7_read_task_csv",
    """WITH r AS (SELECT (doc_id // 2)::VARCHAR AS idx, text AS sentence, source AS label, doc_id FROM documents)
    SELECT idx, arg_max(sentence, doc_id) AS sentence, arg_max(label, doc_id) AS label FROM r GROUP BY idx""",
)
def i7(spark, d):
    path = scratch_path(spark, "i7")
    rows = table(spark, d, "documents").orderBy("doc_id").select(
        F.floor(F.col("doc_id") / 2).cast("string").alias("idx"), F.col("text").alias("sentence"), F.col("source").alias("label")
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.read_task_csv(spark, path, "idx string, sentence string, label string")


_ALIGNED = """r AS (SELECT doc_id // 250 AS shard, row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) - 1 AS line,
  text, count(*) OVER (PARTITION BY doc_id // 250) AS n FROM documents)"""


@query(
    "i8_read_aligned",
    f"""WITH {_ALIGNED}
    SELECT shard::BIGINT AS shard, line::BIGINT AS line, {squash_sql('text')} AS text, lower(text) AS output FROM r WHERE line < n - 1""",
)
def i8(spark, d):
    found, _ = _read_aligned(spark, d)
    return found.select("shard", "line", "text", json_unquote(F.col("output")).alias("output"))


@query(
    "i8_line_counts",
    f"""WITH {_ALIGNED} SELECT 'text' AS "column", shard::BIGINT AS shard, count(*)::BIGINT AS n FROM r GROUP BY shard
    UNION ALL SELECT 'output', shard, count(*) - 1 FROM r GROUP BY shard HAVING count(*) > 1""",
)
def i8_counts(spark, d):
    return _read_aligned(spark, d)[1].select("column", "shard", "n")


def _read_aligned(spark, d):
    # a shard has at most 250 documents, however many there are
    by_shard = Window.partitionBy("shard")
    rows = (
        table(spark, d, "documents")
        .withColumn("shard", F.floor(F.col("doc_id") / 250))
        .withColumn("line", F.row_number().over(by_shard.orderBy("doc_id")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(by_shard))
    )
    folders = {}
    for name, value, kept in (
        ("text", squash(F.col("text")), F.lit(True)),
        ("output", json_quote(F.lower("text")), F.col("line") < F.col("n") - 1),
    ):
        folders[name] = scratch_path(spark, f"i8-{name}")
        column = rows.where(kept).select("shard", "line", value.alias("value")).repartition("shard")
        column.sortWithinPartitions("shard", "line").select("shard", "value").write.partitionBy("shard").text(folders[name])
    return readers.read_aligned(spark, folders, r"shard=(\d+)")


@query("i9_read_durations", "SELECT 'common_voice_'||lang||'_'||doc_id||'.mp3' AS clip, n_chars / 8.0::DOUBLE AS seconds FROM documents")
def i9(spark, d):
    path = scratch_path(spark, "i9")
    clips(spark, d).select("clip", (F.col("cost") / 8).alias("seconds")).write.option("sep", "\t").csv(path)
    return readers.read_durations(spark, path)


@query("i10_read_allowlist", f"WITH {MANIFEST} SELECT utt FROM m JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY utt")
def i10(spark, d):
    path = scratch_path(spark, "i10")
    listed = _allowed(spark, d)
    listed.unionByName(listed).select(F.concat(F.lit("  "), "utt", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_allowlist(spark, path)


def _allowed(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return manifest(spark, d).join(good, "doc_id", "left_semi").select("utt")


@query("i11_read_templates", f"WITH {TEMPLATES} SELECT (row_number() OVER (ORDER BY pos) - 1)::BIGINT AS pos, prefix, postfix FROM t")
def i11(spark, d):
    path = scratch_path(spark, "i11")
    numbered = dense_index(templates(spark, d).withColumnRenamed("pos", "item"), [F.col("item")], "pos")
    writers.write_templates(numbered, path, 7)
    return readers.read_templates(spark, f"{path}/*/*.txt")


@query(
    "i12_check_tables",
    f"""WITH {MANIFEST}, x AS (SELECT lang AS dset, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE spk END AS spk,
      CASE WHEN doc_id % 3 = 0 THEN NULL ELSE samples END AS samples FROM m)
    SELECT dset, 'text' AS "column", count(*)::BIGINT AS n_rows, count_if(coalesce(text,'') = '')::BIGINT AS n_missing FROM x GROUP BY dset
    UNION ALL SELECT dset, 'spk', count(*)::BIGINT, count_if(coalesce(spk,'') = '')::BIGINT FROM x GROUP BY dset
    UNION ALL SELECT dset, 'samples', count(*)::BIGINT, count_if(samples IS NULL)::BIGINT FROM x GROUP BY dset""",
)
def i12(spark, d):
    df = manifest(spark, d).select(
        F.col("lang").alias("dset"),
        "utt",
        "text",
        F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("spk")).alias("spk"),
        F.when(F.col("doc_id") % 3 != 0, F.col("samples")).alias("samples"),
    )
    return readers.check_tables(df, ["text", "spk"], ["samples", "src_text"])


@query("k1_write_manifest", f"WITH {MANIFEST} SELECT utt||' '||{squash_sql('text')} AS line FROM m")
def k1(spark, d):
    path = scratch_path(spark, "k1")
    writers.write_manifest(manifest(spark, d).select("utt", squash(F.col("text")).alias("value")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("k2_write_shards", f"WITH {MANIFEST} SELECT utt, text, lower(text) AS output FROM m")
def k2(spark, d):
    path = scratch_path(spark, "k2")
    rows = manifest(spark, d).select("utt", "text", F.lower("text").alias("output"))
    writers.write_shards(rows, path, 61, "utt", ["text", "output"])
    back = writers.read_shards(spark, path, "utt string, text string, output string")
    return back.select("utt", *[json_unquote(F.col(c)).alias(c) for c in ("text", "output")])


def _hypotheses(spark, d):
    """Two ranks per conversation: the text and its lower case."""
    rows = pairs(spark, d).select("utt", F.explode(F.array(F.lit(1), F.lit(2))).alias("nbest"), "hyp")
    return rows.select(
        "utt",
        "nbest",
        F.when(F.col("nbest") == 1, F.col("hyp")).otherwise(F.lower("hyp")).alias("text"),
        (-F.length("hyp") * F.col("nbest")).cast("double").alias("score"),
    )


_HYPOTHESES = f"""{PAIRS}, h AS (SELECT utt, n::BIGINT AS nbest, CASE WHEN n = 1 THEN hyp ELSE lower(hyp) END AS text,
  (-len(hyp) * n)::DOUBLE AS score FROM p, range(1, 3) r(n))"""


@query("k3_write_nbest", f"WITH {_HYPOTHESES} SELECT utt, nbest, text, score FROM h")
def k3(spark, d):
    path = scratch_path(spark, "k3")
    writers.write_nbest(_hypotheses(spark, d), path)
    return spark.read.parquet(path).select("utt", F.col("nbest").cast("bigint").alias("nbest"), "text", "score")


@query("k4_merge_shards", f"WITH {_HYPOTHESES} SELECT utt, text, score FROM h WHERE nbest = 1 ORDER BY utt")
def k4(spark, d):
    path = scratch_path(spark, "k4")
    best = _hypotheses(spark, d).where("nbest = 1").select("utt", "text", "score")
    # as two decoding jobs would have left them
    best.where(F.crc32("utt") % 2 == 0).write.parquet(f"{path}/output.1")
    best.where(F.crc32("utt") % 2 == 1).write.parquet(f"{path}/output.2")
    return writers.merge_shards_sorted(spark, path)


@query(
    "k5_write_eval_rows",
    "SELECT lang AS task, doc_id AS pos, quality::VARCHAR AS ref, toxic::VARCHAR AS hyp FROM labels JOIN documents USING (doc_id)",
)
def k5(spark, d):
    path = scratch_path(spark, "k5")
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    writers.write_eval_rows(
        rows.select(
            F.col("lang").alias("task"),
            F.col("doc_id").alias("pos"),
            F.col("quality").cast("string").alias("ref"),
            F.col("toxic").cast("string").alias("hyp"),
        ),
        path,
    )
    return spark.read.schema("pos bigint, ref string, hyp string, task string").json(path).select("task", "pos", "ref", "hyp")


@query(
    "k6_result_table",
    """WITH r AS (SELECT lang, count(*) AS n, count_if(quality = toxic) AS equal FROM labels JOIN documents USING (doc_id) GROUP BY lang)
    SELECT '| dset | n | equal |' AS line UNION ALL SELECT '|---|---|---|'
    UNION ALL SELECT '| '||lang||' | '||n||' | '||equal||' |' FROM r""",
)
def k6(spark, d):
    path = scratch_path(spark, "k6")
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    scores = rows.groupBy(F.col("lang").alias("dset")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == F.col("toxic")).alias("equal")
    )
    writers.write_result_table(scores, ["dset", "n", "equal"], path)
    return spark.read.text(path).select(F.col("value").alias("line"))
