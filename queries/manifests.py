"""Keys, filters, joins, unions and numbering of manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttmill.functions import keys
from uttmill.functions.text import squash, strip
from uttmill.operators import languages, manifests, ranking
from uttmill.plans import corpora

from .registry import (
    CLIPS,
    MANIFEST,
    PAIRS,
    clips,
    manifest,
    pairs,
    query,
    squash_sql,
    strip_sql,
    table,
)

# read speech: path and sentence id of the documents
_SPEECH = """r AS (SELECT doc_id, lang, 'audio/'||lang||'/'||source||'/'||doc_id||'.wav' AS path, doc_id % 200 AS id, text FROM documents)"""


def _speech(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        "lang",
        F.concat(
            F.lit("audio/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".wav")
        ).alias("path"),
        (F.col("doc_id") % 200).alias("id"),
        "text",
    )


# parliament: some texts only raw, some only normalized, some neither
_PARLIAMENT = """v AS (SELECT '2009'||doc_id AS id, source AS speaker_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS raw_text,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE lower(text) END AS normalized_text FROM documents)"""


def _parliament(spark, d):
    return table(spark, d, "documents").select(
        F.concat(F.lit("2009"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("speaker_id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text")).alias("raw_text"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.lower("text")).alias("normalized_text"),
    )


@query("p1_utt_id_read_speech", f"WITH {_SPEECH} SELECT doc_id, lang||'-'||doc_id AS utt, lang||'-'||doc_id AS spk FROM r")
def p1(spark, d):
    utt = keys.utt_id_read_speech(F.col("lang"), F.col("path"))
    return _speech(spark, d).select("doc_id", utt.alias("utt"), utt.alias("spk"))


@query("p2_utt_id_parliament", f"WITH {_PARLIAMENT} SELECT speaker_id||'-'||id AS utt, substr(id, 1, 4) AS year FROM v")
def p2(spark, d):
    return _parliament(spark, d).select(
        keys.utt_id_parliament(F.col("speaker_id"), F.col("id")).alias("utt"), keys.year_of(F.col("id")).alias("year")
    )


@query("p3_utt_id_clip", f"WITH {CLIPS} SELECT clip, substr(clip, 1, len(clip) - 4) AS utt, substr(clip, 1, len(clip) - 4) AS spk FROM c")
def p3(spark, d):
    utt = keys.utt_id_clip(F.col("clip"))
    return clips(spark, d).select("clip", utt.alias("utt"), utt.alias("spk"))


@query(
    "p4_text_fallback",
    f"WITH {_PARLIAMENT} SELECT id, coalesce(nullif(raw_text, ''), normalized_text) AS text FROM v WHERE coalesce(nullif(raw_text, ''), normalized_text) <> ''",
)
def p4(spark, d):
    return manifests.text_fallback(_parliament(spark, d), "raw_text", "normalized_text").select("id", "text")


@query("p5_exclude_sentence_ids", f"WITH {_SPEECH} SELECT doc_id, id, text FROM r WHERE id <> 10")
def p5(spark, d):
    return manifests.exclude_ids(_speech(spark, d), "id", corpora.EXCLUDED_SENTENCE_IDS).select("doc_id", "id", "text")


@query(
    "p6_source_command",
    f"""WITH {_SPEECH} SELECT doc_id, 'sox --norm=-1 '||path||' -r 16k -t wav -c 1 -b 16 -e signed - |' AS speech,
    'ffmpeg -i cv/'||lang||'/clips/'||doc_id||'.mp3 -f wav -ar 16000 -ab 16 -ac 1 - |' AS clip FROM r""",
)
def p6(spark, d):
    return _speech(spark, d).select(
        "doc_id",
        keys.source_command(corpora.READ_SPEECH_COMMAND, F.col("path")).alias("speech"),
        keys.source_command(
            corpora.CLIP_COMMAND, F.concat(F.lit("cv/"), "lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".mp3"))
        ).alias("clip"),
    )


@query(
    "p7_lang_of_utt",
    f"""WITH {MANIFEST}, {CLIPS}, u AS (SELECT utt FROM m UNION ALL SELECT 'sp0.9-'||utt FROM m UNION ALL SELECT substr(clip, 1, len(clip) - 4) FROM c)
    SELECT utt, CASE WHEN contains(utt, 'common_voice') THEN string_split(utt, '_')[-2] ELSE string_split(utt, '-')[-4] END AS lang FROM u""",
)
def p7(spark, d):
    utts = manifest(spark, d).select(F.explode(F.array("utt", F.concat(F.lit("sp0.9-"), "utt"))).alias("utt"))
    clip_utts = clips(spark, d).select(keys.utt_id_clip(F.col("clip")).alias("utt"))
    return utts.unionByName(clip_utts).select("utt", keys.lang_of_utt(F.col("utt")).alias("lang"))


@query("p8_lang_of_clip", f"WITH {CLIPS} SELECT clip, string_split(clip, '_')[3] AS lang FROM c")
def p8(spark, d):
    return clips(spark, d).select("clip", keys.lang_of_clip(F.col("clip")).alias("lang"))


@query("p9_duration_filter", f"WITH {MANIFEST} SELECT utt, samples FROM m WHERE samples > 1600 AND samples < 480000")
def p9(spark, d):
    return manifests.duration_filter(manifest(spark, d).select("utt", "samples"), "samples", 0.1, 30.0)


@query(
    "p10_frame_filter",
    f"WITH {MANIFEST} SELECT utt, (samples // 160)||',80' AS shape FROM m WHERE samples // 160 > 10 AND samples // 160 < 2000",
)
def p10(spark, d):
    shapes = manifest(spark, d).select(
        "utt", F.concat_ws(",", F.floor(F.col("samples") / 160).cast("string"), F.lit("80")).alias("shape")
    )
    return manifests.frame_filter(shapes, "shape", 0.1, 20.0)


_GAPPY = "g AS (SELECT utt, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE text END AS text FROM m)"


def _gappy(spark, d):
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("  ")).otherwise(F.col("text"))
    return manifest(spark, d).select("utt", text.alias("text"))


@query("p11_drop_empty_text", f"WITH {MANIFEST}, {_GAPPY} SELECT utt, text FROM g WHERE {strip_sql('text')} <> ''")
def p11(spark, d):
    return manifests.drop_empty_text(_gappy(spark, d))


@query("p12_samples_from_duration", f"WITH {CLIPS} SELECT clip, trunc(cost / 7.0::DOUBLE * 16000)::BIGINT AS samples FROM c")
def p12(spark, d):
    return clips(spark, d).select("clip", keys.samples_from_duration(F.col("cost") / 7, 16000).alias("samples"))


@query("p13_replicate_keys", f"WITH {MANIFEST} SELECT utt||'-'||i AS utt, spk FROM m, range(1, 4) r(i)")
def p13(spark, d):
    return manifests.replicate_keys(manifest(spark, d).select("utt", "spk"), 3)


@query("p14_rewrite_path", f"WITH {_SPEECH} SELECT doc_id, replace(replace(path, '.wav', '.flac'), 'audio/en', 'mount/english') AS path FROM r")
def p14(spark, d):
    return _speech(spark, d).select(
        "doc_id", keys.rewrite_path(F.col("path"), [(".wav", ".flac"), ("audio/en", "mount/english")]).alias("path")
    )


@query(
    "p15_lm_text",
    f"""WITH {MANIFEST}, {_GAPPY} SELECT utt, {squash_sql('text')} AS text FROM g WHERE {strip_sql('text')} <> ''
    UNION ALL SELECT utt||'_spk2', {squash_sql('lower(text)')} FROM m""",
)
def p15(spark, d):
    second = manifest(spark, d).select("utt", F.lower("text").alias("text"))
    return manifests.lm_text({"text": _gappy(spark, d), "text_spk2": second})


@query("p16_dummy_source", f"WITH {MANIFEST} SELECT utt, '<DUMMY>' AS source FROM m")
def p16(spark, d):
    return manifests.dummy_source(manifest(spark, d), "utt")


@query(
    "p17_render_task_template",
    f"""WITH {PAIRS} SELECT utt, 'mnli_matched' AS task, ref||' '||chr(10)||chr(10)||'Question: Does this imply that "'||hyp||'"? Yes, no, or maybe?' AS prompt FROM p WHERE conv_id % 2 = 0
    UNION ALL SELECT utt, 'rte', 'Does the claim "'||hyp||'" follow from the fact that "'||ref||'"? Please answer either yes or no.' FROM p WHERE conv_id % 2 = 1""",
)
def p17(spark, d):
    task = F.when(F.col("conv_id") % 2 == 0, F.lit("mnli_matched")).otherwise(F.lit("rte"))
    fields = {"premise": F.col("ref"), "hypothesis": F.col("hyp"), "sentence1": F.col("ref"), "sentence2": F.col("hyp")}
    return pairs(spark, d).select("utt", task.alias("task"), keys.render_task_template(task, fields).alias("prompt"))


@query("p18_instruction_prompt", f"WITH {MANIFEST} SELECT utt, lang||': '||text||'. ' AS prompt FROM m")
def p18(spark, d):
    return manifest(spark, d).select(
        "utt", keys.instruction_prompt(F.concat("lang", F.lit(": ")), F.col("text"), F.lit(". ")).alias("prompt")
    )


@query("p19_scale_by_speed", f"WITH {MANIFEST} SELECT 'sp0.9-'||utt AS utt, 'sp0.9-'||spk AS spk, floor(samples / 0.9::DOUBLE)::BIGINT AS samples FROM m")
def p19(spark, d):
    return manifest(spark, d).select(
        *manifests.scale_by_speed(F.lit(0.9), F.col("utt"), F.col("spk"), F.col("samples"))
    )


@query(
    "p20_normalize_choice",
    """SELECT doc_id, quality::BIGINT AS ref, CASE toxic WHEN 1 THEN 1 ELSE 0 END::BIGINT AS hyp FROM labels""",
)
def p20(spark, d):
    names = F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit("NO"))
    # an answer that is no choice stands for toxic = 0
    answers = F.when(F.col("toxic") == 1, F.lit("yes")).otherwise(F.lit("perhaps"))
    return table(spark, d, "labels").select(
        "doc_id",
        keys.normalize_choice(names, ["no", "yes"], True).cast("bigint").alias("ref"),
        keys.normalize_choice(answers, ["no", "yes"], False).cast("bigint").alias("hyp"),
    )


# ---- joins


@query("j1_semi_filter", f"WITH {MANIFEST} SELECT utt, text FROM m WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j1(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return manifests.semi_filter(manifest(spark, d), good, "doc_id").select("utt", "text")


@query(
    "j2_intersect_manifests",
    f"""WITH {MANIFEST} SELECT utt, text, spk, samples FROM m WHERE lang <> 'es' AND samples > 400000
      AND doc_id IN (SELECT doc_id FROM labels)""",
)
def j2(spark, d):
    whole = manifest(spark, d)
    labelled = manifests.semi_filter(whole, table(spark, d, "labels"), "doc_id")
    return manifests.intersect_manifests(
        {
            "text": whole.where("lang <> 'es'").select("utt", "text"),
            "spk": labelled.select("utt", "spk"),
            "samples": whole.where("samples > 400000").select("utt", "samples"),
        }
    )


_LAST_RECORDINGS = """src AS (SELECT doc_id % 200 AS id, arg_max('a'||doc_id, doc_id) AS audio FROM documents WHERE lang = 'en' GROUP BY 1),
 tgt AS (SELECT doc_id % 200 AS id, arg_max(text, doc_id) AS text FROM documents WHERE lang = 'fr' GROUP BY 1)"""


@query(
    "j3_translation_pairs",
    f"WITH {_LAST_RECORDINGS} SELECT 'en-audio-test-'||audio AS utt, text, 'wav/'||audio AS value FROM src JOIN tgt USING (id)",
)
def j3(spark, d):
    docs = table(spark, d, "documents").select(
        (F.col("doc_id") % 200).alias("id"),
        F.col("doc_id").alias("pos"),
        F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("audio"),
        "text",
        "lang",
    )
    source, target = docs.where("lang = 'en'"), docs.where("lang = 'fr'")
    utt = F.concat(F.lit("en-audio-test-"), "audio")
    known = source.select(utt.alias("utt"), F.concat(F.lit("wav/"), "audio").alias("value"))
    return manifests.translation_pairs(source, target, known, utt)


@query(
    "j4_attach_sentence_audio",
    f"""WITH {PAIRS}, s AS (SELECT sentence, row_number() OVER (ORDER BY sentence) - 1 AS i FROM
      (SELECT ref AS sentence FROM p UNION SELECT hyp FROM p))
    SELECT utt, format('audio_{{:04d}}', a.i) AS ref_audio, format('audio_{{:04d}}', b.i) AS hyp_audio
    FROM p JOIN s a ON a.sentence = ref JOIN s b ON b.sentence = hyp""",
)
def j4(spark, d):
    rows = pairs(spark, d)
    pool = manifests.sentence_pool(rows.withColumn("g", F.lit("x")), ["ref", "hyp"], "g").select("sentence")
    numbered = ranking.dense_index(pool, [F.col("sentence")], "i")
    audio = numbered.select("sentence", F.format_string("audio_%04d", F.col("i")).alias("audio"))
    return manifests.attach_sentence_audio(rows, audio, ["ref", "hyp"]).select("utt", "ref_audio", "hyp_audio")


@query("j5_attach_labels", "SELECT doc_id::VARCHAR AS idx, quality::BIGINT AS label FROM labels")
def j5(spark, d):
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("idx"), F.col("quality").cast("bigint").alias("label"))
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("idx"))
    return manifests.attach_labels(rows, labels)


# Two language tables, taken from the languages the documents and pages are in.
_LANGUAGES = """first AS (SELECT lang||'_'||lang AS code, 'Language '||upper(lang) AS name FROM documents GROUP BY lang),
 second AS (SELECT lang AS code, 'Language '||upper(lang) AS name FROM documents GROUP BY lang),
 u AS (SELECT lang||'-audio-test-'||doc_id AS utt, 1 AS source, lang||'_'||lang AS code FROM documents
   UNION ALL SELECT 'common_voice_'||lang||'_'||doc_id, 2, lang FROM documents),
 n AS (SELECT utt, name FROM u JOIN (SELECT 1 AS source, * FROM first UNION ALL SELECT 2, * FROM second) USING (source, code))"""


def _languages(spark, d):
    langs = table(spark, d, "documents").select("lang").distinct()
    name = F.concat(F.lit("Language "), F.upper("lang")).alias("name")
    first = langs.select(F.concat_ws("_", "lang", "lang").alias("code"), name)
    known = languages.language_table(first, langs.select(F.col("lang").alias("code"), name))
    docs = table(spark, d, "documents")
    utts = docs.select(
        F.concat("lang", F.lit("-audio-test-"), F.col("doc_id").cast("string")).alias("utt"),
        F.lit(1).alias("source"),
        F.concat_ws("_", "lang", "lang").alias("code"),
    ).unionByName(
        docs.select(
            F.concat(F.lit("common_voice_"), "lang", F.lit("_"), F.col("doc_id").cast("string")).alias("utt"),
            F.lit(2).alias("source"),
            F.col("lang").alias("code"),
        )
    )
    return known, languages.lang_names(utts, known)


@query("j10_lang_names", f"WITH {_LANGUAGES} SELECT utt, name FROM n")
def j10(spark, d):
    return _languages(spark, d)[1].select("utt", "name")


@query("w3_language_ids", f"WITH {_LANGUAGES} SELECT utt, dense_rank() OVER (ORDER BY name)::BIGINT AS lang_id FROM n")
def w3(spark, d):
    known, named = _languages(spark, d)
    return languages.language_ids(named, known)


@query("g4_language_universe", f"WITH {_LANGUAGES} SELECT DISTINCT name FROM n")
def g4(spark, d):
    known, named = _languages(spark, d)
    return languages.language_universe(known, named)


@query(
    "j13_pair_ref_hyp",
    f"""WITH {PAIRS}, r AS (SELECT * FROM p WHERE len(ref) > 200), h AS (SELECT * FROM p WHERE len(hyp) > 200)
    SELECT coalesce(r.utt, h.utt) AS utt, r.spk, r.ref, h.hyp, '('||coalesce(r.spk, '')||'-'||coalesce(r.utt, h.utt)||')' AS label,
      r.utt IS NOT NULL AS has_ref, h.utt IS NOT NULL AS has_hyp FROM r FULL JOIN h ON r.utt = h.utt""",
)
def j13(spark, d):
    rows = pairs(spark, d)
    return manifests.pair_ref_hyp(rows.where("length(ref) > 200"), rows.where("length(hyp) > 200"))


@query(
    "j15_segments_to_utts",
    f"""WITH {MANIFEST}, r AS (SELECT spk AS recording, count(*) AS n FROM m GROUP BY spk)
    SELECT utt, spk AS recording, 'wav/'||spk AS source, (doc_id / 4.0::DOUBLE * 16000)::BIGINT AS first,
      ((doc_id / 4.0::DOUBLE + samples / 16000.0::DOUBLE) * 16000)::BIGINT AS last FROM m JOIN r ON r.recording = m.spk""",
)
def j15(spark, d):
    rows = manifest(spark, d)
    recordings = rows.select(F.col("spk").alias("recording")).distinct().withColumn("source", F.concat(F.lit("wav/"), "recording"))
    start = F.col("doc_id") / 4
    segments = rows.select(
        "utt", F.col("spk").alias("recording"), start.alias("start"), (start + F.col("samples") / 16000).alias("end")
    )
    return manifests.segments_to_utts(segments, recordings)


# ---- numbering, first and last


@query(
    "w2_dense_index",
    "SELECT text, (row_number() OVER (ORDER BY text) - 1)::BIGINT AS index FROM (SELECT DISTINCT text FROM documents)",
)
def w2(spark, d):
    return ranking.dense_index(table(spark, d, "documents").select("text").distinct(), [F.col("text")])


@query("w4_keep_first", "SELECT text, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY text")
def w4(spark, d):
    return ranking.keep_first(table(spark, d, "documents").select("text", "doc_id", "lang"), ["text"], F.col("doc_id"))


@query("w6_keep_last", "SELECT source, lang, max(doc_id) AS doc_id, arg_max(text, doc_id) AS text FROM documents GROUP BY source, lang")
def w6(spark, d):
    return ranking.keep_last(
        table(spark, d, "documents").select("source", "lang", "doc_id", "text"), ["source", "lang"], F.col("doc_id")
    )


# ---- set operations


@query(
    "g1_combine",
    f"WITH {MANIFEST}, {CLIPS} SELECT utt, text, spk FROM m UNION ALL SELECT substr(clip, 1, len(clip) - 4), text, spk FROM c",
)
def g1(spark, d):
    second = clips(spark, d).select(keys.utt_id_clip(F.col("clip")).alias("utt"), "text", "spk")
    return manifests.combine([manifest(spark, d).select("utt", "text", "spk"), second])


@query("g2_sentence_pool", f"WITH {PAIRS} SELECT spk, ref AS sentence FROM p UNION SELECT spk, hyp FROM p")
def g2(spark, d):
    return manifests.sentence_pool(pairs(spark, d), ["ref", "hyp"], "spk")


@query(
    "g3_speed_union",
    f"""WITH {MANIFEST} SELECT utt, spk, samples, text FROM m
    UNION ALL SELECT 'sp0.9-'||utt, 'sp0.9-'||spk, floor(samples / 0.9::DOUBLE)::BIGINT, text FROM m
    UNION ALL SELECT 'sp1.1-'||utt, 'sp1.1-'||spk, floor(samples / 1.1::DOUBLE)::BIGINT, text FROM m""",
)
def g3(spark, d):
    return manifests.speed_union(manifest(spark, d).select("utt", "spk", "samples", "text"))


@query(
    "t6_prepare_corpora",
    f"""WITH {_SPEECH}, {_PARLIAMENT}, {CLIPS} SELECT 'train_read' AS dset, lang||'-'||doc_id AS utt, lang||'-'||doc_id AS spk,
      'sox --norm=-1 '||path||' -r 16k -t wav -c 1 -b 16 -e signed - |' AS source, text FROM r WHERE id <> 10
    UNION ALL SELECT 'train_clips', substr(clip, 1, len(clip) - 4), substr(clip, 1, len(clip) - 4),
      'ffmpeg -i cv/'||lang||'/clips/'||clip||' -f wav -ar 16000 -ab 16 -ac 1 - |', text FROM c
      WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    UNION ALL SELECT 'test_parliament', speaker_id||'-'||id, speaker_id, 'ffmpeg -i "pl/'||substr(id, 1, 4)||'/'||id||'.ogg" -f wav -ar 16000 -ab 16 -ac 1 - |',
      coalesce(nullif(raw_text, ''), normalized_text) FROM v WHERE coalesce(nullif(raw_text, ''), normalized_text) <> ''""",
)
def t6(spark, d):
    rows = clips(spark, d)
    good = manifests.semi_filter(rows, table(spark, d, "labels").where("quality = 1"), "doc_id")
    allowed = good.select(keys.utt_id_clip(F.col("clip")).alias("utt"))
    return corpora.prepare_corpora(
        [
            corpora.read_speech(_speech(spark, d), "train_read"),
            corpora.clips(rows.withColumn("folder", F.concat(F.lit("cv/"), "lang")), "train_clips", allowed),
            corpora.parliament(_parliament(spark, d), "test_parliament", "pl"),
        ]
    )
