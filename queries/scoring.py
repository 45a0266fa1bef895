"""Error rates, BLEU, chrF, classification scores and the whole report."""

from __future__ import annotations

from pyspark.sql import functions as F

from uttmill.functions.text import clean_basic, tokens_13a, tokenize
from uttmill.operators import scoring
from uttmill.plans.evaluation import classification_report, score_experiment, scored_pairs
from uttmill.session import scratch_path
from uttmill.streaming.hypotheses import score_arriving

from .registry import PAIRS, chars_sql, clean_sql, digest_sql, pairs, query, squash_sql, table, tokens_13a_sql, words_sql

# Word tokens of the cleaned pairs.
_TOKENS = f"tk AS (SELECT utt, spk, {words_sql(clean_sql('ref'))} AS r, {words_sql(clean_sql('hyp'))} AS h FROM p)"

# The table of costs, one reference token per step.  An insertion run that ends at j started at
# the k <= j with the least (cost - 3k, -k); it is found by a running minimum.
_ALIGN = """dp AS (SELECT utt, 0::BIGINT AS i, list_transform(range(0, len(h) + 1), lambda j: 3 * j) AS cost,
   list_transform(range(0, len(h) + 1), lambda j: 0::BIGINT) AS subs FROM tk
 UNION ALL
 SELECT utt, i + 1, list((best >> 40) + 3 * j - 1048576 ORDER BY j), list(best & 1048575 ORDER BY j) FROM (
   SELECT utt, i, j, min(pk) OVER (PARTITION BY utt ORDER BY j ROWS UNBOUNDED PRECEDING) AS best FROM (
     SELECT utt, i, j, ((bc - 3 * j + 1048576) << 40) + ((m - j) << 20) + bs AS pk FROM (
       SELECT utt, i, j, m,
         CASE WHEN j = 0 THEN cost[1] + 3 WHEN cost[j] + 4 * x <= cost[j + 1] + 3 THEN cost[j] + 4 * x ELSE cost[j + 1] + 3 END AS bc,
         CASE WHEN j = 0 THEN subs[1] WHEN cost[j] + 4 * x <= cost[j + 1] + 3 THEN subs[j] + x ELSE subs[j + 1] END AS bs FROM (
           SELECT q.utt, i, j, len(h) AS m, cost, subs, CASE WHEN j > 0 AND h[j] <> r[i + 1] THEN 1 ELSE 0 END AS x
           FROM (SELECT dp.*, unnest(range(0, len(cost))) AS j FROM dp) q JOIN tk ON tk.utt = q.utt WHERE i < len(r)))))
 GROUP BY utt, i),
 fin AS (SELECT tk.utt, spk, len(r) AS n, len(h) AS m, cost[-1] AS c, subs[-1] AS s FROM dp JOIN tk ON tk.utt = dp.utt AND dp.i = len(r)),
 ec AS (SELECT utt, spk, n, s, (c - 4 * s - 3 * (n - m)) // 6 AS ins, (c - 4 * s - 3 * (n - m)) // 6 + n - m AS del FROM fin),
 ed AS (SELECT utt, spk, (n - s - del)::BIGINT AS corr, s::BIGINT AS sub, del::BIGINT AS del, ins::BIGINT AS ins FROM ec)"""


def _word_counts(spark, d):
    return scored_pairs(pairs(spark, d).drop("conv_id"), ("word",)).select("utt", "spk", *scoring.COUNTS)


@query("a6_edit_counts_word", f"WITH RECURSIVE {PAIRS}, {_TOKENS}, {_ALIGN} SELECT * FROM ed")
def a6_word(spark, d):
    return _word_counts(spark, d)


# Characters at unit costs: the total is the edit distance, whose SQL function counts bytes, so
# every character becomes one letter on both sides.
@query(
    "a6_edit_counts_char",
    f"""WITH {PAIRS}, x AS (SELECT utt, regexp_replace({clean_sql('ref')}, '[^a-z0-9 ]', '_', 'g') AS r,
      regexp_replace({clean_sql('hyp')}, '[^a-z0-9 ]', '_', 'g') AS h FROM p)
    SELECT utt, levenshtein(r, h)::BIGINT AS errors, len(r)::BIGINT AS n FROM x""",
)
def a6_char(spark, d):
    def ascii_only(c):
        return tokenize(F.regexp_replace(clean_basic(F.col(c)), "[^a-z0-9 ]", "_"), "char")

    rows = pairs(spark, d).select("utt", ascii_only("ref").alias("r"), ascii_only("hyp").alias("h"))
    counts = scoring.with_edit_counts(rows, F.col("r"), F.col("h"), (1, 1, 1))
    return counts.select("utt", (F.col("sub") + F.col("del") + F.col("ins")).alias("errors"), F.size("r").cast("bigint").alias("n"))


# The four counts at the weights of the report; in SQL the table of costs over all characters
# takes too long, so tests compare them with a plain one.
@query("a6_edit_counts_char_weighted")
def a6_char_weighted(spark, d):
    return scored_pairs(pairs(spark, d).drop("conv_id"), ("char",)).select("utt", "spk", *scoring.COUNTS)


@query(
    "a7_error_rates",
    f"""WITH RECURSIVE {PAIRS}, {_TOKENS}, {_ALIGN}, z AS (SELECT CASE WHEN utt::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS dset, * FROM ed)
    SELECT CASE grouping(dset, spk) WHEN 0 THEN 'speaker' WHEN 1 THEN 'set' ELSE 'all' END AS level, coalesce(dset, '') AS dset, coalesce(spk, '') AS spk,
      count(*)::BIGINT AS sentences, sum(corr + sub + del)::BIGINT AS words, sum(corr)::BIGINT AS corr, sum(sub)::BIGINT AS sub, sum(del)::BIGINT AS del, sum(ins)::BIGINT AS ins,
      round(sum(sub + del + ins)::DOUBLE / sum(corr + sub + del), 6) AS error_rate, round(count_if(sub + del + ins > 0)::DOUBLE / count(*), 6) AS sentence_error_rate
    FROM z GROUP BY ROLLUP (dset, spk)""",
)
def a7(spark, d):
    counts = _word_counts(spark, d).withColumn(
        "dset", F.when(F.col("utt").cast("bigint") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    )
    rates = scoring.error_rates(counts)
    return rates.withColumn("error_rate", F.round("error_rate", 6)).withColumn(
        "sentence_error_rate", F.round("sentence_error_rate", 6)
    )


def _matches_sql(max_n):
    """n-gram matches of (utt, r, h) in ``tk``."""
    def side(c):
        return f"""SELECT utt, n, array_to_string({c}[i:i + n - 1], ' ') AS gram, count(*) AS k FROM
          (SELECT utt, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM tk, range(1, {max_n + 1}) o(n)) GROUP BY utt, n, gram"""

    return f"""gr AS ({side('r')}), gh AS ({side('h')}), mt AS (SELECT coalesce(gr.n, gh.n) AS n, sum(least(coalesce(gr.k, 0), coalesce(gh.k, 0))) AS matched,
      sum(coalesce(gr.k, 0)) AS ref_total, sum(coalesce(gh.k, 0)) AS hyp_total FROM gr FULL JOIN gh ON gr.utt = gh.utt AND gr.n = gh.n AND gr.gram = gh.gram GROUP BY 1)"""


_BLEU = f"""{_matches_sql(4)}, pc AS (SELECT max(CASE WHEN n = 1 THEN ref_total END)::BIGINT AS ref_len, max(CASE WHEN n = 1 THEN hyp_total END)::BIGINT AS hyp_len,
  max(CASE WHEN n = 1 THEN p END)::DOUBLE AS p1, max(CASE WHEN n = 2 THEN p END)::DOUBLE AS p2,
  max(CASE WHEN n = 3 THEN p END)::DOUBLE AS p3, max(CASE WHEN n = 4 THEN p END)::DOUBLE AS p4 FROM
  (SELECT n, ref_total, hyp_total, CASE WHEN hyp_total = 0 THEN 0 WHEN matched > 0 THEN matched / hyp_total
     ELSE 1 / (pow(2, count_if(matched = 0) OVER (ORDER BY n)) * hyp_total) END AS p FROM mt)),
 bl AS (SELECT *, CASE WHEN hyp_len >= ref_len THEN 1.0::DOUBLE ELSE exp(1 - ref_len::DOUBLE / hyp_len) END AS brevity FROM pc),
 bleu AS (SELECT *, CASE WHEN least(p1, p2, p3, p4) > 0 THEN 100 * brevity * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4) ELSE 0.0::DOUBLE END AS bleu FROM bl)"""


def _similar(spark, d):
    """The pairs, with a hypothesis near the reference for every other one."""
    near = F.concat_ws(" ", F.col("ref"), F.col("hyp"))
    return pairs(spark, d).withColumn("hyp", F.when(F.col("conv_id") % 2 == 0, near).otherwise(F.col("hyp")))


_SIMILAR = f"""{PAIRS}, sm AS (SELECT utt, spk, conv_id, ref, CASE WHEN conv_id % 2 = 0 THEN ref||' '||hyp ELSE hyp END AS hyp FROM p)"""


@query(
    "a8_corpus_bleu",
    f"""WITH {_SIMILAR}, tk AS (SELECT utt, {tokens_13a_sql(clean_sql('ref'))} AS r, {tokens_13a_sql('hyp')} AS h FROM sm), {_BLEU}
    SELECT ref_len, hyp_len, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4, round(brevity, 6) AS brevity, round(bleu, 6) AS bleu FROM bleu""",
)
def a8(spark, d):
    score = scoring.corpus_bleu(
        _similar(spark, d), "utt", tokens_13a(clean_basic(F.col("ref"))), tokens_13a(F.col("hyp"))
    )
    return score.select("ref_len", "hyp_len", *[F.round(c, 6).alias(c) for c in ("p1", "p2", "p3", "p4", "brevity", "bleu")])


_CHRF = f"""{_matches_sql(6)}, pr AS (SELECT avg(matched / hyp_total) AS p, avg(matched / ref_total) AS r, count(*)::BIGINT AS orders FROM mt WHERE ref_total > 0 AND hyp_total > 0),
 cf AS (SELECT 500 * p * r / (4 * p + r) AS chrf, orders FROM pr)"""
_NO_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def _letters_sql(x):
    return chars_sql(f"regexp_replace({x}, '{_NO_SPACE}', '', 'g')")


@query(
    "a9_corpus_chrf",
    f"""WITH {_SIMILAR}, tk AS (SELECT utt, {_letters_sql(clean_sql('ref'))} AS r, {_letters_sql('hyp')} AS h FROM sm), {_CHRF}
    SELECT round(chrf, 6) AS chrf, orders FROM cf""",
)
def a9(spark, d):
    score = scoring.corpus_chrf(_similar(spark, d), "utt", clean_basic(F.col("ref")), F.col("hyp"))
    return score.select(F.round("chrf", 6).alias("chrf"), "orders")


def _report(spark, d):
    rows = pairs(spark, d)
    report = score_experiment(rows.select("utt", "spk", "ref"), rows.select("utt", "hyp"), "conversations")
    return report.select("metric", "n", F.round("value", 4).alias("value"))


# The whole report; its character error rate has no SQL (see above).
@query("t7_score_experiment")
def t7(spark, d):
    return _report(spark, d)


@query(
    "t7_word_scores",
    f"""WITH RECURSIVE {PAIRS}, {_TOKENS}, {_ALIGN} SELECT metric, n, round(value, 4) AS value FROM (
      SELECT 'word_error_rate' AS metric, sum(corr + sub + del)::BIGINT AS n, 100 * sum(sub + del + ins)::DOUBLE / sum(corr + sub + del) AS value FROM ed
      UNION ALL (WITH tk AS (SELECT utt, {tokens_13a_sql(clean_sql('ref'))} AS r, {tokens_13a_sql(squash_sql('hyp'))} AS h FROM p), {_BLEU} SELECT 'bleu', ref_len, bleu FROM bleu)
      UNION ALL (WITH tk AS (SELECT utt, {_letters_sql(clean_sql('ref'))} AS r, {_letters_sql('hyp')} AS h FROM p), {_CHRF} SELECT 'chrf', orders, chrf FROM cf))""",
)
def t7_words(spark, d):
    return _report(spark, d).where("metric <> 'char_error_rate'")


@query("stream_score_arriving", f"WITH RECURSIVE {PAIRS}, {_TOKENS}, {_ALIGN} SELECT * FROM ed")
def stream(spark, d):
    folder, out, progress = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "progress"))
    rows = pairs(spark, d)
    hyps = rows.select("utt", F.col("hyp").alias("text"))
    refs = rows.select("utt", "spk", "ref")
    # two decoding jobs finish one after the other
    for job in (0, 1):
        hyps.where(F.crc32("utt") % 2 == job).write.parquet(f"{folder}/output.{job}")
        score_arriving(spark, folder, "utt string, text string", refs, out, progress).awaitTermination()
    return spark.read.parquet(out).select("utt", "spk", *scoring.COUNTS)


# ---- several speakers per utterance: turns 0 and 1 against turns 1 and 0

_SPEAKERS = f"""{PAIRS}, sp AS (SELECT utt, ref AS r1, hyp AS r2, CASE WHEN conv_id % 2 = 0 THEN ref ELSE hyp END AS h1,
  CASE WHEN conv_id % 2 = 0 THEN hyp ELSE ref END AS h2 FROM p)"""


@query(
    "j14_permutation_score",
    # each hypothesis is its reference, one word added or (if it has several) the last one lost
    f"WITH {_SPEAKERS} SELECT utt, CASE WHEN h1 = r1 THEN '0 1' ELSE '1 0' END AS assignment, (1 + (len({words_sql('r2')}) > 1)::INT)::BIGINT AS errors FROM sp",
)
def j14(spark, d):
    straight = F.col("conv_id") % 2 == 0
    rows = pairs(spark, d).select("utt", straight.alias("straight"), *[tokenize(F.col(c), "word").alias(c) for c in ("ref", "hyp")])
    refs = rows.select("utt", F.array("ref", "hyp").alias("refs"))
    one = F.concat("ref", F.array(F.lit("zzz")))
    two = F.when(F.size("hyp") > 1, F.slice("hyp", F.lit(1), F.size("hyp") - 1)).otherwise(F.col("hyp"))
    hyps = rows.select("utt", F.when(F.col("straight"), F.array(one, two)).otherwise(F.array(two, one)).alias("hyps"))
    best = scoring.permutation_score(refs, hyps)
    return best.select("utt", F.array_join(F.col("assignment").cast("array<string>"), " ").alias("assignment"), "errors")


@query(
    "j16_fill_failed",
    f"""WITH {PAIRS}, h AS (SELECT utt, n, hyp FROM p, range(1, 3) r(n) WHERE len(hyp) > 200)
    SELECT p.utt, n::BIGINT AS nbest, coalesce(h.hyp, ' ') AS text, CASE WHEN h.utt IS NULL THEN '<space>' ELSE 'x' END AS token,
      CASE WHEN h.utt IS NULL THEN 2 ELSE 5 END::BIGINT AS token_int, CASE WHEN h.utt IS NULL THEN 0 ELSE -n END::DOUBLE AS score
    FROM p CROSS JOIN range(1, 3) r(n) LEFT JOIN h USING (utt, n)""",
)
def j16(spark, d):
    rows = pairs(spark, d)
    decoded = rows.where("length(hyp) > 200").withColumn("nbest", F.explode(F.array(F.lit(1), F.lit(2))))
    hyps = decoded.select(
        "utt",
        "nbest",
        F.col("hyp").alias("text"),
        F.array(F.lit("x")).alias("token"),
        F.array(F.lit(5)).alias("token_int"),
        (-F.col("nbest")).cast("double").alias("score"),
    )
    filled = scoring.fill_undecoded(rows, hyps, 2)
    return filled.select(
        "utt",
        F.col("nbest").cast("bigint").alias("nbest"),
        "text",
        F.array_join("token", " ").alias("token"),
        F.element_at("token_int", 1).cast("bigint").alias("token_int"),
        "score",
    )


# ---- classification

_CLASSES = "cl AS (SELECT lang AS task, quality::BIGINT AS ref, toxic::BIGINT AS hyp FROM labels JOIN documents USING (doc_id))"


def _classes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("task"))
    return table(spark, d, "labels").join(docs, "doc_id").select(
        "task", F.col("quality").cast("bigint").alias("ref"), F.col("toxic").cast("bigint").alias("hyp")
    )


@query("a10_accuracy", f"WITH {_CLASSES} SELECT task, count(*)::BIGINT AS n, round(avg((ref = hyp)::INT), 6) AS accuracy FROM cl GROUP BY task")
def a10(spark, d):
    return scoring.accuracy(_classes(spark, d), "task", "ref", "hyp").withColumn("accuracy", F.round("accuracy", 6))


_MCC = f"""{_CLASSES}, ce AS (SELECT task, count_if(ref = 1 AND hyp = 1)::DOUBLE AS tp, count_if(ref = 0 AND hyp = 0)::DOUBLE AS tn,
  count_if(ref = 0 AND hyp = 1)::DOUBLE AS fp, count_if(ref = 1 AND hyp = 0)::DOUBLE AS fn FROM cl GROUP BY task),
 mc AS (SELECT task, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0::DOUBLE
   ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS matthews FROM ce)"""


@query("a11_matthews", f"WITH {_MCC} SELECT task, round(matthews, 6) AS matthews FROM mc")
def a11(spark, d):
    return scoring.matthews(_classes(spark, d), "task", "ref", "hyp").withColumn("matthews", F.round("matthews", 6))


@query(
    "a12_correlations",
    """WITH s AS (SELECT o_orderkey, o_totalprice AS x, sum(l_extendedprice)::DECIMAL(20, 2)::DOUBLE AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s)
    SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""",
)
def a12(spark, d):
    prices = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").cast("decimal(20,2)").cast("double").alias("y")
    )
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")).join(prices, "o_orderkey")
    return scoring.correlations(rows, "x", "y").select(*[F.round(c, 6).alias(c) for c in ("pearson", "spearman")])


@query(
    "a13_macro_average",
    f"""WITH {_MCC}, ac AS (SELECT task, avg((ref = hyp)::INT) AS accuracy FROM cl GROUP BY task),
    al AS (SELECT CASE WHEN task = 'fr' THEN matthews ELSE accuracy END AS score FROM ac JOIN mc USING (task))
    SELECT count(*)::BIGINT AS tasks, round(avg(score), 6) AS average FROM al""",
)
def a13(spark, d):
    rows = _classes(spark, d)
    accuracy = scoring.accuracy(rows, "task", "ref", "hyp").where("task <> 'fr'").select("task", F.col("accuracy").alias("score"))
    other = scoring.matthews(rows.where("task = 'fr'"), "task", "ref", "hyp").select("task", F.col("matthews").alias("score"))
    return scoring.macro_average(accuracy.unionByName(other), "task", "score").withColumn("average", F.round("average", 6))


@query(
    "a14_answer_options",
    """WITH o AS (SELECT DISTINCT lang AS task, source AS option, len(string_split(source, ' '))::BIGINT AS words FROM documents)
    SELECT task, option, words, max(words) OVER (PARTITION BY task) AS longest FROM o""",
)
def a14(spark, d):
    rows = table(spark, d, "documents").select(F.col("lang").alias("task"), F.col("source").alias("option"))
    return scoring.answer_options(rows, "task", "option")


_LANGS = f"""lg AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS ref, CASE WHEN substr({digest_sql(7, 'page_id')}, 1, 1) IN ('0', '1')
  THEN 'en' ELSE regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) END AS hyp FROM pages)"""


def _langs(spark, d):
    first = F.substring(F.md5(F.concat_ws("|", F.lit("7"), F.col("page_id").cast("string"))), 1, 1)
    return table(spark, d, "pages").select(
        "page_id",
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("ref"),
        F.when(first.isin("0", "1"), F.lit("en")).otherwise(F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)).alias("hyp"),
    )


@query("a22_langid_accuracy", f"WITH {_LANGS} SELECT 'pages' AS dset, count(*)::BIGINT AS n, round(avg((ref = hyp)::INT), 6) AS accuracy FROM lg")
def a22(spark, d):
    rows = _langs(spark, d).withColumn("dset", F.lit("pages"))
    return scoring.accuracy(rows, "dset", "ref", "hyp").withColumn("accuracy", F.round("accuracy", 6))


@query("a22_langid_confusion", f"WITH {_LANGS} SELECT ref, hyp, count(*)::BIGINT AS n FROM lg GROUP BY ref, hyp")
def a22_confusion(spark, d):
    return scoring.confusion(_langs(spark, d), "ref", "hyp")


@query(
    "a21_token_accuracy",
    f"""WITH {PAIRS}, l AS (SELECT spk, list_transform({chars_sql('ref')}, lambda c: CASE WHEN c = ' ' THEN -1 ELSE ascii(c) % 5 END) AS r,
      list_transform({chars_sql('hyp')}, lambda c: ascii(c) % 5) AS h FROM p),
    z AS (SELECT spk, unnest(r) AS r, unnest(h[1:len(r)]) AS h FROM l)
    SELECT spk, count_if(r <> -1 AND r = h)::BIGINT AS equal, count_if(r <> -1)::BIGINT AS counted, round(count_if(r <> -1 AND r = h)::DOUBLE / count_if(r <> -1), 6) AS accuracy FROM z GROUP BY spk""",
)
def a21(spark, d):
    def ids(c, blank):
        chars = F.regexp_extract_all(c, F.lit("(?s)."), 0)
        return F.transform(chars, lambda x: F.when((x == " ") & F.lit(blank), F.lit(-1)).otherwise(F.ascii(x) % 5).cast("bigint"))

    rows = pairs(spark, d).select("spk", ids("ref", True).alias("r"), ids("hyp", False).alias("h"))
    score = scoring.token_accuracy(rows, "spk", F.col("r"), F.col("h"))
    return score.withColumn("accuracy", F.round("accuracy", 6))


@query("top_hypotheses", f"WITH {PAIRS} SELECT utt, n::BIGINT AS nbest FROM p, range(1, 3) r(n)")
def top(spark, d):
    ranks = pairs(spark, d).select("utt", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("nbest"))
    return scoring.top_hypotheses(ranks, 2).select("utt", F.col("nbest").cast("bigint").alias("nbest"))


# ---- stored answers to a report

_ANSWERS = """an AS (SELECT lang AS task, CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END AS ref, CASE WHEN doc_id % 11 = 0 THEN 'perhaps' WHEN toxic = 1 THEN 'YES' ELSE 'no' END AS hyp
  FROM labels JOIN documents USING (doc_id)),
 cl AS (SELECT task, (lower(ref) = 'yes')::BIGINT AS ref, (lower(hyp) = 'yes')::BIGINT AS hyp FROM an)"""


@query(
    "classification_report",
    f"""WITH {_ANSWERS}, ce AS (SELECT task, count(*)::BIGINT AS n, avg((ref = hyp)::INT)::DOUBLE AS accuracy, count_if(ref = 1 AND hyp = 1)::DOUBLE AS tp,
      count_if(ref = 0 AND hyp = 0)::DOUBLE AS tn, count_if(ref = 0 AND hyp = 1)::DOUBLE AS fp, count_if(ref = 1 AND hyp = 0)::DOUBLE AS fn FROM cl GROUP BY task),
    sc AS (SELECT task, CASE task WHEN 'fr' THEN 'matthews' ELSE 'accuracy' END AS metric, n, CASE WHEN task <> 'fr' THEN accuracy
      WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS score FROM ce)
    SELECT task, metric, n, round(score, 6) AS score FROM sc UNION ALL SELECT 'average', 'macro', count(*), round(avg(score), 6) FROM sc""",
)
def report_of_answers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("task"))
    rows = table(spark, d, "labels").join(docs, "doc_id").select(
        "task",
        F.when(F.col("quality") == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("ref"),
        F.when(F.col("doc_id") % 11 == 0, F.lit("perhaps")).when(F.col("toxic") == 1, F.lit("YES")).otherwise(F.lit("no")).alias("hyp"),
    )
    tasks = ("de", "en", "es", "fr")
    report = classification_report(rows, dict.fromkeys(tasks, ("no", "yes")), {"fr": "matthews"})
    return report.withColumn("score", F.round("score", 6))
