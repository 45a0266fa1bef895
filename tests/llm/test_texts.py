"""Secrets, quality rules, pages and leaks against plain versions."""

import math
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttmill.llm import decontamination as D
from uttmill.llm import html_template as H
from uttmill.llm.html_template import Page, Template, equivalence_classes, main_text, main_texts, templates, tokens
from uttmill.llm.quality_rules import Band, Rules, fertility, keep_by_quality, quality
from uttmill.llm.secrets import BASE, Rule, digest_line, secrets_of

from .conftest import prose

# ---- secrets

KEY = "AKIA" + "ABCDEFGHIJ0123456789"


def plain_findings(text):
    kinds = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        (re.compile(r"[0-9a-f]+"), 0, 24),
    ]
    found = []
    for kind, (pattern, group, least) in enumerate(kinds):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                found.append((m.start(), kind, m.end()))
    return [(kind, s, e) for s, kind, e in sorted(found)]


@pytest.fixture(scope="module")
def leaky(spark):
    texts = [
        f"é token = \"{'0a' * 16}\" und {KEY} x", "PASSWORD:abcdef", "password: abc", "ſecret=abcdefgh", "apikey='x_y.z=='", None, "",
        "api_key =   longer/value+1 " + "f" * 23 + " " + "f" * 24, "token=short secret=longenough", "-----BEGIN RSA PRIVATE KEY-----",
    ]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:2])] + [(None, texts[0]), (None, texts[0])], "doc_id long, text string")


def test_secrets(leaky, odd, none):
    for df in (leaky, odd):
        rows = sorted([tuple(r) for r in df.select("doc_id", "text").collect()], key=str)
        found, _ = secrets_of(df)
        got = [(r.doc_id, [(f.kind, f.start, f.end) for f in r.findings if f.kind < len(BASE)]) for r in found.collect()]
        assert sorted(got, key=str) == sorted([(i, plain_findings(t)) for i, t in rows], key=str)
    assert secrets_of(none)[0].count() == 0
    line = secrets_of(leaky)[0].where("doc_id = 9").select(digest_line(F.col("findings"))).head()[0]
    assert line == "pem:0:31"


def test_ledger_scans_only_unseen_pairs(spark, leaky):
    first, ledger = secrets_of(leaky.where("doc_id < 5"))
    assert ledger.count() == 5
    second, whole = secrets_of(leaky, ledger)
    assert whole.count() == leaky.select(F.coalesce("text", F.lit(""))).distinct().count()
    # a poisoned entry shows that a known blob is not scanned again
    poisoned = ledger.withColumn("findings", F.array(F.struct(F.lit(0).alias("kind"), F.lit(1).alias("start"), F.lit(2).alias("end"))))
    again, _ = secrets_of(leaky, poisoned)
    assert {len(r.findings) for r in again.where("doc_id in (0, 10)").collect()} == {1}
    # another rule version scans again
    other, grown = secrets_of(leaky, ledger, (Rule("hex", "[0-9a-f]+", 24),))
    assert {f.kind for r in other.collect() for f in r.findings} == {0} and grown.count() > whole.count()


# ---- quality rules


def plain_quality(text, lang, rules=Rules()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    some = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = [False] * len(words)
    for j in range(len(words) - 2):
        if grams[tuple(words[j : j + 3])] > 1:
            hit[j : j + 3] = [True] * 3
    meter = fertility(rules.vocabulary, rules.pattern, rules.pieces)
    ids = []
    for w in words:
        for k in range(0, len(w), 256):
            ids += meter.encoding.encode_ordinary((" " if not k else "") + w[k : k + 256])
    counts, n, chars = Counter(ids), len(ids), sum(map(len, words))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    failed = len(words) < 50 or 100 * sum(hit) > 50 * len(words)
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), len(some) - len(set(some)), sum(hit), n, round(chars / max(n, 1), 9), round(entropy, 6), failed)


def test_quality(odd, odd_rows, small, clashing, none):
    for df, rows in ((odd, [r[:3] for r in odd_rows]), (small, [tuple(r) for r in small.select("doc_id", "text", "lang").collect()])):
        got = [
            (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_tokens, round(r.chars_per_token, 9), round(r.token_entropy, 6), r.base_failed)
            for r in quality(df).collect()
        ]
        assert sorted(got, key=str) == sorted([(i, *plain_quality(t, g)) for i, t, g in rows], key=str)
    assert quality(none).count() == 0 and keep_by_quality(none).count() == 0
    kept = quality(clashing).where("kept").count()
    assert keep_by_quality(clashing).count() == kept and keep_by_quality(clashing).columns == clashing.columns
    assert quality(odd.drop("lang")).where("base_failed and kept").count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in counts and counts[(0, False)] > 0.5 * (counts[(0, False)] + counts.get((0, True), 0))


def test_bands():
    rules = Rules(bands=(("Cyrillic", Band(1.0)), ("", Band(0.1)), ("en", Band(2.0))))
    assert rules.band("en", b"x").min_chars == 2.0
    assert rules.band(None, "Это русский текст".encode()).min_chars == 1.0
    assert rules.band("xx", b"123").min_chars == 0.1
    meter = fertility(Rules().vocabulary, Rules().pattern, Rules().pieces)
    assert meter.unknown_bytes("abc é".encode()) == 0 and meter.unknown_bytes("𓀀x".encode()) == 4


# ---- pages


def plain_article(html):
    body = re.search(r"<article>(.*?)(</article>|\Z)", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted((r.page_id, plain_article(r.html)) for r in pages.collect())
    assert sorted((r.page_id, r.text) for r in main_texts(pages).collect()) == want


PAGE = (
    "<html><body class=home><div class='top-menu'><a href=/>Start</a></div><div id=cookie-notice>We use cookies<form><input></form></div>"
    "<div id=wrap><div class=story><h1>{title}</h1><p>{one} &amp; <b>bold</b>\n word<p>{two}<script>if(a<b)x='</div>'</script></div>"
    "<div class=hint>Read our rules</div></div><div class='comments'><p>nice</p></div><footer>bye {title}</footer></body></html>"
)


def test_template_without_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"T{i}", one=prose(i, 40), two=prose(100 + i, 40))) for i in range(8)]
    odd = [(20, None, None), (21, "", ""), (22, "http://x.example/", "plain < text"), (23, "no url", "<p>a<p>b<!-- open"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string")
    got = [(r.page_id, r.text) for r in main_texts(df).collect()]
    want = [(i, f"T{i}\n{prose(i, 40)} & bold word\n{prose(100 + i, 40)}") for i in range(8)]
    want += [(20, ""), (21, ""), (22, "plain < text"), (23, "a\nb"), want[0]]
    assert sorted(got, key=str) == sorted(want, key=str)
    host = df.limit(0).select("url", "html", F.lit("h").alias("host"))
    found = tokens(host)
    assert templates(found, equivalence_classes(found)).count() == 0 and main_texts(df.limit(0)).count() == 0


def pages_of(spark, htmls, host="h"):
    df = spark.createDataFrame([(i, f"http://{host}.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in sorted(main_texts(df).collect(), key=lambda r: r.page_id)]


@pytest.mark.parametrize("most_bytes", [0, 32 << 20])
def test_title_and_lead_stay_beside_the_body(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(H, "BROADCAST_BYTES", most_bytes)
    frame = "<body><nav>menu</nav><div class=page><h1>{0}</h1><p class=lead>{1}</p><div class=body><p>{2}</p></div></div><div class=legal>All texts are ours</div></body>"
    parts = [(f"Title {i}", f"lead {i}", prose(i, 60 if i else 1)) for i in range(11)]
    want = ["\n".join(p) for p in parts]
    assert pages_of(spark, [frame.format(*p) for p in parts]) == want
    # without articles the template decides: the tag rule alone would take the notice, too
    assert main_text(frame.format(*parts[3])) == want[3] + "\nAll texts are ours"


def test_all_articles_of_a_page_stay(spark):
    frame = "<body><div class=x><article class=big><p>{0}</p></article><article class=small><p>{1}</p></article><p>by {2}</p></div></body>"
    parts = [(prose(i, 30), prose(50 + i, 9), f"author {i}") for i in range(6)]
    assert pages_of(spark, [frame.format(*p) for p in parts]) == ["\n".join(p[:2]) for p in parts]


def test_articles_must_be_part_of_the_template(spark):
    plain = "<body><nav>m</nav><div class=text><p>{0}</p></div></body>"
    teaser = "<body><nav>m</nav><div class=text><p>{0}</p></div><div class=more><article><p>teaser {1}</p></article></div></body>"
    htmls = [(teaser if i == 4 else plain).format(prose(i, 20), i) for i in range(8)]
    want = [prose(i, 20) + ("\nteaser 4" if i == 4 else "") for i in range(8)]
    assert pages_of(spark, htmls) == want
    assert main_text(htmls[4]) == "teaser 4"


@pytest.mark.parametrize("name", ["side-by-side", "menu-item-review", "comment-on-law", "related-work", "banner-blindness"])
def test_a_word_of_a_class_name_removes_nothing_from_an_article(spark, name):
    frame = "<body><article><p>{0}</p><div class='" + name + "'><p>{1}</p></div></article></body>"
    parts = [(prose(i, 12), prose(70 + i, 12)) for i in range(5)]
    assert pages_of(spark, [frame.format(*p) for p in parts]) == ["\n".join(p) for p in parts]
    bare = "<body><div class=t><p>{0}</p>{1}</div></body>"
    texts = [bare.format(p[0], f"<div class='{name}'>{p[1]}</div>" if i == 2 else "") for i, p in enumerate(parts)]
    assert pages_of(spark, texts) == [p[0] + (f"\n{p[1]}" if i == 2 else "") for i, p in enumerate(parts)]


def test_doubtful_names_go_if_the_template_has_them(spark):
    frame = "<body><div class=menu-of-today>{0}</div><div class=t><h1>{1}</h1><p>{2}</p></div></body>"
    parts = [(prose(i, 5), f"T{i}", prose(30 + i, 20)) for i in range(6)]
    assert pages_of(spark, [frame.format(*p) for p in parts]) == ["\n".join(p[1:]) for p in parts]


@pytest.mark.parametrize("name", ["ad", "site-footer", "comment-list", "cookieBanner", "related-posts", "share-buttons"])
def test_names_that_say_so_in_all_words(name):
    assert main_text(f"<body><article><p>a</p><div class='x {name}'>no</div><p id='{name}'>no</p></article></body>") == "a"


def test_a_class_in_no_order_is_not_valid(spark):
    rows = [("h", f"u{i}", f"<body>{'<em></em>'}{'<div class=a></div><div class=b></div>' if i % 2 else '<div class=b></div><div class=a></div>'}</body>") for i in range(6)]
    found = equivalence_classes(tokens(spark.createDataFrame(rows, "host string, url string, html string")))
    assert found.where("path like '%div%'").count() == 0
    same = [("h", f"u{i}", "<body><div class=a></div><div class=b></div></body>") for i in range(6)]
    found = equivalence_classes(tokens(spark.createDataFrame([(h, f"{u}x", t) for h, u, t in same], "host string, url string, html string")))
    assert {r.path for r in found.collect()} == {"body", "body/div.a", "body/div.b"}


def test_classes_share_occurrence_vectors(spark):
    rows = [("h", f"u{i}", f"<body><nav>{'<i></i><a>x</a>' * 2}</nav><ul>{'<li>q</li>' * (i + 1)}</ul></body>") for i in range(4)]
    found = equivalence_classes(tokens(spark.createDataFrame(rows, "host string, url string, html string"))).collect()
    vector = {r.path: r.vector for r in found if r.text is None}
    assert vector["body"] == vector["body/nav"] == vector["body/ul"] != vector["body/ul/li"]


def test_page_edge_cases():
    assert main_text("") == "" and main_text("<article></article>") == ""
    assert main_text("<article>a<br>b&nbsp; c<div>d</div>e</article>x") == "a b c\nd\ne"
    assert main_text("<main><aside>s</aside><p>t<ul><li>1<li>2</ul></main>") == "t\n1\n2"
    deep = "<div>" * 3000 + "x" + "</div>" * 10
    assert Page(deep).blocks[0][0] == "x"


# ---- leaks


def plain_distance(item, text):
    """The smallest number of word edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (t != w)))
        row = new
    return min(row)


def words_of(text):
    return re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", (text or "").lower())


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, prose(900 + i, 8 + 3 * i)) for i in range(10)] + [(90, None), (91, ""), (92, "too short"), (None, prose(950, 20)), (0, prose(900, 8))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark, items, odd, none, clashing):
    rng = random.Random(4)
    bench = [tuple(r) for r in items.collect()]
    rows = []
    for k in range(120):
        words = rng.choice(bench[:10])[1].split()
        for _ in range(rng.randint(0, len(words) // 3)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["other"], [words[at], "more"]])
        body = prose(k, rng.choice([0, 40])).split()
        cut = rng.randint(0, len(body))
        sign = rng.choice([" ", "!! ", "\n"])
        rows.append((k, " ".join(body[:cut]) + " " + sign.join(words).upper() + " " + " ".join(body[cut:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    for d, text in rows:
        for i, item in bench:
            n = len(words_of(item))
            distance = plain_distance(words_of(item), words_of(text)) if n >= 5 else n
            if n >= 5 and distance <= int(0.2 * n + 1e-9):
                want[(d, i)] = distance
    found = D.leaks(df, items).collect()
    got = {}
    for r in found:
        got[(r.doc_id, r.item_id)] = min(r.distance, got.get((r.doc_id, r.item_id), 99))
        assert abs(r.n_words - r.item_words) <= r.distance and r.first_word >= 0
    assert got == want and len(want) > 40
    clean = D.drop_leaks(df, items)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, _ in rows} - {d for d, _ in want})
    assert D.leaks(none, items).count() == 0 and D.leaks(df, items.limit(0)).count() == 0
    assert D.drop_leaks(df, items.limit(0)).count() == len(rows)
    assert D.drop_leaks(clashing, items).columns == clashing.columns and D.drop_leaks(odd, items).count() == odd.count()


def test_blocks_of_items(spark, items, monkeypatch):
    df = spark.createDataFrame([(1, prose(950, 20)), (2, prose(905, 23))], "doc_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)
    assert sorted((r.doc_id, r.item_id) for r in D.leaks(df, items).collect()) == [(1, None), (2, 5)]


def test_embedding_keeps_near_near():
    rng = np.random.default_rng(1)
    item = rng.integers(1, 2**63, 30).astype(np.uint64)
    near = np.delete(item, 7)
    near = np.append(near, np.uint64(5))
    far = rng.integers(1, 2**63, 30).astype(np.uint64)
    both = np.stack([item, near, far])
    same = [np.mean([(e[0] == e[k]).mean() for e in (D.embed(both, w, 60)[0] for w in range(8))]) for k in (1, 2)]
    assert same[0] > 0.5 > same[1]


def test_a_window_of_any_length_has_the_buckets_of_an_item_of_that_length():
    line = np.random.default_rng(3).integers(1, 2**63, size=(5, 60)).astype(np.uint64)
    walks = [D.embed(line, w, 120) for w in range(D.WALKS)]
    for n in (5, 17, 59):
        sampled = D.places(n, 64)
        assert (D.buckets(line, n, sampled, walks) == D.buckets(line[:, :n].copy(), n, sampled)).all()


@pytest.mark.parametrize("n_words", [6, 15, 30, 60])
def test_recall_of_buckets_at_the_most_edits(n_words):
    rng = np.random.default_rng(n_words)
    edits = n_words // 5
    bench = [(i, prose(10_000 + 100 * n_words + i, n_words)) for i in range(250)]
    search = D.Benchmark(bench, 0.2, 5, 0.99)
    found = planted = 0
    for turn in range(4):
        for i, text in bench:
            words = text.split()
            for _ in range(edits):
                at, kind = int(rng.integers(len(words))), int(rng.integers(3))
                words[at : at + 1] = [[], ["other"], [words[at], f"more{turn}"]][kind]
            body = f"{prose(i, 20)} {' '.join(words)} {prose(900 + i, 20)}"
            if plain_distance(text.split(), body.split()) <= edits:
                planted += 1
                found += any(search.items[leak[1]].ident == i for leak in search.leaks([D.plain(body)]))
    assert planted > 950 and found >= 0.99 * planted


def test_repetitions_follow_from_share_and_recall():
    assert D.repetitions(30, 0.03) == D.WALKS
    assert D.repetitions(30, 0.1) < D.repetitions(30, 0.2) < D.repetitions(30, 0.3)
    assert D.repetitions(30, 0.2, 0.9) < D.repetitions(30, 0.2, 0.99)
