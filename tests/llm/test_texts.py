"""Quality, url rules, decontamination, records, page texts and the pipeline."""

from __future__ import annotations

import html
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from waymark.llm import decontamination, labelled_pages, main_text, quality, records, url_rules
from waymark.llm.queries import QUERIES, SHARDS, URL_RULES
from waymark.llm.sharding import fill

DOC = "doc_id long, text string, Score double"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def clean_text(rng, n=60):
    return " ".join(rng.choice(["river", "stone", "walk", "The", "of", "a", "light", "green", "house,", "tree."]) for _ in range(n))


# -- quality -------------------------------------------------------------------------

def test_isotonic():
    rng = np.random.default_rng(2)
    for _ in range(20):
        v, w = rng.normal(size=12), rng.uniform(0.5, 2, 12)
        fit = quality.isotonic(v, w)
        assert (np.diff(fit) >= -1e-12).all() and np.isclose((fit * w).sum(), (v * w).sum())
        for level in np.unique(fit):  # each level is the mean of its block
            assert np.isclose(np.average(v[fit == level], weights=w[fit == level]), level)
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0


def test_quality_on_held_out_labels(spark, sf):
    scored = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert len(held) > 40 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_quality_odd_tables(spark):
    rng = random.Random(1)
    rows = [(i, clean_text(rng) if i % 3 else clean_text(rng).upper().replace(" ", "!! "), None) for i in range(150)]
    rows += [(200, None, 1.0), (201, "", None), (202, "x" * 300_000, None), (None, "no id", None), (3, rows[4][1], None), (3, rows[4][1], None)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)] + [(1, 1), (None, 0), (5, None), (9999, 1)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "score"]
    result = got.collect()
    assert len(result) == len(rows) and all(0 <= r.score <= 1 for r in result)
    assert len({r.score for r in result if r.text == rows[4][1]}) == 1
    assert np.mean([r.score for r in result if r.doc_id is not None and r.doc_id < 150 and r.doc_id % 3]) > 0.9
    unlabelled = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, unlabelled).collect()} == {0.5}
    assert quality.keep_good(docs.limit(0), unlabelled).count() == 0 and quality.keep_good(docs, unlabelled).columns == docs.columns


# -- url rules --------------------------------------------------------------------------

def fixed(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(brute.ASCII_LOWER)
    fits = [r for r in URL_RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_url_contract(spark, sf):
    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    odd = [None, "", "no scheme", "http://", "http://A.COM", "http://a.COM/", "HTTPS://Example.com/en/x?y#z", "http://www.example.com/en/", "http://x.www.example.com/en/q", "http://example.com/en",
           "http://net/es/1", "http://a.net/es?x", "http://notcom/", "a://b://c.com/d", "http://é.com/É?", "http://x.com?u=/en/", "http://x.net/fr/#a\nb", "http://İ.org/en/1"]
    from waymark.llm.queries import ruled
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + odd)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in ruled(df).collect()}
    assert got == {i: fixed(u) for i, u in enumerate(urls + odd)}
    rows = QUERIES["op2_url_rules"](spark, sf).collect()
    assert len(rows) == len(urls) and all(r.verdict == URL_RULES[r.rule] for r in rows if r.rule) and {r.verdict for r in rows} == {"allow", "block"}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(4)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'b', 'www'])}.{rng.choice(['x', 'y'])}.{rng.choice(['org', 'net'])}/{rng.choice(['en', 'de'])}/{rng.randrange(99)}" for _ in range(300)]
    label = lambda u: "block" if ".net/de" in u or "b.x." in u else "allow"
    df = spark.createDataFrame([(u, label(u), "v") for u in urls] + [(None, "allow", "v"), ("http://q.org/", None, "v")], "url string, label string, Verdict string")
    rules = url_rules.mine(df, support=0.02, confidence=0.9, lift=1.1)
    mined = rules.collect()
    sets = {r.url: set(r.t) for r in df.filter("url IS NOT NULL").select("url", url_rules.tokens(F.col("url")).alias("t")).collect()}
    known = [u for u in urls]
    for r in mined:
        held = [u for u in known if set(r.tokens) <= sets[u]]
        assert sum(label(u) == r.label for u in held) / len(held) == pytest.approx(r.confidence) and r.confidence >= 0.9
        assert r.rarest == min(r.tokens, key=lambda t: (sum(t in sets[u] for u in known), t))
    judged = url_rules.judge(df, rules)
    assert judged.columns == ["url", "label", "verdict", "mined_rule"]
    for r in judged.collect():
        fits = [m for m in mined if r.url and set(m.tokens) <= sets[r.url]]
        best = max(fits, key=lambda m: (m.confidence, m.support, len(m.tokens), " ".join(m.tokens), m.label)) if fits else None
        assert (r.verdict, r.mined_rule) == ((best.label, " ".join(best.tokens)) if best else ("allow", None))
    assert sum(r.verdict == r.label for r in judged.filter("label IS NOT NULL").collect()) > 0.95 * len(urls)
    none = url_rules.mine(df.limit(0))
    assert none.count() == 0 and {r.verdict for r in url_rules.judge(df, none).collect()} == {"allow"} and url_rules.judge(df.limit(0), rules).count() == 0


# -- records ----------------------------------------------------------------------------

def test_records_round_trip(spark, sf):
    tokenizer = Tokenizer.from_file(BPE)
    rng = random.Random(6)
    texts = [None, "", " ", "  two  blanks ", "a\n b\n\n c \t d", "<|endoftext|> in <|endoftext|>the text", "naïve café\u00a0x \u2003 y", "don't it's 12 3.4!!", "日本 語 テキスト 😀 x", "x " * 20_000,
             "".join(rng.choice("ab \n\t.'Ġ é") for _ in range(3000))]
    rows = [(i - 3, t, 0.0) for i, t in enumerate(texts)] + [(None, "null id", 0.0), (2, "again", 0.0)]
    index = records.write(spark.createDataFrame(rows, DOC).repartition(5), BPE)
    back = {(r.doc_id, r.start): list(r.ids) for r in records.read(index.orderBy(F.rand(1))).collect()}
    ids = {(i, t): tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    assert Counter((i, tuple(x)) for (i, _), x in back.items()) == Counter((i, tuple(x)) for (i, _), x in ids.items())
    order = [i for i, _ in sorted(back, key=lambda k: k[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    place = 0
    for key in sorted(back, key=lambda k: k[1]):
        assert key[1] == place
        place += len(back[key])
    assert records.write(spark.createDataFrame([], DOC), BPE).count() == 0


def test_records_query_and_damage(spark, sf):
    tokenizer, place = Tokenizer.from_file(BPE), 0
    got = {r.doc_id: r for r in QUERIES["op4_token_records"](spark, sf).collect()}
    for d in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = tokenizer.encode(d.text, add_special_tokens=False).ids + [2]
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (place, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        place += len(ids)
    framed = records.frame(b"payload")
    assert records.unframe(framed) == b"payload" and struct.unpack("<Q", framed[:8]) == (7,)
    for at in range(len(framed)):
        with pytest.raises(ValueError):
            records.unframe(framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1:])


# -- pages -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def field():
    return main_text.train(labelled_pages.labelled_pages())


def test_blocks_of_broken_markup():
    texts = lambda page: [b.text for b in main_text.blocks(page)]
    assert texts(None) == texts("") == texts("<p>") == texts("<!-- x") == []
    assert texts("<p>a &amp; b&nbsp;c<br>d<p><b>e<p>f</b></div>g<script>var t='</p>';</script> h") == ["a & b c d", "e", "fg h"]
    assert texts("a<!-- <p>x</p> -->b<textarea>no</textarea><a title='x>y'>c</a><di") == ["ab c"]
    assert texts("1 < 2<ul><li>x<li>y</ul><table><tr><td>p<td>q</table>&#233;&copy") == ["1 < 2", "x", "y", "p", "q", "é©"]


def test_unclosed_elements_lose_no_text(field):
    article = "<article><h1>Title of it.</h1><p>First sentence here. Second one.</p></article>"
    want = "Title of it.\nFirst sentence here. Second one."
    for before in ("<button>", "<svg>", "<select>", "<object>", "<canvas>", "<math>", "<button>Menu<button>More</button>", "<svg><path d='M0'><g>"):
        assert main_text.extract(f"<body><nav><a href='/'>home</a></nav>{before}{article}</body>", field) == want
    formula = "<article><p>It holds that <math><mi>a</mi><mo>=</mo><mn>1</mn></math> for all. Then more <svg><text>text</text></svg> comes.</p></article>"
    assert main_text.extract(formula, field) == "It holds that a=1 for all. Then more text comes."


def test_parts_of_a_line(field):
    line = "The house stood by the river. {}It was old and green. Nobody came."
    for part in ('<span class="ad">Buy now, cheap offers here.</span> ', '<a class="promo" href="/x">Our best deals of the week</a> ', "<button>Send</button> ", '<small class="notice">We use cookies.</small> '):
        assert main_text.extract(f"<article><p>{line.format(part)}</p><p>One more line here.</p></article>", field) == line.format("") + "\nOne more line here."
    kept = line.format('<span class="highlight">A <b>bold</b> word</span> ')
    assert main_text.extract(f"<article><p>{kept}</p></article>", field) == re.sub("<.*?>", "", kept)
    assert main_text.extract('<article><p>One line here.<span class="ad">Buy <span>very</span> cheap things</span></p><p>Two lines now.</p></article>', field) == "One line here.\nTwo lines now."


def test_viterbi_is_the_best_labelling(field):
    page = main_text.blocks(labelled_pages.Writer(5).page())[:9]
    score = field.scores(page)
    worth = lambda labels: field.start[labels[0]] + sum(score[i, x] for i, x in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
    best = max(range(2 ** len(page)), key=lambda n: worth([n >> i & 1 for i in range(len(page))]))
    assert [int(x) for x in field.decode(page)] == [best >> i & 1 for i in range(len(page))]


def test_pages_held_out_and_given(spark, sf, field):
    right = total = 0
    for page in labelled_pages.labelled_pages(60, 77):
        found = main_text.blocks(page)
        right += sum(b.gold == x for b, x in zip(found, field.decode(found)))
        total += len(found)
    assert right >= 0.98 * total
    got = {r.page_id: r for r in QUERIES["op9_main_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?p>|</?h1>", inside)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_odd_tables(spark, field):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "<nav><a>x</a></nav>", "t"), (3, "<article><p>" + "word here. " * 50_000 + "</p></article>", "t")], "page_id long, html string, Text string")
    got = main_text.extracted(df, field)
    assert got.columns == ["page_id", "html", "text"] and [len(r.text) for r in got.orderBy("page_id", "html").collect()] == [0, 0, 0, 549_999]
    assert main_text.extracted(df.limit(0), field).count() == 0


# -- decontamination -----------------------------------------------------------------------

def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(50):
        a, b = rng.choices("abcd", k=rng.randint(0, 12)), rng.choices("abcd", k=rng.randint(0, 12))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_leaks_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontamination"](spark, sf).collect()}
    items = {r.item_id: decontamination.word_numbers(r.text).tolist() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = decontamination.word_numbers(d.text).tolist()
        for i, item in items.items():
            if len(set(words) & set(item)) >= 0.5 * len(set(item)) and max(decontamination.common_subsequence(item, words[s:s + len(item)]) for s in range(max(1, len(words) - len(item) + 1))) >= 0.8 * len(item):
                want.add((d.doc_id, i))
    assert len(want) >= 20 and want <= got and len(got) <= len(want) + 2


def test_leaks_paraphrases_answers_and_odd_tables(spark):
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [prose(40) for _ in range(12)]
    half = lambda t, keep: [w if rng.random() < keep else rng.choice(vocabulary) for w in t]
    docs = [(i, " ".join(prose(150)), 0.0) for i in range(300)]
    docs += [(1000 + i, " ".join([*prose(70), *(w.upper() + "," for w in t), *prose(50)]), 0.0) for i, t in enumerate(items)]
    docs += [(2000 + i, " ".join([*prose(33), *half(t, 0.85), *prose(90)]), 0.0) for i, t in enumerate(items)]
    docs += [(3000 + i, " ".join([*prose(20), *half(t[:-2], 0.58), *t[-2:], *prose(20)]), 0.0) for i, t in enumerate(items)]
    docs += [(1000, None, 0.0), (4000, "", 0.0), (4001, "v1", 0.0), (None, " ".join(items[3]), 0.0), (1001, " ".join(items[1]), 0.0)]
    bench = [(i, " ".join(t), " ".join(t[-2:]) if i < 6 else None) for i, t in enumerate(items)] + [(50, None, None), (51, "v1", None), (None, "v1 " * 20, None)]
    df = spark.createDataFrame(docs, DOC)
    asked = spark.createDataFrame(bench, "item_id int, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, asked, answer="answer").collect()}
    assert {(1000 + i, i) for i in range(12)} | {(None, 3)} <= got and sum((2000 + i, i) in got for i in range(12)) >= 11
    with_answer, without = (sum((3000 + i, i) in got for i in r) for r in (range(6), range(6, 12)))
    assert with_answer >= 3 and without <= with_answer and not [g for g in got if g[0] is not None and (g[0] < 1000 or g[0] >= 4000)]
    kept = decontamination.clean(df, asked)
    assert kept.columns == df.columns and set(range(300)) <= {r.doc_id for r in kept.collect()} and not {r.doc_id for r in kept.collect()} & set(range(1000, 1012))
    assert decontamination.leaks(df.limit(0), asked).count() == 0 and decontamination.leaks(df, asked.limit(0)).count() == 0


def test_stretches_hold_every_window_of_a_text():
    for n in range(5, 70):
        for size in (3, n, n + 1, 100, 163):
            length, _ = decontamination._stretch(n)
            starts = decontamination._starts(size, n, 0, size)
            for s in range(max(1, size - n + 1)):
                assert any(b <= s and min(s + n, size) <= min(b + length, size) for b in starts)


def placed_items(rng, lengths, vocabulary=4000):
    """Items of the given lengths, and documents that hold them with a share of about 0.65 to 1 at the start, within or at the end."""
    weights = [1 / (i + 10) for i in range(vocabulary)]
    prose = lambda n: rng.choices(range(vocabulary), weights, k=n)
    items = [prose(n) for n in lengths]
    docs = [prose(rng.randint(1, 300)) for _ in range(150)]
    for i, item in enumerate(items):
        for keep in (0.65, 0.72, 0.8, 1.0):
            kept = set(rng.sample(range(len(item)), math.ceil(keep * len(item))))
            copy = [w if k in kept else rng.randrange(vocabulary) for k, w in enumerate(item)]
            before, after = rng.choice([(0, 90), (70, 0), (rng.randint(1, 99), rng.randint(1, 99))])
            docs.append([*prose(before), *copy, *prose(after)])
    return [" ".join(f"v{w}" for w in t) for t in items], [" ".join(f"v{w}" for w in t) for t in docs]


def leaks_by_brute_force(items, docs, same=0.65):
    """Pairs of which the document has a window of the item's length that holds the share `same` of it, in order."""
    words, want = [t.split() for t in docs], set()
    for i, item in enumerate(t.split() for t in items):
        held, n = set(item), len(item)
        for d, t in enumerate(words):
            own = np.cumsum([0, *(w in held for w in t)])
            for s in range(max(1, len(t) - n + 1)):
                if own[min(s + n, len(t))] - own[s] >= same * n and decontamination.common_subsequence(item, t[s:s + n]) >= same * n:
                    want.add((d, i))
                    break
    return want


def test_short_and_partly_kept_items_against_brute_force(spark):
    items, docs = placed_items(random.Random(21), [5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 50, 60] * 2)
    want = leaks_by_brute_force(items, docs)
    asked = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.share for r in decontamination.leaks(spark.createDataFrame([(d, t) for d, t in enumerate(docs)], "doc_id int, text string"), asked).collect()}
    assert len(want) >= 4 * len(items) and want <= set(got)
    # A stretch is longer than the item, so there are pairs beyond brute force; each of them holds its share.
    for (d, i), share in got.items():
        assert share >= 0.65 and decontamination.common_subsequence(items[i].split(), docs[d].split()) >= 0.65 * len(items[i].split())


@pytest.mark.parametrize("fit_docs, least", [(12_000, 0.99), (30, 0.95)])
def test_recall_of_the_latent_search_alone(spark, fit_docs, least):
    items, docs = placed_items(random.Random(21), [5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 24, 28, 32, 40, 50, 60] * 2)
    want = leaks_by_brute_force(items, docs)
    asked = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(table, asked, fit_docs=fit_docs, exact=False).collect()}
    assert len(want & got) >= least * len(want)


def test_leaks_with_directions_of_a_sample(spark):
    items, docs = placed_items(random.Random(22), [5, 6, 8, 10, 16, 19, 25, 33, 47, 60])
    want = leaks_by_brute_force(items, docs)
    asked = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    whole, sampled = ({tuple(r) for r in decontamination.leaks(table, asked, fit_docs=n).collect()} for n in (len(docs), 5))
    assert whole == sampled and want <= {r[:2] for r in sampled}


def test_directions_are_fitted_on_all_documents(spark):
    base = [" ".join(f"b{n}x{k}" for k in range(20)) for n in range(20)]
    single = [f"only{n} some{n} word{n} of{n} its{n} own{n}" for n in range(30)]
    rows = [(i, base[i % 20]) for i in range(14_000)] + [(20_000 + i, t) for i, t in enumerate(single)]
    numbered = [(i, decontamination.word_numbers(t).tobytes()) for i, t in rows]
    latent = decontamination.fit(spark.createDataFrame(numbered, "doc_id int, words binary").repartition(4))
    place = latent.coordinates(decontamination.passages([decontamination.word_numbers(t) for t in base + single]))
    assert (np.abs(np.linalg.norm(place, axis=1) - 1) < 1e-3).all() and (np.abs(place @ place.T - np.eye(50)) < 0.5).all()


def test_clean_judges_each_row(spark):
    rng = random.Random(23)
    prose = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    items = [prose(30), prose(7)]
    held = [f"{prose(40)} {t} {prose(20)}" for t in items]
    clear = [prose(80) for _ in range(4)]
    rows = [(None, held[0], 0.0), (None, clear[0], 1.0), (None, None, 2.0), (7, held[1], 3.0), (7, clear[1], 4.0), (7, clear[1], 5.0), (8, held[0], 6.0), (8, None, 7.0), (9, clear[2], 8.0)]
    asked = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    kept = decontamination.clean(spark.createDataFrame(rows, DOC), asked)
    assert kept.columns == ["doc_id", "text", "Score"] and sorted(r.Score for r in kept.collect()) == [1.0, 2.0, 4.0, 5.0, 8.0]


# -- pipeline --------------------------------------------------------------------------------

def test_pipeline_fits_directions_on_all_documents(spark, sf, monkeypatch):
    fitted, fit = [], decontamination.fit
    monkeypatch.setattr(decontamination, "fit", lambda words, **options: fitted.append((words.count(), options.get("fit_docs"))) or fit(words, **options))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, sf)
    assert fitted == [(docs.count(), None)]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontamination", "mixing", "sharding"]
    good = stages["quality"](spark, docs, sf).cache()
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_quality"](spark, sf).collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == {i for i, p in scores.items() if p}
    single = stages["near_copies"](spark, good, sf).cache()
    groups = brute.similar([(r.doc_id, r.text) for r in good.collect()], 80, 5)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    clean = stages["decontamination"](spark, single, sf).cache()
    leaked = {r.doc_id for r in QUERIES["op3_decontamination"](spark, sf).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    mixed = stages["mixing"](spark, clean, sf).cache()
    assert mixed.columns == columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    placed = stages["sharding"](spark, mixed, sf)
    table = fill(SHARDS)
    import hashlib
    assert all(r.shard == table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % len(table)] for r in placed.collect())
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == [*columns, "shard"] and Counter(r.doc_id for r in whole.collect()) == Counter(r.doc_id for r in mixed.collect())
