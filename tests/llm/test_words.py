"""BPE by tree concatenation, hard negatives by slots, collocations by rollup."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from waymark.llm import bpe, collocations, hard_negatives
from waymark.llm.queries import QUERIES

BPE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "ing", "'s", "'re", "'", "''", "1", "23", "٣", " ", "  ", "\n", "\t", ".", "...", "!", "é", "ö", "日本", "語", "😀", "́", "<|endoftext|>", "endoftext", "<|", "|>",
         "xyz", "\x85", "\x1c", "\x01", "²", "ʰ", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def mixed_text(rng):
    some = rng.sample(PARTS, rng.choice([1, 2, 3, 6, len(PARTS)]))
    return "".join(rng.choice(some) * rng.choice([1, 1, 2, 6]) for _ in range(rng.choice([1, 12, 60, 150])))


# -- BPE -------------------------------------------------------------------------------------

def test_halves_joined_give_the_ids_of_the_whole(library):
    rng, tokens = random.Random(2), bpe.Encoder(BPE)
    joins = 0
    for _ in range(400):
        text = mixed_text(rng)
        want = library.encode(text, add_special_tokens=False).ids
        assert [x.tolist() for x in tokens.encode([text, "", text])] == [want, [], want]
        places = [0, *tokens.cut(text, rng.choice([12, 30])), len(text)]
        parts = [text[a:b] for a, b in zip(places, places[1:])]
        joins += len(parts) - 1
        assert tokens.concatenated(parts, tokens.encode(parts)).tolist() == want
        broken = want[1:-1]
        assert tokens.decode(np.array(broken, int)) == library.decode(broken, skip_special_tokens=False)
    assert joins > 500


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2500 + "c", "!" * 4000, "日本" * 1500, " " * 3000 + "x", "1234567" * 500, "x" * 600 + "'" * 600 + "s" * 600])
def test_unsplit_runs(library, text):
    tokens = bpe.Encoder(BPE)
    places = [0, *tokens.cut(text, 100), len(text)]
    parts = [text[a:b] for a, b in zip(places, places[1:])]
    assert len(parts) > 15 and max(map(len, parts)) <= 100
    assert tokens.concatenated(parts, tokens.encode(parts)).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_are_forgotten_without_a_trace(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    tokens = bpe.Encoder(BPE)
    texts = ["one two three four", "five six " + "long" * 40 + " seven", "one two\nEight it's,", "Größe éa1b", ""]
    for _ in range(2):
        assert [x.tolist() for x in tokens.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_odd_tables(spark, library):
    rng = random.Random(3)
    texts = [None, "", "same", "same", "w" * 700, " ".join(mixed_text(rng) for _ in range(20)), *(mixed_text(rng) for _ in range(20))]
    rows = [(None if n % 5 == 0 else n // 2, t, 1.0, "x") for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids double, key string").repartition(3)
    got = bpe.encode(df, BPE, leaf=64, decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == want
    assert bpe.encode(df.limit(0), BPE).count() == 0
    tokens = spark.createDataFrame([(1, [464, None, 99999, -3, 50256], "t"), (2, None, None), (3, [], None)], "n int, ids array<int>, Text string")
    assert [tuple(r) for r in bpe.decode(tokens, BPE).orderBy("n").select("n", "_text").collect()] == [(1, "The<|endoftext|>"), (2, None), (3, "")]


def test_encode_whole_with_another_tokenizer(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello  World", "x" * 300, "", "a b " * 100]
    got = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path, leaf=50)
    want = Tokenizer.from_file(path)
    assert {r.doc_id: list(r.ids) for r in got.collect()} == {n: want.encode(t, add_special_tokens=False).ids for n, t in enumerate(texts)}


def test_bpe_query(spark, sf, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


# -- hard negatives --------------------------------------------------------------------------

def brute_negatives(rows, scale=256, low=50, high=95):
    """Sorted result rows from (id, vector, label) rows."""
    good = [(i, [int(np.floor(x * scale)) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (anchor, a, label) in enumerate(good):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a, v)), i, y == label) for m, (i, v, y) in enumerate(good) if m != n and len(v) == len(a)]
        for p, positive, _ in sorted((s for s in scored if s[2]), key=place)[:5]:
            fits = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= high * p), key=place)[:3]
            out += [(anchor, positive, k, i, p, s) for k, (s, i, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()), key=str)


@pytest.mark.parametrize("spread_out", [False, True])
def test_negatives_against_brute_force(spark, monkeypatch, spread_out):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 6))
    rows = [(n, np.round(centres[n % 4] + rng.normal(size=6) * 0.8, 1).tolist(), int(rng.integers(0, 4))) for n in range(420)]
    rows += [(50, [1.0] * 6, 1), (50, [1.0] * 6, 1), (None, [1.0] * 6, 2), (None, [0.9] * 6, None), (100, None, 1), (150, [None] + [1.0] * 5, 1), (200, [float("nan")] * 6, 1), (250, [float("inf")] * 6, 1),
             (300, [0.0] * 6, 3), (350, [-1.0] * 6, 0), (400, [2.0, 1.0], 1), (401, [2.0, 1.0], 1), (402, [1.0, 0.5], 2), (450, [], 1)]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<double>, label int, key string, id double").repartition(5)
    if spread_out:  # as if there were too many anchors for a broadcast
        monkeypatch.setattr(hard_negatives, "broadcastable", lambda table: False)
        monkeypatch.setattr(hard_negatives, "CELL", 2)
    assert mined(df, block=32, anchors=4) == brute_negatives(rows)
    assert mined(df.limit(0)) == mined(df.filter("vec_id = 50").limit(1)) == []


def test_negatives_of_huge_components(spark):
    rows = [(0, [3e15, 1.0], 1), (1, [2e15, 5.0], 1), (2, [1.7e15, -1.0], 2), (3, [1.9e15, 0.3], 2), (4, [1e300, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    positive = 3e15 * 256 * 2e15 * 256
    assert positive > 2 ** 63 and all(r[4] == 2 ** 63 - 1 for r in mined(df))  # products beyond 64 bits count as the largest number
    small = [(i, [x / 1e9 for x in v], y) for i, v, y in rows[:4]]
    assert mined(spark.createDataFrame(small, "vec_id long, embedding array<double>, label int")) == brute_negatives(small)


def test_negatives_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf).collect()), key=str) == brute_negatives(rows)


# -- collocations ----------------------------------------------------------------------------

def brute_phrases(docs, least, cover, first, longest=4):
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: n for p, n in counts.items() if len(p) > 2 and n >= least}
    covered = {(p[0], *p[i:i + k]): max(n for q, n in often.items() if q[0] == p[0] and len(q) > k + 1 and p[i:i + k] in [q[j:j + k] for j in range(1, len(q) - k + 1)])
               for p, n in often.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1)}
    out = []
    for p, a in often.items():
        if 100 * covered.get(p, 0) >= cover * a and p in covered:
            continue
        score, _, l, r = min((2000000 * a // (counts[p[:1 + k]] + counts[(p[0], *p[1 + k:])]), k, counts[p[:1 + k]], counts[(p[0], *p[1 + k:])]) for k in range(1, len(p) - 1))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), l, r))
    out.sort()
    rank, got = Counter(), set()
    for lang, score, a, phrase, l, r in out:
        rank[lang] += 1
        if rank[lang] <= first:
            got.add((lang, rank[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return got


def phrases(df, **options):
    return {tuple(r) for r in collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


@pytest.mark.parametrize("bits", [16, 4])
def test_collocations_against_brute_force(spark, monkeypatch, bits):
    rng = random.Random(6)
    words = ["the", "The", "of", "new", "york", "city", "hall", "é", "ÉA", "x\x85y", "日本", "-", "a"] + [f"w{n}" for n in range(60)]
    def text():
        run = [rng.choice(["new york city hall", "New York", "of the", rng.choice(words), rng.choice(words)]) for _ in range(rng.randint(0, 40))]
        return "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b"]) for w in run)
    docs = [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(300)] + [(None, "en"), ("", None), ("...", "fr"), ("word " * 400 + "end", "la")]
    docs += docs[:20]
    df = spark.createDataFrame([(t, x, n, "y") for n, (t, x) in enumerate(docs)], "text string, lang string, n int, phrase string").repartition(4)
    monkeypatch.setattr(collocations, "LEAST_BITS", bits)  # with few counters more windows pass, the result stays
    monkeypatch.setattr(collocations, "SKETCH", bits)
    monkeypatch.setattr(collocations, "SLICE", 700)
    assert phrases(df, least=5) == brute_phrases(docs, 5, 80, 2000)
    assert phrases(df, least=3, cover=50, first=4, longest=3) == brute_phrases(docs, 3, 50, 4, 3)
    assert phrases(df.limit(0)) == phrases(df.filter("text = ''")) == set()


def test_collocations_arithmetic(spark):
    counts = [("en", 1, "a", 2 ** 62), ("en", 1, "b", 2 ** 62 + 1), ("en", 2, "a b", 2 ** 61 + 12345)]
    kept = spark.createDataFrame(counts, "lang string, words int, phrase string, f long")
    totals = spark.createDataFrame([("en", 2 ** 63 - 1)], "lang string, n long")
    original, collocations.phrase_counts = collocations.phrase_counts, lambda *_: (kept, totals)
    try:
        got = collocations.collocations(kept).collect()
    finally:
        collocations.phrase_counts = original
    assert [(r.score, r.a, r.n) for r in got] == [(2000000 * (2 ** 61 + 12345) // (2 ** 63 + 1), 2 ** 61 + 12345, 2 ** 63 - 1)]
