"""Set join, byte repeats and vector join against brute force, with the awkward cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tests.llm import brute
from waymark.llm import near_vectors, repeats, similar_sets
from waymark.llm import components as components_module
from waymark.llm.components import components
from waymark.llm.queries import QUERIES

DOC = "doc_id long, text string, note string"


def variants(seed, groups, copies, words=80, edits=(0, 1, 2, 3, 5, 8)):
    """Texts in groups of near copies, some of them chains that only link step by step."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(words // 4, words))
        for c in range(copies):
            text = list(base if c % 2 else out[-1].split() if c else base)
            for _ in range(rng.choice(edits)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            out.append(" ".join(text))
    return out


def odd_texts():
    return [None, "", " \t\n", "one", "one", "One", "one two three", "one two three four", "one two three four", "a b c d e f g h " * 3, "é è x y z w v", "x " * 5000]


@pytest.mark.parametrize("in_task", [1_000_000, 5])
def test_components(spark, monkeypatch, in_task):
    monkeypatch.setattr(components_module, "TASK_EDGES", in_task)
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 1), (500, 501), (501, 500), (500, 501)]
    groups = brute.Union(range(600))
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {n: groups.root(n) for n in range(600) if groups.root(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5)])
def test_similar_sets(spark, monkeypatch, percent, width):
    texts = odd_texts() + variants(percent, 30, 12) + variants(5, 1, 60, 60, (3, 4, 5)) + ["same words here again and again once more"] * 25
    rows = [(3 * i + 1, t, "x") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(similar_sets, "BLOCK", 16)
    monkeypatch.setattr(similar_sets, "TRIES", 2)
    df = spark.createDataFrame(rows, DOC).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_sets.linked_groups(df, percent / 100, width).collect()}
    want = brute.similar([r[:2] for r in rows], percent, width)
    assert got == want and len({c for _, c in want.values()}) < len(want) - 50


def test_similar_sets_odd_tables(spark):
    empty = spark.createDataFrame([], DOC)
    assert similar_sets.linked_groups(empty).count() == 0 and similar_sets.first_of_each(empty).columns == ["doc_id", "text", "note"]
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(5, long, None), (5, "other words of five", None), (9, "other words of five", None), (None, long, None), (None, None, None), (2, long, None), (2, long, None)]
    got = sorted(similar_sets.linked_groups(spark.createDataFrame(rows, DOC)).collect(), key=str)
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 2), (9, 2), (2, 2), (None, None)} and len(got) == 7
    kept = similar_sets.first_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [2, 2, None, None]


@pytest.mark.parametrize("length", [50, 12])
def test_repeats(spark, monkeypatch, length):
    rng = random.Random(length)
    passage = " ".join(rng.choices([f"word{i}" for i in range(50)], k=60))
    texts = odd_texts() + variants(2, 12, 5) + [f"{rng.random()} {passage[:rng.randint(0, 200)]} {rng.random()} {passage[rng.randint(0, 200):]}" for _ in range(30)]
    texts += ["ab" * 100, "b" + "ab" * 100, "ü" * 60, "xü" * 60, passage, passage]
    rows = [(i // 2 if i > 60 else i, t, None) for i, t in enumerate(texts)] + [(None, passage, None)]
    monkeypatch.setattr(repeats, "BATCH", 1500)
    got = [tuple(r) for r in repeats.without_repeats(spark.createDataFrame(rows, DOC).repartition(6), length).collect()]
    want = brute.without_repeats([r[:2] for r in rows[:-1]], length) + [(None, len(passage.encode()), 0, 0, passage.encode())]
    assert sorted((str(a), b, c, d, bytes(e)) for a, b, c, d, e in got) == sorted((str(a), b, c, d, e) for a, b, c, d, e in want)
    assert sum(w[2] for w in want) > 1000 and repeats.without_repeats(spark.createDataFrame([], DOC)).count() == 0


def test_repeats_copies_and_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = variants(4, 8, 6) + ["short", "", "y" * 49, "z" * 50]
    rows = [(rng.randrange(-50, 400), t, None) for t in texts * 9] + [(7, texts[0], None), (7, texts[0], None), ((1 << 63) - 1, texts[1], None), (-(1 << 63), texts[1], None)]
    rng.shuffle(rows)
    monkeypatch.setattr(repeats, "HELD", 4000)
    got = sorted((a, b, c, d, bytes(e)) for a, b, c, d, e in repeats.without_repeats(spark.createDataFrame(rows, DOC).repartition(7)).collect())
    assert got == sorted(brute.without_repeats([r[:2] for r in rows], 50))


def test_repeats_shuffle_little():
    """What one chunk sends for a text that repeats and its copies, against the bytes of the texts."""
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(3000)) for _ in range(10)]
    docs = pd.DataFrame({"doc_id": range(1000, 1080), "text": texts * 8})
    size = lambda rows: sum(len(x) for c in rows.columns for x in rows[c] if isinstance(x, bytes))
    dealt = pd.concat(repeats._dealt(1)(iter([docs])))
    assert size(dealt) < 0.6 * sum(map(len, texts)) and len(dealt) == 1
    held, ids, least = repeats._documents(dealt)
    assert sorted(held) == sorted(t.encode() for t in texts) and sorted(np.concatenate(ids)) == list(range(1000, 1080)) and least.tolist() == list(range(1000, 1010))
    hashes = repeats._sent_hashes(1, 50)(dealt)
    n = len(repeats._chunk_anchors(held, 50).value)
    assert size(hashes) < 3.5 * n
    everything = pd.DataFrame({"bucket": [0], "shared": [np.packbits(np.ones(n, bool)).tobytes()]})
    sent = repeats._sent_texts(1, 50)(dealt, everything)
    assert size(sent) < 48 * n  # a place, an id, a text's number, two sizes and some 62 bytes
    assert len(repeats._removed(50)(sent)) == 0


def test_previous_factors():
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 40))).encode() for _ in range(30)]
    rank = np.array([rng.randrange(10) for _ in texts])
    for length in (5, 8, 13, 16):
        got = set(zip(*(x.tolist() for x in repeats.previous_factors(texts, rank, length))))
        want = {(i, at) for i, t in enumerate(texts) for at in range(len(t) - length + 1) if any(rank[j] < rank[i] and t[at:at + length] in u for j, u in enumerate(texts))}
        assert got == want


def test_queries_on_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_similar_sets"](spark, sf).collect()}
    assert got == brute.similar(docs, 85, 4)
    left = {tuple(r) for r in QUERIES["op7_repeats"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert left == {(a, b, c, d, hashlib.sha256(e).hexdigest()) for a, b, c, d, e in brute.without_repeats(docs, 50)}


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [(centres[i % 12] + rng.normal(size=16) * 0.08).tolist() for i in range(300)] + rng.normal(size=(100, 16)).tolist()
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [2.0, 3.9], [-1.0, 2.0], [1e300] * 16, [1e-300] * 16]
    vectors += (rng.normal(size=(6, 5))[rng.integers(0, 6, 90)] + rng.normal(size=(90, 5)) * 0.05).tolist() + [[3.0]] * 2 + [[-3.0]]
    rows = [(7 * n % 1009, v) for n, v in enumerate(vectors)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, links string").repartition(4)
    monkeypatch.setattr(near_vectors, "LEAF", 8)
    want = brute.near_vectors(rows, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.linked_vectors(df, block=32).collect()}
    assert got == {i: (*want[n], want[n][1] == i) for n, (i, _) in enumerate(rows)}
    assert near_vectors.linked_vectors(df.limit(0)).count() == 0
    again = near_vectors.linked_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01])], "vec_id long, embedding array<float>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in again), key=str) == [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False)]


def test_near_vectors_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute.near_vectors(rows, 0.95)
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_near_vectors"](spark, sf).collect()}
    assert got == {i: want[n] for n, (i, _) in enumerate(rows)}
