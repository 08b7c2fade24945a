"""Sharding and mixing against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from waymark.llm import mixing, sharding
from waymark.llm.queries import QUERIES, SHARDS

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_fill_by_turns():
    shards, size = ["a", "b", "c"], 101
    order = {}
    for s in shards:
        start, step = (int(hashlib.md5(f"{s}/{k}".encode()).hexdigest()[:15], 16) for k in ("offset", "step"))
        order[s] = [(start + i * (step % (size - 1) + 1)) % size for i in range(size)]
    slots = {}
    while len(slots) < size:
        for n, s in enumerate(shards):
            free = [x for x in order[s] if x not in slots]
            if free:
                slots[free[0]] = n
    assert sharding.fill(shards, size) == [slots[i] for i in range(size)]
    counts = Counter(sharding.fill(SHARDS))
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == len(SHARDS)
    moved = sum(a != b for a, b in zip(sharding.fill(SHARDS), sharding.fill(SHARDS[:-1])))
    assert moved < 0.05 * sharding.TABLE_SIZE
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)


def test_place_nulls_clashes_empty(spark):
    rows = [(1, "a", "Slot"), (1, "b", "x"), (None, "c", None), (None, "d", None), (2, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").withColumnRenamed("text", "Shard")
    got = sharding.place(df, SHARDS).collect()
    assert sharding.place(df, SHARDS).columns == ["doc_id", "slot", "shard"] and len(got) == 5
    assert len({r.shard for r in got if r.doc_id == 1}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 2
    assert all(0 <= r.shard < len(SHARDS) for r in got)
    assert sharding.place(df.limit(0), SHARDS).count() == 0


def filled(sizes, weights=(1, 2, 3), most=3):
    """Targets by stopping sources one round after another."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped = {}
    while True:
        rest = [s for s in names if s not in stopped]
        left = sum(sizes.values()) - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = {s: most * sizes[s] for s in rest if share[s] > most * sizes[s]}
        if not above:
            return stopped | share
        stopped |= above


def check_mix(docs, report):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    source = {}
    for d in docs:
        sizes[d.source] += size(d.text)
        largest[d.source] = max(largest[d.source], size(d.text))
        source[d.doc_id] = d.source
    want, taken = filled(sizes), defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in report) == Counter((d.doc_id, size(d.text)) for d in docs)
    for r in report:
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_mix_small_cases(spark):
    rows = [(i, "w " * (i % 17), None, ["b", None, "a", "c"][i % 4 if i % 3 else 0], 0) for i in range(900)]
    rows += [(2000 + i, None, None, "empty", 0) for i in range(3)] + [(3000, "x y", None, "tiny", 0)] + [(5000, "one two", None, "a", 0)] * 7
    docs = spark.createDataFrame(rows, DOC)
    report = mixing.mix_report(docs, chunk=8).collect()
    check_mix(docs.collect(), report)
    assert sorted(report) == sorted(mixing.mix_report(docs.repartition(7), chunk=8).collect())
    mixed = Counter(r.doc_id for r in mixing.mix(docs, chunk=8).collect())
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    words = defaultdict(int)
    for r in report:
        words[r.doc_id] += r.taken
    assert {k: n * size[k] for k, n in mixed.items()} == {k: n for k, n in words.items() if n}
    assert mixing.mix(docs, chunk=8).columns == docs.columns
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mix_keeps_expected_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), None, "ab"[i % 2], 0) for i in range(40)], DOC)
    total, runs = Counter(), 8
    for seed in range(runs):
        for r in mixing.mix_report(docs, seed=seed, chunk=8).collect():
            total[r.doc_id] += r.taken / r.size
    for s, rate in ((0, 40 / 60), (1, 80 / 60)):  # 60 words each, targets 40 and 80
        assert sum(total[i] for i in range(s, 40, 2)) / 20 / runs == pytest.approx(rate, abs=0.06)
        assert all(abs(total[i] / runs - rate) < 0.8 for i in range(s, 40, 2))


def test_mix_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check_mix(docs, QUERIES["op5_mixing"](spark, sf).collect())
