"""Phrases whose words occur together more often than apart, by top-order marginalisation.

Every word of a text begins one window: itself and the words that lead it by one, two and
so on, padded with nulls from the end of its piece. Only these longest windows are counted.
The occurrences of a shorter phrase are those of all windows that it is a prefix of, so one
ROLLUP over the columns of the window gives the counts of phrases of every length, those of
single words and of all words, and no length is exploded or counted by itself.

Windows are pruned before they are counted: a phrase of at least `least` occurrences holds
only words and runs of words of at least as many, so a window is padded from where a rarer
one would begin, and rare words are counted together. Which are rarer is told by sketches:
counters for hashes of words and neighbouring pairs, then of longer runs whose pairs are
frequent, summed over all texts; they never count too little. Their size follows the number
of words up to SKETCH; beyond that they let more windows through, which are then counted in
the shuffle with the same results.

A candidate is a phrase of two words or more with at least `least` occurrences. A cut of it
after k words scores floor(2000000 * a / (l + r)), with its own occurrences and those of
its two parts; the worst cut counts, ties to the smallest k. A candidate goes if it lies in
a longer one that has at least `cover` percent of its occurrences, dropped or not. All of
this is exact, in decimals where 64 bits may not do.

Texts are lower-cased in A-Z only. Null texts have no words; a null language is `und`, like
a language of that name. Repeated rows count each time; equal scores are ordered by the
number of occurrences, then by the bytes of the phrase. Other columns are ignored; tables
without words give no rows. Long texts are cut into runs of pieces of at most SLICE bytes
at a time, so a text's length only adds work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.tables import lookup, written

SLICE = 2 << 20          # bytes of text in words at a time
TASK = 128 << 20          # bytes of text of a task, where the table has more for each core: larger ones send fewer counts
LOAD = 8                  # words for each counter of the sketch
LEAST_BITS, SKETCH = 24, 27  # powers of two that bound the number of counters
CHUNKS, MERGED = 64, 16   # pieces in which tasks' sketches are summed, tasks of a group whose sums come first
SALTS = 64                # parts in which the first phrases of a language are found first

STOP = r"[.,;:!?\n-\r]"
MARK = "\n"               # stands between pieces; no word can hold it
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of a batch as codes, with the language and whether the next word is in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        marked = pc.replace_substring(pc.replace_substring_regex(pc.ascii_lower(texts), STOP, f" {MARK} "), "\t", " ")
        split = pc.split_pattern(marked, " ")
        coded = split.values.dictionary_encode()
        self.words = coded.dictionary
        code, counts = coded.indices.to_numpy(), np.diff(split.offsets.to_numpy())
        named = langs.dictionary_encode()
        lang = np.repeat(named.indices.to_numpy().astype(np.int32), counts)
        last = np.zeros(len(code), bool)
        last[np.cumsum(counts)[counts > 0] - 1] = True  # of a text
        at = {w: self.words.index(w).as_py() for w in ("", MARK)}
        # A blank word goes; if it was the last of its text, the one before it is.
        text = np.cumsum(last) - last
        there = code != at[""]
        code, lang, text = code[there], lang[there], text[there]
        word = code != at[MARK]
        joined = np.zeros(len(code), bool)
        if len(code):
            joined[:-1] = word[:-1] & word[1:] & (text[:-1] == text[1:])
        self.code, self.lang, self.joined = code[word], lang[word], joined[word]
        self.langs = named.dictionary
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w or "") for w in self.words.to_pylist()), np.uint64, len(self.words))
        self.lang_hash = np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in self.langs.to_pylist()), np.uint64, len(self.langs))

    def counters(self, size: int, bits: int) -> np.ndarray:
        """The sketch's counter of the run of `size` words from each place."""
        own, h = self.hash[self.code], self.lang_hash[self.lang]
        for k in range(size):
            ahead = np.zeros(len(own), np.uint64)
            ahead[:max(0, len(own) - k)] = own[k:]
            h = (h ^ ahead * MIX[1]) * MIX[2]
            h ^= h >> np.uint64(31)
        return h * MIX[0] >> np.uint64(64 - bits)

    def frequent(self, sketch: np.ndarray, bits: int, least: int, longest: int) -> list[np.ndarray]:
        """For 1, 2, ... words whether the run from each place lies in a piece, its words and pairs frequent."""
        usual = sketch[self.counters(1, bits)] >= least
        led = self.joined & usual & (sketch[self.counters(2, bits)] >= least)
        led[:-1] &= usual[1:]
        runs = [usual]
        for k in range(1, longest):
            n, here = max(0, len(usual) - k), np.zeros(len(usual), bool)
            here[:n] = runs[-1][:n] & led[k - 1:k - 1 + n]
            runs.append(here)
        return runs


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of runs of rows of at most SLICE bytes; a longer text is cut between pieces."""
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        ends = np.cumsum(pc.binary_length(texts).to_numpy()) if len(texts) else []
        begin = 0
        while begin < len(texts):
            start = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, start + SLICE, "right")))
            if ends[end - 1] - start > SLICE:
                for part in _parts(texts[begin].as_py()):
                    yield Words(pa.array([part]), langs.slice(begin, 1))
            else:
                yield Words(texts.slice(begin, end - begin), langs.slice(begin, end - begin))
            begin = end
        pa.default_memory_pool().release_unused()


def _parts(text: str) -> Iterator[str]:
    """Runs of whole pieces of a long text."""
    begin = 0
    while begin < len(text):
        found = re.compile(STOP).search(text, min(len(text), begin + SLICE // 4))
        end = found.end() if found else len(text)
        yield text[begin:end]
        begin = end


def _sketch(rows: DataFrame, least: int, bits: int, places: Callable[[Words], list[np.ndarray]]) -> np.ndarray:
    """Counters of what `places` tells for the words of all texts, up to `least` each."""
    kind, size = (np.uint8 if least < 256 else np.uint32), 1 << bits
    chunks = min(CHUNKS, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for words in _slices(batches):
            at, times = np.unique(np.concatenate(places(words)), return_counts=True)
            total[at] = np.minimum(total[at] + times, least)
        # packed, a task's sketch takes as many bytes as it has words rather than counters
        parts = [(n, packed(x)) for n, x in enumerate(total.reshape(chunks, -1)) if x.any()]
        group = TaskContext.get().partitionId() // MERGED
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int32()), pa.array([group] * len(parts), pa.int32()), pa.array([x for _, x in parts], pa.binary())],
                                         ["chunk", "part", "data"])

    def packed(counters: np.ndarray) -> bytes:
        return pa.compress(counters.tobytes(), "zstd", asbytes=True)

    def unpacked(data: bytes) -> np.ndarray:
        return np.frombuffer(pa.decompress(data, size // chunks * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size // chunks, np.int64)
        for data in rows["data"]:
            total = np.minimum(total + unpacked(data), least)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "data": [packed(total.astype(kind))]})

    parts = rows.mapInArrow(count, "chunk int, part int, data binary")
    grouped = parts.groupBy("chunk", "part").applyInPandas(added, "chunk int, data binary")
    total = np.zeros((chunks, size // chunks), kind)
    for row in grouped.groupBy("chunk").applyInPandas(added, "chunk int, data binary").collect():  # at most CHUNKS rows
        total[row.chunk] = unpacked(bytes(row.data))
    return total.ravel()


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of numbers from -1, and how often each occurs."""
    packed: list[tuple[np.ndarray, int]] = []  # as many columns in one number as 62 bits hold
    for c in columns:
        bits = int(c.max(initial=0) + 1).bit_length()
        if packed and packed[-1][1] + bits <= 62:
            packed[-1] = ((packed[-1][0] << bits) | (c.astype(np.int64) + 1), packed[-1][1] + bits)
        else:
            packed.append((c.astype(np.int64) + 1, bits))
    keys = [key for key, _ in packed]
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([(k := key[order])[1:] != k[:-1] for key in keys])
    at = np.flatnonzero(new)
    return [c[order[at]] for c in columns], np.diff(at, append=len(order))


def windows(rows: DataFrame, longest: int, least: int) -> DataFrame:
    """Rows (lang, w1, w2, ..., times): the padded longest windows, counted in part."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)))
    bits = int(np.clip(np.ceil(np.log2(size / 8 / LOAD + 1)), LEAST_BITS, SKETCH))
    share = rows.sparkSession.sparkContext.broadcast  # at most 2 ** SKETCH counters each
    pairs = share(_sketch(rows, least, bits, lambda words: [words.counters(1, bits), words.counters(2, bits)[words.joined]]))

    def longer(words: Words) -> list[np.ndarray]:
        runs = words.frequent(pairs.value, bits, least, longest)
        return [words.counters(k, bits)[runs[k - 1]] for k in range(3, longest + 1)]

    longs = share(_sketch(rows, least, bits, longer)) if longest > 2 else pairs

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            runs = words.frequent(pairs.value, bits, least, longest)
            columns, here = [words.lang], np.ones(len(words.code), bool)
            for k in range(1, longest + 1):
                here &= runs[k - 1]
                if k > 2:
                    here &= longs.value[words.counters(k, bits)] >= least
                n, lead = max(0, len(here) - k + 1), np.full(len(here), -1, words.code.dtype)
                lead[:n] = words.code[k - 1:]
                columns.append(np.where(here, lead, -1))
            (lang, *codes), times = _distinct(columns)
            yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(lang)), *[words.words.take(pa.array(c, mask=c < 0)) for c in codes], pa.array(times, pa.int64())],
                                             ["lang", *names, "times"])

    return rows.mapInArrow(emit, f"lang string, {', '.join(f'{n} string' for n in names)}, times long")


def phrase_counts(docs: DataFrame, longest: int = 4, least: int = 30, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (lang, words, phrase, f) of all phrases of up to `longest` words with at least `least` occurrences, and rows (lang, n) of all words."""
    names = [f"w{k}" for k in range(1, longest + 1)]
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counted = windows(rows, longest, least).groupBy("lang", *names).agg(F.sum("times").alias("times"))
    summed = counted.rollup("lang", *names).agg(F.sum("times").alias("f"), F.grouping_id().alias("rolled"))
    # Of the columns, the last ones are rolled up; a phrase has no padding in those that are left.
    words = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    whole = F.expr(f"rolled = shiftleft(1, {longest} - words) - 1")
    kept = summed.withColumn("words", words).filter(whole & ((F.col("words") == 0) | (F.col("f") >= least)))
    kept = written(kept.select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f"), "phrase-counts")
    return kept.filter("words > 0"), kept.filter("words = 0").select("lang", F.col("f").alias("n"))


def _part(words: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(words, first, count), " ")


def _exact(number: str | int) -> Column:
    return (F.col(number) if isinstance(number, str) else F.lit(number)).cast("decimal(38,0)")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, cover: int = 80, first: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    counts, totals = phrase_counts(docs, longest, least, lang, text)
    candidates = counts.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    split = candidates.withColumn("w", F.split("phrase", " "))

    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", _part(F.col("w"), F.lit(1), F.col("k"))).withColumn("tail", _part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")))
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("cast((cast(2000000 as decimal(38, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0))) as long)")
    worst = (cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", score)
             .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))

    # The parts of two words or more of each longer candidate, with the most occurrences of a candidate around them.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: _part(F.col("w"), at, size))))
    around = split.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(_exact("longer") * 100 >= _exact("a") * cover, F.lit(False))
    left = worst.join(around, ["lang", "phrase"], "left").filter(~covered).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(lookup(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
