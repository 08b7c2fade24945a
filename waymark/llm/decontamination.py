"""Benchmark decontamination by latent semantic retrieval.

Texts become word numbers (A-Z lower-cased, ASCII punctuation dropped), written once.
Passages are windows of 32 words, every 16 words. Document frequencies of the hashed
words over all passages give TF-IDF; a randomised SVD of the matrix of all passages,
with every sum taken over the partitions, gives latent directions: random signed sums
of the passages span them, and the passages' products in that span turn and scale them.
Every passage of every document is counted, fitted, placed and searched. A passage and an
item's passages are compared by the cosine of their latent coordinates, scaled to unit
variance, so that frequent words don't make everything alike. An item shorter than a
passage makes up a part of it only, so its threshold falls with the root of its length.
The latent search finds what comes near in meaning, and by itself at least nine of ten
pairs (tests/llm). An exact supplement finds the rest, and can be left out (`exact`):
words are counted as well. A stretch that holds enough of an item must hold so many of any part of its words,
and the part that other stretches hold least often is counted in every run of blocks.
That misses no pair, whatever the item's length and the directions.

Each pair found either way is checked on words. A document's stretches are one and a
half times the item long, start every quarter of the item and reach the document's end.
The longest common subsequence of the item and a stretch, as a share of the item, must
reach `same`; between `paraphrase` and `same` the item's answer, where it has one, must
also occur within an item's length of the stretch. The share of a pair is that of its best stretch.

Items are taken in blocks of a fixed number, each against all documents; no join, no
shuffle of texts. Null or empty texts and items match nothing, nor do items of fewer
than `LEAST` words; a short text has one passage. Repeated documents and items are
judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm.shingles import KEPT_WORDS, LOWER
from waymark.llm.sums import partition_sums
from waymark.llm.tables import fresh, written

STEP, DIMS, RANK, EXTRA, LEAST = 16, 1 << 13, 96, 16, 5
NEAR, SAME, PARAPHRASE, ITEMS = 0.45, 0.65, 0.45, 5000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
WORDS: dict[bytes, int] = {}


def word_numbers(text: str | None) -> np.ndarray:
    """A 32-bit number for each word; words of punctuation alone vanish."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER, PUNCTUATION).split()
    if len(WORDS) > KEPT_WORDS:
        WORDS.clear()
    for word in set(words).difference(WORDS):
        WORDS[word] = xxhash.xxh32_intdigest(word)
    return np.fromiter(map(WORDS.__getitem__, words), np.uint32, len(words))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"doc_id": rows["doc_id"], "words": [word_numbers(t).tobytes() for t in rows["text"]]})


@dataclass
class Passages:
    """The passages of a batch of texts: a block of STEP words and the next one of its text, if there is one."""

    features: np.ndarray  # of the words of each block; DIMS where a text has ended
    first: np.ndarray  # the first block of each passage
    follows: np.ndarray  # whether a passage has a second one
    owner: np.ndarray  # the text of each passage
    place: np.ndarray  # the number of its first block in the text


def passages(texts: list[np.ndarray]) -> Passages:
    counts = np.array([len(t) for t in texts], np.int64)
    n = -(-counts // STEP)
    before = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), n)
    place = np.arange(n.sum()) - np.repeat(before, n)
    features = np.full(n.sum() * STEP, DIMS, np.int64)
    words = np.concatenate([*texts, np.zeros(0, np.uint32)])
    features[np.arange(len(words)) + np.repeat(before * STEP - np.cumsum(counts) + counts, counts)] = words % DIMS
    # The last block of a text with more than one is no passage of its own, for the one before it holds it.
    last = place == np.repeat(n, n) - 1
    first = np.flatnonzero((place == 0) | ~last)
    return Passages(features.reshape(-1, STEP), first, ~last[first], owner[first], place[first])


def _ended(table: np.ndarray) -> np.ndarray:
    """A table by feature with a row of zeros for the places after a text's end."""
    return np.concatenate([table, np.zeros_like(table[:1])])


def _summed(p: Passages, table: np.ndarray) -> np.ndarray:
    """Sums over each passage's words of a table by feature."""
    if not len(p.features):
        return np.zeros((0, table.shape[1]), table.dtype)
    block = table.take(p.features[:, 0], axis=0)
    for k in range(1, STEP):
        block += table.take(p.features[:, k], axis=0)
    out = block[p.first]
    out[p.follows] += block[p.first[p.follows] + 1]
    return out


def _texts(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint32) for w in rows["words"]]


def _batches(rows: pd.DataFrame, words: int = 20_000) -> Iterator[pd.DataFrame]:
    """Rows in runs of about so many words."""
    size = rows["words"].map(len).to_numpy() // 4 + 1
    cut = (np.cumsum(size) - size) // words
    for _, part in rows.groupby(cut):
        yield part


@dataclass
class Latent:
    """Weights of the hashed words, and their latent coordinates scaled to unit variance."""

    idf: np.ndarray
    table: np.ndarray

    def coordinates(self, p: Passages) -> np.ndarray:
        x = _summed(p, self.table)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _signed_sums(total: np.ndarray, p: Passages, rng: np.random.Generator) -> None:
    """Add the word counts of each passage, with a random sign, to a random column of a table by feature."""
    columns = total.shape[1]
    sums, column, sign = np.zeros(total.size), rng.integers(0, columns, len(p.first)), rng.choice((-1.0, 1.0), len(p.first))
    for blocks, own in ((p.first, slice(None)), (p.first[p.follows] + 1, p.follows)):
        place = p.features[blocks] * columns + column[own, None]
        np.add.at(sums, place.ravel(), np.repeat(sign[own], STEP))
    total += sums.reshape(total.shape)


def fit(words: DataFrame, rank: int = RANK, seed: int = 5, fit_docs: int | None = None) -> Latent:
    """Frequencies and latent directions from all passages of a table with word numbers.

    For trials, fit_docs takes the directions from about so many documents, picked by a hash of their id.
    """
    side = rank + EXTRA

    def frequencies(total: np.ndarray, rows: pd.DataFrame) -> None:
        """By feature, the blocks that hold it and the signed sums; behind them the numbers of blocks and documents."""
        for part in _batches(rows, 200_000):
            p = passages(_texts(part))
            ordered = np.sort(p.features, axis=1)
            new = np.append(np.ones((len(ordered), 1), bool), ordered[:, 1:] != ordered[:, :-1], axis=1)
            total[:DIMS, 0] += np.bincount(ordered[new], minlength=DIMS + 1)[:DIMS]
            _signed_sums(total[:DIMS + 1, 1:], p, np.random.default_rng([seed, TaskContext.get().partitionId(), int(total[DIMS + 1, 0])]))
            total[DIMS, 0] += len(p.features)
            total[DIMS + 1, 0] += len(part)

    sums = partition_sums(words, (DIMS + 2, 1 + side), frequencies)
    df, docs = sums[:DIMS + 1, 0], sums[DIMS + 1, 0]
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])).astype(np.float32)
    if fit_docs is not None and fit_docs < docs:
        words = words.filter(F.pmod(F.xxhash64("doc_id", F.octet_length("words")), F.lit(1 << 20)) < int(fit_docs / docs * (1 << 20)))
        sums = partition_sums(words, (DIMS + 2, 1 + side), frequencies)
    span, _ = np.linalg.qr(sums[:DIMS, 1:] * idf[:, None])

    def products(total: np.ndarray, rows: pd.DataFrame) -> None:
        """Add (A span)'(A span), A the TF-IDF rows of length one."""
        weighted, squares = _ended((span * idf[:, None]).astype(np.float32)), _ended(idf[:, None] ** 2)
        for part in _batches(rows):
            p = passages(_texts(part))
            y = _summed(p, weighted) / np.sqrt(np.maximum(_summed(p, squares), 1e-9))
            total += y.T @ y

    power, turn = np.linalg.eigh(partition_sums(words, (side, side), products))
    power, turn = power[::-1][:rank], turn[:, ::-1][:, :rank]
    scale = 1 / np.sqrt(np.maximum(power, power[0] * 1e-9 + 1e-12))
    return Latent(idf, _ended((idf[:, None] * (span @ turn) * scale).astype(np.float32)))


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a row of the table at a time in the bits of a number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def _occurs(answer: list[int], words: list[int]) -> bool:
    return any(words[i:i + len(answer)] == answer for i in range(len(words) - len(answer) + 1))


def _holds(p: Passages, window: np.ndarray, item: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The idf weight of the item's words that each window holds; weights is 0 but for the words of an item."""
    first, second = p.features[p.first[window]], p.features[np.minimum(p.first[window] + 1, len(p.features) - 1)]
    second = np.where(p.follows[window][:, None], second, DIMS)
    return weights[item[:, None], first].sum(1) + weights[item[:, None], second].sum(1)


def _needed(words: np.ndarray, answer: np.ndarray | None, same: float, paraphrase: float) -> int:
    """The words of an item that a stretch must hold in order."""
    least = min(same, paraphrase) if answer is not None and len(answer) else same
    return max(1, int(np.ceil(least * len(words) - 1e-9)))


def _stretch(n: int) -> tuple[int, int]:
    """The length of the stretches for an item of n words, and how far apart they start."""
    return n + n // 2, max(1, n // 4)


@dataclass
class Counted:
    """The words counted for each item, and how many of them a run of blocks must hold; items of few blocks come last."""

    item: np.ndarray  # the item of each column
    table: np.ndarray  # by feature and column, whether the word is counted
    blocks: np.ndarray  # the blocks that a stretch can touch
    least: np.ndarray
    rank: np.ndarray  # by column and feature, the place of the word among the item's; the last place for others
    times: np.ndarray  # by column and place, how often the item has the word
    lacks: np.ndarray  # the words that a stretch may lack


def counted(idf: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray | None]], same: float, paraphrase: float) -> Counted:
    """If a stretch lacks at most d words of an item, it lacks at most d of any part of it.

    The part is the rarest words, as many as make a stray run least likely by Chernoff's bound.
    """
    rates = -np.log1p(-np.minimum(np.exp(-np.maximum(idf, 0)), 0.999))
    blocks = np.array([-(-(_stretch(len(words))[0] + STEP - 1) // STEP) for _, words, _ in items])
    item = np.argsort(-blocks, kind="stable")
    most = max(len(np.unique(words % DIMS)) for _, words, _ in items)
    table, least, lacks = np.zeros((DIMS + 1, len(items)), np.uint8), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    rank, times = np.full((len(items), DIMS + 1), most, np.int32), np.zeros((len(items), most + 1), np.int32)
    for k, i in enumerate(item):
        _, words, answer = items[i]
        found, often = np.unique(words % DIMS, return_counts=True)
        order = np.argsort(rates[found], kind="stable")
        rank[k, found[order]], times[k, :len(found)] = np.arange(len(found)), often[order]
        lacks[k] = len(words) - _needed(words, answer, same, paraphrase)
        held = np.cumsum(often[order]) - lacks[k]
        stray = blocks[i] * np.cumsum(rates[found][order])
        sure = np.maximum(held, 1)
        bound = np.where(held > stray, sure * np.log(sure / stray) - sure + stray, 0)
        part = int(np.argmax(np.where(held > 0, bound, -1)))
        table[found[order[:part + 1]], k], least[k] = 1, held[part]
    return Counted(item, table, blocks[item], least, rank, times, lacks)


def _runs(p: Passages, words: Counted) -> tuple[np.ndarray, np.ndarray]:
    """(block, item): the runs, each by its first block, that hold enough of the words counted for an item.

    A run may go on into the next text, which only adds to what it holds.
    """
    kind = np.uint8 if words.blocks[0] * STEP < 256 else np.uint32
    held = words.table.take(p.features[:, 0], axis=0)
    for k in range(1, STEP):
        held += words.table.take(p.features[:, k], axis=0)
    held = held.astype(kind, copy=False)
    sums, least = held.copy(), np.minimum(words.least, np.iinfo(kind).max).astype(kind)
    begins, columns = [], []
    for n in range(1, int(words.blocks[0]) + 1):
        longer = int(np.searchsorted(-words.blocks, -n, "left"))  # columns of more than n blocks
        wide = int(np.searchsorted(-words.blocks, -n, "right"))
        if wide > longer:
            begin, column = np.divmod(np.flatnonzero(sums[:, longer:wide] >= least[longer:wide]), wide - longer)
            enough = _enough(p, words, begin, column + longer, n)
            begins.append(begin[enough])
            columns.append(column[enough] + longer)
        if longer and n < len(held):
            sums[:-n, :longer] += held[n:, :longer]
    return np.concatenate(begins), words.item[np.concatenate(columns)]


def _enough(p: Passages, words: Counted, begin: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n blocks lacks no more words of the item than it may, each counted as often as the item has it."""
    out, places = np.zeros(len(begin), bool), words.times.shape[1]
    each = max(1, (1 << 20) // max(places, n * STEP))
    for at in range(0, len(begin), each):
        b, c = begin[at:at + each], column[at:at + each]
        blocks = b[:, None] + np.arange(n)
        features = np.where(blocks[..., None] < len(p.features), p.features[np.minimum(blocks, len(p.features) - 1)], DIMS).reshape(len(b), -1)
        found = words.rank[c[:, None], features] + np.arange(len(b))[:, None] * places
        held = np.bincount(found.ravel(), minlength=len(b) * places).reshape(len(b), places)
        lacking = np.maximum(words.times[c] - held, 0).sum(1)
        out[at:at + each] = lacking <= words.lacks[c]
    return out


def _starts(size: int, n: int, begin: int, end: int) -> range:
    """The starts from begin to before end of the stretches for an item of n words in a text of so many words."""
    length, step = _stretch(n)
    return range(-(-max(begin, 0) // step) * step, min(end, max(1, size - length + step)), step)


def _leaks(latent: Latent, items: list[tuple[int, np.ndarray, np.ndarray | None]], near: float, same: float, paraphrase: float, exact: bool):
    asked = passages([words for _, words, _ in items])
    nears = near * np.sqrt(np.minimum([len(words) for _, words, _ in items], 2 * STEP) / (2 * STEP))[asked.owner]
    coordinates = latent.coordinates(asked)
    weights, whole = np.zeros((len(items), DIMS + 1), np.float32), np.zeros(len(items))
    for i, (_, words, _) in enumerate(items):
        weights[i, words % DIMS] = latent.idf[words % DIMS]
        whole[i] = latent.idf[words % DIMS].sum() * min(1, 2 * STEP / len(words))
    lists = [(i, w.tolist(), None if a is None or not len(a) else a.tolist()) for i, w, a in items]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare = counted(latent.idf, items, same, paraphrase) if exact else None
        least, sets = [_needed(w, a, same, paraphrase) for _, w, a in items], [np.unique(w) for _, w, _ in items]
        for batch in batches:
            for part in _batches(batch):
                texts = _texts(part)
                p = passages(texts)
                if not len(p.first):
                    continue
                hit, query = np.nonzero(latent.coordinates(p) @ coordinates.T >= nears)
                window, item = np.divmod(np.unique(hit * len(items) + asked.owner[query]), len(items))
                # A window next to a copy holds half of what it could; stray words weigh less.
                likely = _holds(p, window, item, weights) >= paraphrase / 2 * whole[item]
                window, item = window[likely], item[likely]
                size = np.array([len(w) for _, w, _ in items])[item]
                # A passage's stretches lie up to the item's length around it, a run's start in its first block.
                begin, end = p.place[window] * STEP - size, (p.place[window] + 2) * STEP + size - (size + size // 2) + 1
                owner, place = np.zeros((2, len(p.features)), np.int64)
                owner[p.first[p.follows] + 1], place[p.first[p.follows] + 1] = p.owner[p.follows], p.place[p.follows] + 1
                owner[p.first], place[p.first] = p.owner, p.place
                block, other = _runs(p, rare) if exact else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                regions: dict[tuple[int, int], set[int]] = {}
                for d, i, b, e in zip(np.append(p.owner[window], owner[block]).tolist(), np.append(item, other).tolist(),
                                      np.append(begin, place[block] * STEP).tolist(), np.append(end, (place[block] + 1) * STEP).tolist()):
                    regions.setdefault((d, i), set()).update(_starts(len(texts[d]), len(lists[i][1]), b, e))
                best: dict[tuple[int, int], float] = {}
                for (d, i), starts in regions.items():
                    if not starts:
                        continue
                    _, words, answer = lists[i]
                    length, low, high = _stretch(len(words))[0], min(starts), max(starts)
                    around = texts[d][low:high + length]
                    # Other words than the item's are in no common subsequence.
                    own = np.flatnonzero(sets[i][np.minimum(np.searchsorted(sets[i], around), len(sets[i]) - 1)] == around)
                    begins = np.array(sorted(starts)) - low
                    left, right = np.searchsorted(own, begins), np.searchsorted(own, begins + length)
                    enough, held = right - left >= least[i], around[own].tolist()
                    for s, x, y in zip(begins[enough].tolist(), left[enough].tolist(), right[enough].tolist()):
                        share = common_subsequence(words, held[x:y]) / len(words)
                        if share > best.get((d, i), 0.0) and (share >= same or share >= paraphrase and answer is not None and _occurs(
                                answer, texts[d][max(0, low + s - len(words)):low + s + length + len(words)].tolist())):
                            best[d, i] = share
                if best:
                    ids = part["doc_id"].to_numpy()
                    yield pd.DataFrame([(ids[d], lists[i][0], s) for (d, i), s in sorted(best.items())], columns=["doc_id", "item_id", "share"])
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text", answer: str | None = None,
          near: float = NEAR, same: float = SAME, paraphrase: float = PARAPHRASE, fit_docs: int | None = None, exact: bool = True) -> DataFrame:
    """Rows (doc_id, item_id, share): the items of which a document holds a copy or paraphrase, and how much of the item it holds.

    Without `exact` only pairs that the latent search finds are checked.
    """
    kind, item_kind = dict(docs.dtypes)[doc_id], dict(benchmark.dtypes)[item_id]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    words = written(rows.mapInPandas(_numbered, f"doc_id {kind}, words binary"), "leak-words")
    latent, found = fit(words, fit_docs=fit_docs), []
    block: list[tuple[int, np.ndarray, np.ndarray | None]] = []

    def search() -> None:
        found.append(words.mapInPandas(_leaks(latent, list(block), near, same, paraphrase, exact), f"doc_id {kind}, item_id {item_kind}, share double"))
        block.clear()

    asked = benchmark.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{item}`").alias("text"), (F.col(f"`{answer}`") if answer else F.lit(None).cast("string")).alias("answer"))
    for row in asked.filter("id IS NOT NULL").toLocalIterator():
        numbers = word_numbers(row.text)
        if len(numbers) >= LEAST:
            block.append((row.id, numbers, None if row.answer is None else word_numbers(row.answer)))
        if len(block) == ITEMS:
            search()
    if block or not found:
        if block:
            search()
        else:
            return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, share double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item; each row is judged by its own text, and one without a text goes with the other rows of its id."""
    key = fresh([*docs.columns, "leaked_key"], "row_key")
    own = F.concat(F.lit(":"), F.col(f"`{doc_id}`").cast("string"))
    keyed = docs.withColumn(key, F.coalesce(F.concat(F.md5(F.col(f"`{text}`")), F.coalesce(own, F.lit(""))), F.concat(F.lit("no text"), own)))
    both = F.explode(F.array("doc_id", F.concat(F.lit("no text"), F.substring("doc_id", 33, 1 << 30))))
    bad = leaks(keyed, benchmark, doc_id=key, text=text, **options).select(both.alias("leaked_key")).distinct()
    return keyed.join(bad, F.col(key) == F.col("leaked_key"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
