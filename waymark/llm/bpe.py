"""Byte-level BPE ids of whole texts and back, long texts by tree concatenation.

Texts of at most `leaf` code points are encoded as they are. A longer one is halved until
its leaves are short; the leaves are rows of a table of their own, so they are encoded in
parallel. Then halves are joined upwards. Where two halves meet at a place at which the
tokenizer surely begins a new word, their ids are just put together. Where the text is
unsplit there (a run of letters, of digits, of signs or of blanks), a window of ids around
the join is encoded again and grows on both sides, until its first id is the left half's
and its last one the right half's at the same place, or it covers a half. That is exact:
BPE always takes the best pair that is left, so ids are those of a word if and only if
each two neighbours are the ids of their own text; with both ends agreed, every pair of
neighbours lies in the left half, in the window or in the right half. Windows end where
a character does and stay four characters within the run, else they go on to the next
sure border.

Words met before are looked up. A batch is cut at borders that are sure whatever the text
(isolated blanks and newlines; a Latin letter before another ASCII sign), its distinct
words are found, and only new ones go to the tokenizers library, many in one text.

Null and empty texts have no ids. Every row counts, repeated or null ids of documents too.
Other columns are ignored, an empty table gives an empty result. Tokenizers of another kind
(normalisers, other pre-tokenizers, added tokens that eat blanks) encode each text whole.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from waymark.llm.tables import fresh, partitions_for, written

LEAF = 1 << 15       # code points of a leaf
WINDOW, MARGIN = 8, 4  # ids on each side of a join at first; characters that a cut or window stays within a run
ROWS = 500           # texts of one batch of results
SLICE = 4 << 20      # bytes of text that are cut into words at a time
# Words that a worker keeps and the longest one kept; beyond that the worker starts anew, which changes no result.
KEPT_WORDS, LONGEST = 800_000, 64

# The mark of a word that no blank precedes, and texts in which blanks and newlines aren't all alone between other characters.
BARE = "\x01"
ODD = (r"[\s\x0b][\s\x0b]|^[\s\x0b]|[\s\x0b]$|[\x00-\x09\x0b-\x1f\x{7f}-\x{a0}\p{Zl}\p{Zp}]|[^ \P{Zs}]")
# A Latin letter before another ASCII sign: a word ends there.
BORDER = r"([A-Za-zÀ-ÖØ-öø-ɏ])([!-@\[-`{-~])"


BLANKS = frozenset("\t\n\x0b\x0c\r \xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


@lru_cache(1 << 16)
def kind(char: str) -> str:
    """L, N, S (other sign) or W (blank) where old and new versions of Unicode tell the same, else nothing."""
    if char in BLANKS:
        return "W"
    now, once = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    if now[0] in "LN":
        return now[0] if once[0] == now[0] else ""
    return "S" if now[0] in "PSM" and (once[0] in "PSM" or once == "Cn") else ""


class Encoder:
    """The tokenizers library with a store of words for each worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = tokenizer.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        pre, model = tokenizer.pre_tokenizer, tokenizer.model
        self.by_word = (tokenizer.normalizer is None and isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and getattr(pre, "use_regex", True)
                        and isinstance(model, models.BPE) and not model.dropout and not model.ignore_merges and not model.continuing_subword_prefix
                        and not model.end_of_word_suffix and not any(t.lstrip or t.rstrip or t.single_word for t in added.values()))
        size = tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        plain = _alphabet()
        self.table = [b""] * size
        for token, i in tokenizer.get_vocab().items():
            self.table[i] = token.encode() if i in added else b"".join(plain.get(c) or c.encode() for c in token)
        self.lengths = np.array([len(t) for t in self.table])
        self.blank = np.array([t[:1] == b" " for t in self.table])
        self.newline = tokenizer.token_to_id("Ċ")
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.begin, self.size, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 20, self.type), 0

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.type) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Store words with their ids, which lie behind one another."""
        at, count = len(self.number), len(words)
        while at + count > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.begin[at:at + count] = self.used + np.cumsum(sizes) - sizes
        self.size[at:at + count] = sizes
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(words, range(at, at + count)))

    def _learn(self, words: list[str]) -> None:
        """Encode new words, a thousand in one text; the ids of the blanks or newlines between them tell where each begins."""
        after_blank = [w for w in words if w[:1] != BARE and w]
        bare = [w for w in words if len(w) > 1 and w[0] == BARE and w[1:] != "\n"]
        left = [w for w in words if w in ("", BARE) or w[1:] == "\n"]
        for group in (after_blank[i:i + 1000] for i in range(0, len(after_blank), 1000)):
            ids = self.library([" " + " ".join(group)])[0]
            starts = np.flatnonzero(self.blank[ids])
            if len(starts) == len(group):
                self._keep(group, ids, np.diff(starts, append=len(ids)))
            else:
                left += group
        for group in (bare[i:i + 1000] for i in range(0, len(bare), 1000)):
            ids = self.library(["\n".join(w[1:] for w in group)])[0]
            ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(ends) == len(group):
                self._keep(group, ids[ids != self.newline], np.diff(ends, prepend=-1) - 1)
            else:
                left += group
        if left:
            found = self.library([w[1:] if w[:1] == BARE else " " + w for w in left])
            self._keep(left, np.concatenate(found), np.array([len(x) for x in found]))

    def _words(self, texts: pa.Array) -> list[np.ndarray]:
        bare = pc.replace_substring(pc.binary_join_element_wise(pa.scalar(BARE), texts, ""), "\n", f" {BARE}\n {BARE}")
        words = pc.split_pattern(pc.replace_substring_regex(bare, BORDER, rf"\1 {BARE}\2"), " ")
        coded = words.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) > KEPT_WORDS:
            self._forget()
        long = [w for w in distinct if len(w) > LONGEST]
        self._learn([w for w in distinct if w not in self.number and len(w) <= LONGEST])
        used = self.used
        self._learn(long)
        numbers = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        sizes = self.size[numbers].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.begin[numbers] - ends + sizes, sizes) + np.arange(total)]
        for w in long:  # they came last, so their numbers and places are free again
            del self.number[w]
        self.used = used
        borders = np.concatenate([[0], ends])[words.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:])]

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word or self.newline is None:
            return self.library(texts.to_pylist())
        odd = pc.match_substring_regex(texts, ODD)
        for content in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, content))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray | None] = [None] * len(texts)
        at = np.flatnonzero(odd)
        for i, ids in zip(at, self.library(texts.take(pa.array(at)).to_pylist()) if len(at) else []):
            out[i] = ids
        at = np.flatnonzero(~odd)
        if len(at):
            plain = texts.take(pa.array(at))
            ends = np.cumsum(pc.binary_length(plain).to_numpy())
            begin = 0
            while begin < len(at):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLICE, "right")))
                for i, ids in zip(at[begin:end], self._words(plain.slice(begin, end - begin))):
                    out[i] = ids
                begin = end
        return out

    # -- halving and joining -----------------------------------------------------------------

    def _whole(self, text: str, at: int) -> bool:
        """Whether no added token lies across the place."""
        return not any(text.startswith(a, i) for a in self.added for i in range(max(0, at - len(a) + 1), at))

    def sure(self, text: str, at: int) -> bool:
        """Whether a word surely ends at the place."""
        a, b = kind(text[at - 1]), kind(text[at])
        border = a == "L" and b in ("N", "S", "W") or a == "N" and b in ("L", "S", "W") or a == "S" and (b in ("N", "W") or b == "L" and text[at - 1] != "'")
        return border and self._whole(text, at)

    def within(self, text: str, at: int) -> bool:
        """Whether the place lies in a run of one kind of characters."""
        around = text[max(0, at - MARGIN):at + MARGIN]
        return len(around) == 2 * MARGIN and kind(around[0]) != "" and len({kind(c) for c in around}) == 1 and self._whole(text, at)

    def cut(self, text: str, leaf: int) -> list[int]:
        """The places, in order, at which the text is halved down to leaves; a half without any place stays whole."""
        def near(begin: int, end: int, good: Callable[[str, int], bool], reach: int) -> int | None:
            middle = (begin + end) // 2
            for step in range(min(reach, (end - begin) // 2 - MARGIN)):
                for at in (middle - step, middle + step):
                    if begin < at < end and good(text, at):
                        return at
            return None

        places, halves = [], [(0, len(text))]
        while halves:
            begin, end = halves.pop()
            if end - begin <= leaf:
                continue
            at = near(begin, end, self.sure, 256) or near(begin, end, self.within, 256) or near(begin, end, lambda t, p: self.sure(t, p) or self.within(t, p), end)
            if at is not None:
                places.append(at)
                halves += [(begin, at), (at, end)]
        return sorted(places)

    def join(self, left_text: str, left: np.ndarray, right_text: str, right: np.ndarray) -> np.ndarray:
        """The ids of two texts put together, from the ids of each."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        text, cut = left_text + right_text, len(left_text)
        if self.sure(text, cut):
            return np.concatenate([left, right])
        run = kind(text[cut]) if self.within(text, cut) else ""
        inside = lambda a, b: run != "" and a >= 0 and b <= len(text) and all(kind(c) == run for c in text[a:b])
        back, ahead = WINDOW, WINDOW
        while True:
            low, back, agreed_low = self._low(text, cut, left, back, inside)
            high, ahead, agreed_high = self._high(text, cut, right, ahead, inside)
            ids = self.library([text[low:high]])[0]
            if (agreed_low or ids[0] == left[-back]) and (agreed_high or ids[-1] == right[ahead - 1]):
                return np.concatenate([left[:len(left) - back], ids, right[ahead:]])
            if not (agreed_low or ids[0] == left[-back]):
                back *= 2
            if not (agreed_high or ids[-1] == right[ahead - 1]):
                ahead *= 2

    def _low(self, text: str, cut: int, left: np.ndarray, back: int, inside: Callable[[int, int], bool]) -> tuple[int, int, bool]:
        """Where a window of so many ids before the cut begins, its ids, and whether the ids before it are sure to stay."""
        while back < len(left):
            tail = b"".join(self.table[i] for i in left[-back:])
            if tail[0] & 0xC0 != 0x80:
                low = cut - len(tail.decode())
                if inside(low - MARGIN, cut):
                    return low, back, False
                break
            back += 1
        else:
            return 0, len(left), True
        while low > 0 and not self.sure(text, low):
            low -= 1
        size = len(text[:low].encode())
        return low, len(left) - int(np.searchsorted(np.cumsum(self.lengths[left]), size, "right")), True

    def _high(self, text: str, cut: int, right: np.ndarray, ahead: int, inside: Callable[[int, int], bool]) -> tuple[int, int, bool]:
        size = np.cumsum(self.lengths[right])
        data = text[cut:].encode()
        while ahead < len(right):
            end = int(size[ahead - 1])
            if data[end] & 0xC0 != 0x80:
                high = cut + len(data[:end].decode())
                if inside(cut, high + MARGIN):
                    return high, ahead, False
                break
            ahead += 1
        else:
            return len(text), len(right), True
        while high < len(text) and not self.sure(text, high):
            high += 1
        return high, int(np.searchsorted(size, len(text[cut:high].encode()), "right")), True

    def concatenated(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """The ids of all texts behind one another, joined pair by pair in a tree."""
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            joined = [self.join(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs]
            rest = len(texts) - len(texts) % 2
            texts, ids = [texts[i] + texts[i + 1] for i in pairs] + texts[rest:], joined + ids[rest:]
        return ids[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; unknown ones have none, broken UTF-8 becomes U+FFFD."""
        size = len(self.table)
        return b"".join([self.table[i] for i in ids.tolist() if 0 <= i < size]).decode("utf-8", "replace")


def _alphabet() -> dict[str, bytes]:
    """The bytes that the printable characters of byte-level vocabularies stand for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): bytes([b]) for b in shown} | {chr(256 + n): bytes([b]) for n, b in enumerate(hidden)}


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def encode(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, decoded: bool = False) -> DataFrame:
    """Rows (doc_id, ids): the ids of every whole text as an array of int, a row for each row of docs.

    With `decoded` the text that the ids stand for comes along as a column of that name.
    """
    kind_of_id, spark = docs.schema[doc_id].dataType.simpleString(), docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    long = F.char_length("text") > leaf
    shape, names = "ids array<int>" + ", decoded string" * decoded, ["ids"] + ["decoded"] * decoded

    def results(ids: list[np.ndarray]) -> list[pa.Array]:
        return [_lists(ids)] + [pa.array(map(encoder(tokenizer).decode, ids), pa.string())] * decoded

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *results(encoder(tokenizer).encode(part.column("text")))], ["doc_id", *names])

    def cut(text: str) -> list[str]:
        tokens = encoder(tokenizer)
        places = [0, *(tokens.cut(text, leaf) if tokens.by_word else []), len(text)]
        return [text[a:b] for a, b in zip(places, places[1:])]

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                parts = cut(text)
                yield pd.DataFrame({"key": key, "n": range(len(parts)), "text": parts})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in encoder(tokenizer).encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["key", "n", "text", "ids"])

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        table, tokens = table.sort_by("n"), encoder(tokenizer)
        ids = tokens.concatenated(table["text"].to_pylist(), [np.frombuffer(x, tokens.type) for x in table["ids"].to_pylist()])
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), *results([ids])], ["key", *names])

    short = rows.filter(~long).mapInArrow(whole, f"doc_id {kind_of_id}, {shape}")
    # Long texts get a key of their own in a written table, so that a second run of a task finds the same.
    keyed = written(rows.filter(long).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    parts = written(keyed.select("key", "text").mapInPandas(leaves, "key long, n long, text string"), "text-leaves")
    halves = parts.repartition(partitions_for(spark, parts.count(), 64), "key", "n").mapInArrow(encoded, "key long, n long, text string, ids binary")
    put = halves.groupBy("key").applyInArrow(joined, f"key long, {shape}")  # a group holds one text
    return short.unionByName(keyed.select("doc_id", "key").join(put, "key").select("doc_id", *names))


def decode(tokens: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """tokens with the text of its ids in a further column; null ids have a null text."""
    name = fresh(tokens.columns, text)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, len(batch), ROWS)):
                lists = part.column(part.schema.get_field_index(ids))
                found = [x if x is None else encoder(tokenizer).decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in lists.to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, name])

    return tokens.mapInArrow(texts, f"{', '.join(f'`{c}` {t}' for c, t in tokens.dtypes)}, `{name}` string")
