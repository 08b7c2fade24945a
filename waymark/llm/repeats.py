"""Removing repeated byte strings by longest previous factors in suffix order.

A byte goes if it is covered by a string of `length` bytes that also starts in a
document of a smaller id. Equal strings have the same anchor, the leftmost smallest
hash among their substrings of `GRAM` bytes, so only strings around equal anchors need
to be compared:

1. each task deals its texts to chunks by their hash, each different text once with
   the ids of its copies; the copies of a text beyond its smallest id are told there
   and cost no more than their ids;
2. each chunk sends the hashes of its anchors, once each, to buckets; a bucket answers
   every chunk with a bit for each, set for those that two texts have;
3. each chunk sends the text around those anchors (each different text once, from its
   smallest document; further copies in the chunk are removed at once);
4. a bucket sorts the suffixes of its texts and finds, for each, the previous and the
   next smaller document in suffix order; where the common prefix with one of them has
   `length` bytes, the longest previous factor is long enough and the string goes;
5. each chunk takes the removed strings together and cuts its documents.

Chunks hold a bounded number of bytes, buckets a bounded number of chunks' shares,
which they sort in parts; a string in any number of documents costs a bucket one text
for each chunk. Texts are shuffled once, the exchange is used three times. Everything
that is shuffled is packed: texts compressed, numbers as differences, byte by byte.

Null text is empty; texts shorter than `length` stay whole; a null id is not smaller
or larger than any other, so such rows stay whole; rows of one id never remove each
other. Empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from waymark.llm.shingles import mixed
from waymark.llm.tables import partitions_for

LENGTH, GRAM, BATCH, HELD = 50, 24, 1 << 19, 32 << 20
# A bucket takes the shares of so many chunks, and sorts them in as many parts.
PARTS = 4
# Bits of an anchor's hash that are sent; equal ones of different anchors only send text in vain.
LOW = np.uint64(30)
PLACE = np.uint64((1 << 24) - 1)
MANY = 0x9E3779B97F4A7C15
DEALT = "p int, texts binary, ids binary, data binary"
SENT = "bucket int, p int, local boolean, numbers binary, data binary"


def _packed(*columns: np.ndarray) -> bytes:
    """Whole numbers in columns of one length, as compressed planes of their bytes; small ones take few bytes."""
    numbers = np.ascontiguousarray(np.stack(columns).astype("<i8", copy=False))
    planes = numbers.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1)
    return len(numbers[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], columns * n * 8, "zstd", asbytes=True), np.uint8).reshape(columns, 8, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(columns, n)


def _steps(rising: np.ndarray) -> np.ndarray:
    """Differences, whose running sum gives the numbers again, whatever wraps around."""
    return np.diff(rising, prepend=np.zeros(1, rising.dtype))


def _pieces(data: bytes, sizes: np.ndarray) -> list[bytes]:
    whole, ends = pa.decompress(data, int(sizes.sum()), "zstd", asbytes=True), np.cumsum(sizes)
    return [whole[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]


def _powers(k: int) -> np.uint64:
    return np.uint64(pow(MANY, k, 1 << 64))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place; the last k - 1 places hold less and are not used."""
    doubled, size = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while size * 2 <= k:
        h = doubled[size]
        doubled[size * 2] = h[:-size] * _powers(size) + h[size:]
        size *= 2
    out, done = None, 0
    for bit in sorted(doubled, reverse=True):
        if done + bit <= k:
            out = doubled[bit] if out is None else out[:len(data) - done - bit + 1] * _powers(bit) + doubled[bit][done:]
            done += bit
    return mixed(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


@dataclass
class Anchors:
    """Anchors of a batch of texts: the anchor's hash, and the run of places whose strings it stands for."""

    value: np.ndarray
    text: np.ndarray
    low: np.ndarray  # place of the first string in its text
    size: np.ndarray  # bytes from there to the end of the last string


def anchors(texts: list[bytes], length: int = LENGTH) -> Anchors:
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return Anchors(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    gram = min(GRAM, length)
    hashed = _grams(data, gram)
    # The hash in front, the place behind: the smallest is the leftmost of the smallest hashes.
    least = _sliding_least((hashed & ~PLACE) | np.arange(len(hashed), dtype=np.uint64), length - gram + 1)
    place = (least & PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(place)]
    inside = np.arange(len(place)) + length <= (begin + sizes)[owner]
    first = np.flatnonzero(inside & np.append(True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    last = np.flatnonzero(inside & np.append((place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | ~inside[1:], True))
    return Anchors(mixed(hashed[place[first]], 7), owner[first], first - begin[owner[first]], last - first + length)


def _runs(texts: list[bytes], most: int = BATCH) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about so many bytes; a longer text is a run of its own, cut so that no string is lost or met twice."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _chunk_anchors(texts: list[bytes], length: int) -> Anchors:
    """The anchors of all texts of a chunk, in their order."""
    parts = [anchors([], length)]
    for start, run in _runs(texts):
        # A very long text in pieces that overlap by a string less one byte.
        pieces = range(0, len(run[0]) - length + 1, 8 * BATCH) if len(run) == 1 and len(run[0]) > 8 * BATCH else None
        for at in pieces or [0]:
            found = anchors([run[0][at:at + 8 * BATCH + length - 1]] if pieces else run, length)
            found.text += start
            found.low += at
            parts.append(found)
    return Anchors(*(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Anchors)))


def _texts(rows: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in rows["text"]]


def _dealt(chunks: int):
    """A task's different texts by chunk, each with the ids of its copies."""
    def packed(held: dict[bytes, list[int]]) -> pd.DataFrame:
        texts, out = list(held), []
        for p, mine in _cut(np.array([xxhash.xxh3_64_intdigest(t) % chunks for t in texts], np.int64), chunks):
            own = [texts[i] for i in mine.tolist()]
            ids = [held[t] for t in own]
            out.append((p, _packed(np.array([len(t) for t in own]), np.array([len(i) for i in ids])), _packed(np.concatenate(ids)), pa.compress(b"".join(own), "zstd", asbytes=True)))
        return pd.DataFrame(out, columns=["p", "texts", "ids", "data"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = {}, 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), _texts(batch)):
                ids = held.setdefault(text, [])
                size += 40 if ids else len(text) + 200
                ids.append(doc_id)
                if size > HELD:
                    yield packed(held)
                    held, size = {}, 0
        if held:
            yield packed(held)
    return rows


def _documents(chunk: pd.DataFrame) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """A chunk's different texts, the ids of each and the least of them; by least id and text, so in any order of the rows."""
    held: dict[bytes, list[np.ndarray]] = {}
    for shape, ids, data in zip(chunk["texts"], chunk["ids"], chunk["data"]):
        sizes, copies = _unpacked(shape, 2)
        for text, own in zip(_pieces(data, sizes), np.split(_unpacked(ids, 1)[0], np.cumsum(copies)[:-1])):
            held.setdefault(text, []).append(own)
    own = {text: np.concatenate(ids) for text, ids in held.items()}
    least = {text: int(ids.min()) for text, ids in own.items()}
    texts = sorted(own, key=lambda t: (least[t], t))
    return texts, [own[t] for t in texts], np.array([least[t] for t in texts], np.int64)


def _bucket(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _codes(value: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and the bits that are sent of each hash."""
    return (_bucket(value, buckets).astype(np.uint64) << LOW) | (value & ((np.uint64(1) << LOW) - np.uint64(1)))


def _cut(order_key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(order_key, kind="stable")
    cuts = np.searchsorted(order_key[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b]:cuts[b + 1]]


def _lists(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the list of each bucket begins among sorted codes."""
    return np.searchsorted(codes, np.arange(buckets + 1, dtype=np.uint64) << LOW)


def _sent_hashes(buckets: int, length: int):
    """A chunk's anchor hashes by bucket; `twice` tells those that two of its texts have."""
    def rows(chunk: pd.DataFrame) -> pd.DataFrame:
        found = _chunk_anchors(_documents(chunk)[0], length)
        code = _codes(found.value, buckets)
        order = np.lexsort((found.text, code))
        owner = found.text[order]
        distinct, begin, count = np.unique(code[order], return_index=True, return_counts=True)
        twice = owner[begin] != owner[begin + count - 1]
        cuts, out = _lists(distinct, buckets), []
        for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            mine = slice(cuts[b], cuts[b + 1])
            out.append((b, int(chunk["p"].iloc[0]), _packed(_steps(distinct[mine] - (np.uint64(b) << LOW))), np.packbits(twice[mine]).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "p", "values", "twice"])
    return rows


def _answered(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk which hashes of its list two texts have, wherever they are."""
    values = [np.cumsum(_unpacked(v, 1)[0]) for v in rows["values"]]
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)).astype(bool) for t, v in zip(rows["twice"], values)])
    _, index, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = count > 1
    shared[index[twice]] = True
    keep, out, at = shared[index], [], 0
    for p, v in zip(rows["p"], values):
        mine = keep[at:at + len(v)]
        at += len(v)
        if mine.any():
            out.append((int(rows["bucket"].iloc[0]), int(p), np.packbits(mine).tobytes()))
    return pd.DataFrame(out, columns=["bucket", "p", "shared"])


def _sent_texts(buckets: int, length: int):
    """The text around each shared anchor of a chunk, by bucket; later copies within the chunk as removed places."""
    def rows(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: [] for c in SENT.split(", ")})
        if not len(chunk) or not len(answers):
            return empty
        texts, _, ids = _documents(chunk)
        found = _chunk_anchors(texts, length)
        distinct, index = np.unique(_codes(found.value, buckets), return_inverse=True)
        cuts, shared = _lists(distinct, buckets), np.zeros(len(distinct), bool)
        for b, bits in zip(answers["bucket"], answers["shared"]):
            shared[cuts[b]:cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[b + 1] - cuts[b])
        seen: dict[bytes, int] = {}
        anchor, around, local = [], [], []  # the anchors that are sent, the text around each, and those that are not
        asked = np.flatnonzero(shared[index])
        for i, t, low, size, doc_id in zip(*(x.tolist() for x in (asked, found.text[asked], found.low[asked], found.size[asked], ids[found.text[asked]]))):
            string = texts[t][low:low + size]
            if seen.setdefault(string, doc_id) == doc_id:
                anchor.append(i)
                around.append(string)
            else:
                local.append(i)
        p, out = int(chunk["p"].iloc[0]), []
        if local:
            out.append((int(mixed(np.array([p], np.uint64))[0] % np.uint64(buckets)), p, True, _packed(_steps(found.text[local]), found.low[local], found.size[local]), b""))
        anchor = np.array(anchor, np.int64)
        value, text = found.value[anchor], found.text[anchor]
        part = ((value >> np.uint64(32)) // np.uint64(buckets) % np.uint64(PARTS)).astype(np.int64)
        for b, mine in _cut(_bucket(value, buckets), buckets):
            numbers = _packed(_steps(text[mine]), _steps(ids[text[mine]]), found.low[anchor[mine]], found.size[anchor[mine]], part[mine])
            out.append((b, p, False, numbers, pa.compress(b"".join(map(around.__getitem__, mine.tolist())), "zstd", asbytes=True)))
        return pd.DataFrame(out, columns=empty.columns) if out else empty
    return rows


def previous_factors(texts: list[bytes], rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every string of `length` bytes in texts that also starts in a text of smaller rank.

    The suffixes are sorted by as many bytes. In that order the suffixes between two
    that agree in `length` bytes agree as well, so a suffix's longest previous factor
    is long enough if its previous or its next smaller rank lies in its own run of
    agreeing suffixes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    start = np.repeat(np.cumsum(sizes) - sizes, n) + place
    # Eight bytes at a time as one big-endian number; the last one starts where it ends with the string.
    eight = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | data[k:len(data) - 7 + k]
    offsets = [*range(0, length - 8, 8), max(length - 8, 0)]
    columns = [eight[start + o] for o in offsets] if length >= 8 else [eight[start] >> np.uint64(8 * (8 - length))]
    order = np.lexsort(columns[::-1])
    same = np.ones(max(len(order) - 1, 0), bool)
    for column in columns:
        same &= column[order][1:] == column[order][:-1]
    run = np.append(0, np.cumsum(~same)) if len(order) else np.zeros(0, np.int64)
    smaller = np.zeros(len(order), bool)
    top = int(rank.max(initial=0)) + 1
    for direction in (1, -1):
        ranks, runs = rank[text[order]][::direction], run[::direction]
        # Later runs lie below all earlier ones, so the least value so far is the least of the own run.
        falling = ranks - (np.abs(runs - runs[0]) if len(runs) else runs) * top
        before = np.minimum.accumulate(falling)
        smaller[::direction] |= before < falling
    found = order[smaller]
    return text[found], place[found]


def _spans(whole: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, size) of the removed runs of texts that come from documents with these ids."""
    number: dict[bytes, int] = {}
    kind = np.array([number.setdefault(t, len(number)) for t in whole], np.int64)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, ids)
    later = ids > least[kind]
    _, rank = np.unique(least, return_inverse=True)
    text, place = previous_factors(list(number), rank, length)
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    head = np.append(True, (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)) if len(text) else np.zeros(0, bool)
    tail = np.append(head[1:], True) if len(text) else head
    span_text, span_low, span_size = text[head], place[head], place[tail] - place[head] + length
    first, count = np.searchsorted(span_text, np.arange(len(number))), np.bincount(span_text, minlength=len(number))
    kept = np.flatnonzero(~later & (count[kind] > 0))
    each = np.repeat(kept, count[kind[kept]])
    span = np.arange(len(each)) - np.repeat(np.cumsum(count[kind[kept]]) - count[kind[kept]], count[kind[kept]]) + first[kind[each]]
    gone = np.flatnonzero(later)
    sizes = np.array([len(t) for t in whole], np.int64)
    return np.concatenate([gone, each]), np.concatenate([np.zeros(len(gone), np.int64), span_low[span]]), np.concatenate([sizes[gone], span_size[span]])


def _removed(length: int):
    """The removed places by chunk, from all texts of a bucket."""
    def rows(batch: pd.DataFrame) -> pd.DataFrame:
        local = batch[batch["local"]]
        out = list(zip(local["p"].tolist(), local["numbers"]))
        sent, taken = batch[~batch["local"]], [np.zeros((4, 0), np.int64)]
        columns = [_unpacked(x, 5) for x in sent["numbers"]]
        strings = [_pieces(x, size) for x, (_, _, _, size, _) in zip(sent["data"], columns)]
        for part in range(PARTS):
            whole, rest = [], [np.zeros((4, 0), np.int64)]  # chunk, text, id and place
            for p, (text, ids, low, _, parts), own in zip(sent["p"], columns, strings):
                mine = np.flatnonzero(parts == part)
                whole += map(own.__getitem__, mine.tolist())
                rest.append(np.stack([np.full(len(mine), p), np.cumsum(text)[mine], np.cumsum(ids)[mine], low[mine]]))
            p, text, ids, low = np.concatenate(rest, axis=1)
            if whole:
                who, place, size = _spans(whole, ids, length)
                taken.append(np.stack([p[who], text[who], low[who] + place, size]))
        p, text, low, size = np.concatenate(taken, axis=1)
        order = np.lexsort((low, text, p))
        chunks, begin = np.unique(p[order], return_index=True)
        for chunk, mine in zip(chunks.tolist(), np.split(order, begin[1:])):
            out.append((chunk, _packed(_steps(text[mine]), low[mine], size[mine])))
        return pd.DataFrame(out, columns=["p", "numbers"])
    return rows


def _cut_texts(length: int):
    """Every document of a chunk without its removed places; later copies of a text have none of it left."""
    def rows(chunk: pd.DataFrame, removed: pd.DataFrame) -> pd.DataFrame:
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(removed):
            text, low, size = np.concatenate([np.concatenate([np.cumsum(n[:1], axis=1), n[1:]]) for n in (_unpacked(x, 3) for x in removed["numbers"])], axis=1)
            order = np.lexsort((low, text))
            for t, begin, size in zip(text[order].tolist(), low[order].tolist(), size[order].tolist()):
                own = spans.setdefault(t, [])
                if own and begin <= own[-1][1]:
                    own[-1] = (own[-1][0], max(own[-1][1], begin + size))
                else:
                    own.append((begin, begin + size))
        out: list[list] = [[], [], [], []]
        doc_ids = [np.zeros(0, np.int64)]
        for t, (text, ids, least) in enumerate(zip(*_documents(chunk))) if len(chunk) else []:
            own, at, kept = spans.get(t, []), 0, []
            for low, high in own:
                kept.append(text[at:low])
                at = high
            kept.append(text[at:])
            first, later = (len(text), sum(b - a for a, b in own), len(own), b"".join(kept)), (len(text), len(text), 1, b"")
            if len(text) < length:
                later = first
            doc_ids.append(np.sort(ids))
            firsts = int((ids == least).sum())
            for column, a, b in zip(out, first, later):
                column += [a] * firsts + [b] * (len(ids) - firsts)
        return pd.DataFrame(dict(zip(["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], [np.concatenate(doc_ids), *out])))
    return rows


def without_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans and the remaining bytes, `kept`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chunks = partitions_for(spark, 4 * docs.rdd.getNumPartitions(), 1)
    buckets = partitions_for(spark, chunks, PARTS)
    dealt = rows.filter("doc_id IS NOT NULL").mapInPandas(_dealt(chunks), DEALT).repartition(chunks, "p")
    by_chunk = dealt.groupBy("p")
    hashes = by_chunk.applyInPandas(_sent_hashes(buckets, length), "bucket int, p int, values binary, twice binary")
    shared = hashes.groupBy("bucket").applyInPandas(_answered, "bucket int, p int, shared binary")
    texts = by_chunk.cogroup(shared.groupBy("p")).applyInPandas(_sent_texts(buckets, length), SENT)
    removed = texts.groupBy("bucket").applyInPandas(_removed(length), "p int, numbers binary")
    result = by_chunk.cogroup(removed.groupBy("p")).applyInPandas(_cut_texts(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = rows.filter("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                                                 F.col("text").cast("binary").alias("kept"))
    return result.unionByName(whole)
