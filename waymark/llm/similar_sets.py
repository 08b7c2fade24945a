"""Jaccard join of word-shingle sets by PartEnum signatures, down to linked groups.

Two sets of sizes r and s with a Jaccard similarity of at least g differ in at most
k = 2 (1-g)/(1+g) max(r, s) elements. Sizes are cut into bands so that similar sets
lie in one band or two neighbours; each set takes part in the instance of its own band
and the next. An instance deals the feature domain to n1 groups of n2 parts by a hash
and enumerates the subsets of n2 - k2 parts in each group: one signature for each.
With n1 (k2 + 1) > k some group has at most k2 differing parts, so two similar sets
share a signature. Parts of few elements would make signatures that many unlike sets
share. The instance therefore has spare groups, so that similar sets agree in one group
more than there are spare ones. Each set leaves out its signatures of t elements or
fewer, for the largest t that concerns no more groups than are spare: the set with the
larger t of a similar pair has a group left in which they agree, and the other keeps
that signature too.

Sets that share a signature are compared by sketches first: one byte for each of a
power-of-two number of parts, the sum of the elements' hashes. Parts that differ are
at most as many as elements that differ, so a pair above k is no link. The remaining
pairs of a group are verified on whole texts, surest first and only while they join
two components, so a group of near copies yields a few pairs for each member, not all;
groups with pairs left to test go another round, until no untested pair could join two
components. No pair that counts is dropped: groups above `BLOCK` members are compared
block by block.

Results by case: null texts and texts without words have an empty set, linked with
nothing; equal sets are linked whatever their ids; rows of one doc_id are one
document; a null doc_id is linked with nothing and has a null component. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waymark.llm.components import Forest, components
from waymark.llm.shingles import mixed, shingle_sets
from waymark.llm.tables import lookup, partitions_for, written

N2, K2 = 2, 1
WEAK, SPARE = 5, 0.2
# Members of a group that are compared at once; pairs tested for one join of two components in the first round, then 16 times as many.
BLOCK, TRIES = 1000, 16
BATCH = 250


def bands(similarity: float, top: int = 1 << 40) -> np.ndarray:
    """The largest size of each band: a set and one 1/similarity times as large are at most one band apart."""
    ends, low = [], 1
    while low < top:
        ends.append(int(low / similarity + 1e-9))
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def differences(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Elements in which two sets, the larger of this size, may differ at most."""
    return np.floor(2 * (1 - similarity) / (1 + similarity) * sizes + 1e-9).astype(np.int64)


def signatures(sizes: np.ndarray, elements: np.ndarray, similarity: float, step: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of the instance `step` bands above each set's own; elements holds the sets one after another."""
    instance = np.searchsorted(ends, sizes) + step
    k = differences(ends[instance], similarity)
    choices = list(combinations(range(N2), N2 - K2))
    need = -(-(k + 1) // (K2 + 1))
    spare = np.ceil(SPARE * need).astype(np.int64) + 1
    groups = np.where(sizes > 0, need + spare, 0)
    parts = groups * N2
    owner, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(parts) - parts
    part = first[owner] + (mixed(elements, 5) % parts[owner].astype(np.uint64)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    filled, begin = np.unique(part[order], return_index=True)
    total, count = np.zeros(parts.sum(), np.uint64), np.bincount(part, minlength=parts.sum())
    if len(filled):
        total[filled] = np.add.reduceat(mixed(elements[order], 9), begin)
    total, count = total.reshape(-1, N2), count.reshape(-1, N2)
    group_owner = np.repeat(np.arange(len(sizes)), groups)
    group = np.arange(len(group_owner)) - np.repeat(np.cumsum(groups) - groups, groups)
    base = mixed(group.astype(np.uint64), 1) + mixed(instance[group_owner].astype(np.uint64), 3)
    found, held = [], []
    for n, choice in enumerate(choices):
        value = mixed(base, 10 + n)
        for c in choice:
            value = mixed(value + total[:, c], 4)
        found.append(value)
        held.append(count[:, list(choice)].sum(1))
    least, most_weak = np.minimum.reduce(held), np.full(len(sizes), -1)
    for t in range(WEAK):
        most_weak[np.bincount(group_owner[least <= t], minlength=len(sizes)) <= spare] = t
    owners, found = np.tile(group_owner, len(choices)), np.concatenate(found)
    keep = np.concatenate(held) > most_weak[owners]
    return owners[keep], found[keep]


def sketch(elements: np.ndarray, similarity: float) -> bytes:
    """One byte for each of 2^j parts; sketches of two lengths compare after the longer one is folded."""
    parts = 1 << int(np.ceil(np.log2(2 * differences(np.array(len(elements)), similarity) + 8)))
    hashed = mixed(elements, 21)
    sums = np.bincount((hashed % np.uint64(parts)).astype(np.int64), weights=((hashed >> np.uint64(40)) & np.uint64(255)).astype(float), minlength=parts)
    return (sums.astype(np.int64) & 255).astype(np.uint8).tobytes()


def _described(similarity: float, width: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), BATCH):
                part = rows.iloc[at:at + BATCH]
                sizes, sets = shingle_sets(part["text"].tolist(), width)
                each = np.split(sets, np.cumsum(sizes)[:-1])
                sums = [[int(np.add.reduce(mixed(x, s))) - (1 << 63) if len(x) else 0 for x in each] for s in (31, 32)]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n": sizes, "h1": sums[0], "h2": sums[1], "sketch": [sketch(x, similarity) if len(x) else b"" for x in each]})
    return rows


def _packed(similarity: float, width: int, buckets: int):
    """Signatures by bucket: the ids of a batch's documents, each signature's document among them, the signatures."""
    ends = bands(similarity)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # equal sets of one task are sent once
        for rows in batches:
            for at in range(0, len(rows), BATCH):
                part = rows.iloc[at:at + BATCH]
                sizes, sets = shingle_sets(part["text"].tolist(), width)
                each = np.split(sets, np.cumsum(sizes)[:-1])
                keys = [(int(np.add.reduce(mixed(x, 31))), int(np.add.reduce(mixed(x, 32)))) if len(x) else None for x in each]
                new = []
                for i, key in enumerate(keys):
                    if key is not None and key not in seen:
                        seen.add(key)
                        new.append(i)
                if len(seen) > 100_000:
                    seen.clear()
                if not new:
                    continue
                ids, sizes, sets = part["doc_id"].to_numpy(np.int64)[new], sizes[new], np.concatenate([each[i] for i in new])
                found = [signatures(sizes, sets, similarity, step, ends) for step in (0, 1)]
                owner, value = (np.concatenate(x) for x in zip(*found))
                bucket = (value >> np.uint64(40)) % np.uint64(buckets)
                order = np.lexsort((owner, bucket))
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = []
                for b in range(buckets):
                    mine = order[cuts[b]:cuts[b + 1]]
                    if len(mine):
                        holders, place = np.unique(owner[mine], return_inverse=True)
                        out.append((b, ids[holders].tobytes(), place.astype(np.uint16).tobytes(), value[mine].tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "ids", "place", "value"])
    return rows


def _groups(rows: pd.DataFrame) -> pd.DataFrame:
    """The groups of documents that share a signature, each set of documents once."""
    ids = np.concatenate([np.frombuffer(i, np.int64)[np.frombuffer(p, np.uint16)] for i, p in zip(rows["ids"], rows["place"])])
    value = np.concatenate([np.frombuffer(v, np.uint64) for v in rows["value"]])
    order = np.lexsort((ids, value))
    ids, value = ids[order], value[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (ids[1:] != ids[:-1])
    ids, value = ids[fresh], value[fresh]
    begin = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    count = np.diff(np.append(begin, len(ids)))
    many = np.repeat(count > 1, count)
    if not many.any():
        return pd.DataFrame({"group": [], "leader": [], "doc_id": [], "place": [], "members": []}, dtype="int64")
    ids, count = ids[many], count[count > 1]
    begin = np.cumsum(count) - count
    name = mixed(np.add.reduceat(mixed(ids.astype(np.uint64), 41), begin) + count.astype(np.uint64), 42)
    _, first = np.unique(name, return_index=True)
    keep = np.isin(np.arange(len(count)), first)
    all_of = np.repeat(keep, count)
    place = np.arange(len(ids)) - np.repeat(begin, count)
    return pd.DataFrame({"group": np.repeat(name, count)[all_of].astype(np.int64), "leader": np.repeat(ids[begin], count)[all_of], "doc_id": ids[all_of], "place": place[all_of], "members": np.repeat(count, count)[all_of]})


def _folded(data: bytes, parts: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(-1, parts).sum(0, dtype=np.uint8)


class Plan:
    """The pairs that one task of a round tests: what joins two components, surest first in each group, and some more for each join."""

    def __init__(self, similarity: float, most: int):
        self.similarity, self.most = similarity, most
        self.forest, self.tries, self.pairs = Forest(), {}, {}

    def add(self, rows: pd.DataFrame) -> bool:
        """Take the pairs of a group; whether it has any untested pair that may link two components."""
        ids, n, component = (rows[c].to_numpy(np.int64) for c in ("doc_id", "n", "component"))
        tested = {i: set(t) for i, t in zip(ids.tolist(), rows["tested"]) if t is not None and len(t)}
        block = rows["place"].to_numpy(np.int64) // BLOCK
        parts = min(map(len, rows["sketch"]))
        data = np.stack([_folded(x, parts) for x in rows["sketch"]])
        one, two, far = [], [], []
        across = rows["low"].iloc[0] != rows["high"].iloc[0]
        for i in range(len(ids) - 1):
            limit = (n[i] + n[i + 1:]) * (1 - self.similarity) / (1 + self.similarity) + 1e-9
            apart = (data[i] != data[i + 1:]).sum(1)
            likely = (apart <= limit) & (component[i] != component[i + 1:]) & (np.abs(n[i] - n[i + 1:]) <= limit)
            if across:
                likely &= block[i] != block[i + 1:]
            for j in np.flatnonzero(likely) + i + 1:
                if ids[j] not in tested.get(ids[i], ()):
                    one.append(i)
                    two.append(j)
                    far.append(apart[j - i - 1] / max(limit[j - i - 1], 1))
        for e in np.argsort(far, kind="stable"):
            pair = int(ids[one[e]]), int(ids[two[e]])
            if pair in self.pairs:
                continue
            a, b = sorted((int(component[one[e]]), int(component[two[e]])))
            if self.forest.join(a, b):
                self.tries[a, b] = 1
            elif 0 < self.tries.get((a, b), 0) < self.most:
                self.tries[a, b] += 1
            else:
                continue
            self.pairs[pair] = None
        return bool(one)


def _likely(similarity: float, tries: int):
    """Rows of pairs (a, b), and of groups (group, low, high) that must be looked at again when these are judged."""
    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["leader", "group", "low", "high", "doc_id"], ignore_index=True)
        key = rows[["group", "low", "high"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(rows)]
        plan = Plan(similarity, tries)
        again = [tuple(key[a].tolist()) for a, b in zip(cuts, cuts[1:]) if b - a > 1 and plan.add(rows.iloc[a:b])]
        out = [(True, 0, 0, 0, a, b) for a, b in plan.pairs] + [(False, *k, 0, 0) for k in again]
        return pd.DataFrame(out, columns=["pair", "group", "low", "high", "a", "b"]).astype({"pair": "bool"} | dict.fromkeys(["group", "low", "high", "a", "b"], "int64"))
    return pairs


def _verified(similarity: float, width: int):
    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = round(similarity * 100)
        for rows in batches:
            good = []
            for at in range(0, len(rows), BATCH):
                part = rows.iloc[at:at + BATCH]
                sizes, sets = shingle_sets(part["text_a"].tolist() + part["text_b"].tolist(), width)
                each = np.split(sets, np.cumsum(sizes)[:-1])
                for a, b in zip(each[:len(part)], each[len(part):]):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(both > 0 and 100 * both >= whole * (len(a) + len(b) - both))
            yield rows[["a", "b"]].assign(linked=np.array(good, bool))
    return links


def linked_groups(docs: DataFrame, similarity: float = 0.85, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (the size of its set), component_id (the smallest doc_id reachable by links).

    similarity counts in whole hundredths.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    info = written(rows.mapInPandas(_described(similarity, width), "doc_id long, n long, h1 long, h2 long, sketch binary"), "set-info")
    # Equal sets are one class, compared through its smallest id; rows of one document tie their classes.
    equal = ["n", "h1", "h2"]
    classes = lookup(written(info.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*equal).agg(F.min("doc_id").alias("first")), "set-classes"))
    member = info.filter("doc_id IS NOT NULL").select("doc_id", *equal).join(classes, equal)
    least = member.groupBy("doc_id").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most")
    edges = written(member.join(least, "doc_id").select(F.col("first").alias("a"), F.col("least").alias("b")), "set-ties")
    copies = lookup(written(member.filter("doc_id <> first").select(F.col("doc_id").alias("copy")).distinct()
                            .join(classes.select(F.col("first").alias("copy")), "copy", "left_anti"), "set-copies"))
    firsts = rows.filter("doc_id IS NOT NULL").join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    buckets = partitions_for(spark, docs.rdd.getNumPartitions(), 1)
    packed = firsts.mapInPandas(_packed(similarity, width, buckets), "bucket int, ids binary, place binary, value binary")
    groups = packed.groupBy("bucket").applyInPandas(_groups, "group long, leader long, doc_id long, place long, members long").distinct()
    mine, last = F.floor(F.col("place") / BLOCK), F.floor((F.col("members") - 1) / BLOCK)
    grouped = written(groups.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
                      .select("group", "leader", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"), "doc_id", "place"), "set-groups")
    sketches = info.filter("n > 0").select("doc_id", "n", "sketch").distinct()
    tested, tries = None, TRIES
    parts = components(edges)
    while True:
        state = grouped.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        if tested is None:
            state = state.withColumn("tested", F.array().cast("array<long>"))
        else:
            state = state.join(tested.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list("b").alias("tested")), "doc_id", "left")
        # The groups of one leader meet in one task: at most as many as it has signatures.
        dealt = state.join(sketches, "doc_id").withColumn("bucket", F.pmod(F.xxhash64("leader", "low", "high"), F.lit(buckets)))
        likely = written(dealt.groupBy("bucket").applyInPandas(_likely(similarity, tries), "pair boolean, group long, low long, high long, a long, b long"), "set-likely")
        pairs = written(likely.filter("pair").select("a", "b").distinct(), "set-pairs")
        if pairs.isEmpty():
            break
        needed = lookup(written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "set-needed"))
        texts = written(rows.join(needed, F.col("doc_id") == F.col("id")).select("id", "text").distinct(), "set-texts")
        left = pairs.join(texts.toDF("a", "text_a"), "a")
        both = left.join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
        judged = written(both.mapInPandas(_verified(similarity, width), "a long, b long, linked boolean"), "set-links")
        edges = edges.unionByName(judged.filter("linked").select("a", "b"))
        parts = components(edges)
        tested = judged.select("a", "b") if tested is None else tested.unionByName(judged.select("a", "b"))
        again = lookup(written(likely.filter("NOT pair").select("group", "low", "high"), "set-again"))
        grouped, tries = written(grouped.join(again, ["group", "low", "high"]), "set-groups"), tries * 16
    known = info.select("doc_id", *equal).join(classes, equal, "left").join(parts.withColumnRenamed("node", "first"), "first", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first", "doc_id"))
    return known.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def first_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their linked group, with the columns of docs; rows with a null id stay."""
    groups = linked_groups(docs, similarity, width, doc_id, text).filter("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    return docs.join(groups, F.col(f"`{doc_id}`") == F.col("copy_id"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
