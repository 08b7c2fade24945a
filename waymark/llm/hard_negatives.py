"""Hard negatives of anchors by slot-decomposed selection.

An anchor's score of a row is the inner product of their vectors, each component times
`scale` and rounded down. Its positives are the best rows of its own label. A positive of
score p allows negatives, rows of another label, of scores from `low` to `high` percent of
p. The windows of one anchor overlap, so none is searched by itself: the upper limits of
its positives split the scores into disjoint slots, from one limit (inclusive) down to the
next. A task keeps the best few rows of each anchor and slot over all blocks it sees, the
tasks' rows are cut to the best few of each anchor and slot again, and a positive's
negatives are the first of the slots from its own limit downwards, put behind one another
(slots in descending order are in order of score), as far as the lower limit allows.

Anchors are a stated set of queries that meets all rows: blocks of vectors are multiplied
with blocks of anchors, where the anchors are few enough on each executor, else in cells
of a grid of row and anchor blocks, so a task never holds more than a block of each and
what it keeps for the anchors that it has met.

Higher scores come first, then smaller ids, null ids last, then an order fixed for a run.
Rows with a null label, a null vector or a null or non-finite component take no part;
vectors score those of their own length only. Every row counts, also under a repeated id:
a row isn't its own positive, but another row of the same id can be. Products are exact;
those beyond 64 bits count as the nearest 64-bit number. Other columns are ignored, empty
tables and anchors without positives or negatives give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.tables import broadcastable, written
from waymark.session import spread

BLOCK, ANCHORS = 2048, 512  # rows and anchors of a block
CELL = 64                   # row blocks of a cell of the grid
NONE, LOWEST, HIGHEST = (1 << 63) - 1, -(1 << 63), (1 << 63) - 1


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length in order of (id, key), numbered by task and place."""
    task, number = TaskContext.get().partitionId(), 0
    waiting: dict[int, list[pd.DataFrame]] = {}

    def block(parts: list[pd.DataFrame]) -> pa.RecordBatch:
        nonlocal number
        part = pd.concat(parts).sort_values(["id", "key"], na_position="last")
        number += 1
        out = {"block": [(task << 32) + number], "keys": [part["key"].to_numpy(np.int64).tobytes()], "ids": [part["id"].fillna(NONE).to_numpy(np.int64).tobytes()],
               "nones": [part["id"].isna().to_numpy().tobytes()], "labels": [part["label"].tolist()], "data": [np.concatenate([*part["v"], np.zeros(0)]).astype(np.float64).tobytes()],
               "uppers": [part["uppers"].tolist()], "least": [part["least"].to_numpy(np.int64).tobytes()]}
        schema = pa.schema([("size", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("nones", pa.binary()), ("labels", pa.list_(pa.string())),
                            ("data", pa.binary()), ("uppers", pa.list_(pa.list_(pa.int64()))), ("least", pa.binary())])
        return pa.RecordBatch.from_pydict({"size": [len(part["v"].iloc[0])]} | out, schema)

    for batch in batches:
        part = batch.to_pandas(integer_object_nulls=True).astype({"id": "Int64"})
        for size, same in part.groupby(part["v"].map(len)):
            kept = waiting.setdefault(size, [])
            kept.append(same)
            if sum(map(len, kept)) >= rows:
                together = pd.concat(kept)
                whole = len(together) - len(together) % rows
                for at in range(0, whole, rows):
                    yield block([together.iloc[at:at + rows]])
                waiting[size] = [together.iloc[whole:]]
    for kept in waiting.values():
        if sum(map(len, kept)):
            yield block(kept)


BLOCKS = "size int, block long, keys binary, ids binary, nones binary, labels array<string>, data binary, uppers array<array<long>>, least binary"


def _blocked(rows: DataFrame, size: int, name: str) -> DataFrame:
    return written(rows.mapInArrow(lambda batches: _blocks(batches, size), BLOCKS), name)


def _met(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors of the same length."""
    ours = rows.select("size", *[F.col(c).alias(f"r_{c}") for c in ("block", "keys", "ids", "nones", "labels", "data")])
    theirs = anchors.select("size", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c != "size"])
    if broadcastable(anchors):
        return spread(ours).join(F.broadcast(theirs), "size")
    across, down = max(1, anchors.count()), max(1, -(-rows.count() // CELL))
    place = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = ours.withColumn("h", place("r_block", down)).withColumn("g", every(across))
    theirs = theirs.withColumn("g", place("a_block", across)).withColumn("h", every(down))
    return ours.join(theirs, ["size", "g", "h"]).drop("g", "h")


def _scores(anchors: np.ndarray, rows: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of the scaled, rounded components as 64-bit integers."""
    with np.errstate(over="ignore"):
        a, r = np.floor(anchors * scale), np.floor(rows * scale)
        bound = anchors.shape[1] * np.abs(a).max(initial=0) * np.abs(r).max(initial=0)
    if bound < 1 << 53:
        return np.rint(a @ r.T).astype(np.int64)
    exact = [np.array([[math.floor(x * scale) if abs(x) < 1 << 60 else int(x) * scale for x in v] for v in m.tolist()], object).reshape(m.shape) for m in (anchors, rows)]
    products = exact[0] @ exact[1].T
    return np.array([[min(max(int(x), LOWEST + 1), HIGHEST) for x in row] for row in products.tolist()], np.int64).reshape(products.shape)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k best allowed scores of each row, earlier columns first among equals, and which of them are there."""
    n = scores.shape[1]
    k = min(k, n)
    if np.abs(scores).max(initial=0) < (1 << 61) // max(n, 1):
        ranks = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), LOWEST)
        columns = np.argpartition(ranks, n - k, axis=1)[:, n - k:] if k < n else np.broadcast_to(np.arange(n), scores.shape)
    else:
        columns = np.argsort(np.where(allowed, -scores, HIGHEST), axis=1, kind="stable")[:, :k]
    return columns, np.take_along_axis(allowed, columns, 1)


class Best:
    """The best k rows seen for each anchor of a block."""

    def __init__(self, anchors: int, k: int):
        self.k = k
        self.there = np.zeros((anchors, 0), bool)
        self.score, self.id, self.key = (np.zeros((anchors, 0), np.int64) for _ in range(3))
        self.none = np.zeros((anchors, 0), bool)

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, nones: np.ndarray, keys: np.ndarray) -> None:
        columns, there = _best(scores, allowed, self.k)
        if not there.any():
            return
        both = [np.concatenate(x, axis=1) for x in ((self.there, there), (self.score, np.take_along_axis(scores, columns, 1)), (self.none, nones[columns]),
                                                    (self.id, ids[columns]), (self.key, keys[columns]))]
        order = np.lexsort((both[4], both[3], both[2], -both[1], ~both[0]), axis=-1)[:, :self.k]
        self.there, self.score, self.none, self.id, self.key = (np.take_along_axis(x, order, 1) for x in both)

    def rows(self, anchors: np.ndarray) -> dict[str, np.ndarray]:
        at, _ = np.nonzero(self.there)
        ids = pd.array(self.id[self.there], "Int64")
        ids[self.none[self.there]] = pd.NA
        return {"anchor": anchors[at], "score": self.score[self.there], "id": ids, "key": self.key[self.there]}


def _numbers(row: dict, side: str) -> tuple[np.ndarray, ...]:
    keys, ids, nones = (np.frombuffer(row[f"{side}_{c}"], t) for c, t in (("keys", np.int64), ("ids", np.int64), ("nones", bool)))
    return keys, ids, nones, np.frombuffer(row[f"{side}_data"]).reshape(len(keys), row["size"])


def _selected(batches: Iterator[pa.RecordBatch], scale: int, slots: int, keep: Callable[[dict, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """The best k rows of each anchor and slot over all pairs of blocks of a task."""
    kept: dict[int, tuple[np.ndarray, list[Best]]] = {}
    for batch in batches:
        for at in range(len(batch)):
            row = {c: batch.column(c)[at] for c in batch.schema.names}
            row = {c: x.as_buffer() if pa.types.is_binary(x.type) else x.as_py() for c, x in row.items()}
            keys, ids, nones, data = _numbers(row, "r")
            own, _, _, anchors = _numbers(row, "a")
            scores = _scores(anchors, data, scale)
            codes, _ = pd.factorize(np.array([*row["a_labels"], *row["r_labels"]], object))
            same = codes[:len(own), None] == codes[None, len(own):]
            _, best = kept.setdefault(row["a_block"], (own, [Best(len(own), k) for _ in range(slots)]))
            for slot in range(slots):
                best[slot].add(scores, keep(row, scores, same, own[:, None] != keys, slot), ids, nones, keys)
    schema = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("key", pa.int64())])
    for own, best in kept.values():
        for slot, found in enumerate(best):
            rows = found.rows(own)
            yield pa.RecordBatch.from_arrays([pa.array(rows["anchor"]), pa.array(np.full(len(rows["key"]), slot, np.int32)), pa.array(rows["score"]),
                                              pa.array(rows["id"], pa.int64()), pa.array(rows["key"])], schema=schema)


def _same_label(row: dict, scores: np.ndarray, same: np.ndarray, other: np.ndarray, slot: int) -> np.ndarray:
    return same & other


def _in_slot(row: dict, scores: np.ndarray, same: np.ndarray, other: np.ndarray, slot: int) -> np.ndarray:
    """Rows of another label between an anchor's limit of this number and its next one, not below all its windows."""
    uppers = [[*u, *[LOWEST] * (slot + 2)] for u in row["a_uppers"]]
    upper, below = (np.array([u[s] for u in uppers], np.int64)[:, None] for s in (slot, slot + 1))
    return ~same & (scores <= upper) & (scores > below) & (scores >= np.frombuffer(row["a_least"], np.int64)[:, None])


SELECTED = "anchor long, slot int, score long, id long, key long"


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "key")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the negatives of each positive of the rows of which `anchor` holds."""
    spark = vectors.sparkSession
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"),
                           F.col(f"`{vector}`").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
            .filter(good & F.col("label").isNotNull()).withColumn("key", F.monotonically_increasing_id()))
    rows = written(rows, "mined-vectors").withColumn("uppers", F.expr("cast(array() as array<long>)")).withColumn("least", F.lit(0).cast("long"))
    columns = ["id", "label", "v", "key", "uppers", "least"]
    asked = rows.filter("anchor").select(*columns)
    blocks = _blocked(spread(rows.select(*columns)), block, "mined-blocks")

    met = _met(blocks, _blocked(asked, anchors, "anchor-blocks"))
    found = met.mapInArrow(lambda batches: _selected(batches, scale, 1, _same_label, positives), SELECTED)
    best = written(_first(found, ["anchor"], positives).select("anchor", F.col("id").alias("positive_id"), F.col("key").alias("positive"), F.col("score").alias("positive_score")), "positives")

    limit = lambda percent, up: F.expr(f"{'-' * up}floor(({'-' * up}{percent} * cast(positive_score as decimal(38, 0))) / 100)").cast("long")
    limited = best.withColumn("upper", limit(high, False)).withColumn("lower", limit(low, True))
    slots = limited.groupBy(F.col("anchor").alias("key")).agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("uppers"), F.min("lower").alias("least"))
    placed = asked.drop("uppers", "least").join(slots, "key").select(*columns)
    met = _met(blocks, _blocked(placed, anchors, "placed-blocks"))
    found = met.mapInArrow(lambda batches: _selected(batches, scale, positives, _in_slot, negatives), SELECTED)
    top = _first(found, ["anchor", "slot"], negatives)

    # The slots of one anchor, behind one another from the highest down: at most positives * negatives rows.
    entry = F.struct((-F.col("score")).alias("down"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key"), F.col("slot"))
    runs = top.groupBy("anchor").agg(F.array_sort(F.collect_list(entry)).alias("run"))
    kept = F.slice(F.filter("run", lambda x: (-x["down"] <= F.col("upper")) & (-x["down"] >= F.col("lower"))), 1, negatives)
    named = rows.filter("anchor").select(F.col("key").alias("anchor"), F.col("id").alias("anchor_id"))
    answered = limited.join(runs, "anchor").withColumn("kept", kept).join(named, "anchor")
    return (answered.select("anchor_id", "positive_id", "positive_score", F.posexplode("kept"))
            .select("anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("col.id").alias("negative_id"), "positive_score", (-F.col("col.down")).alias("negative_score")))
