"""Cosine links between vectors by an epsilon grid order join.

Unit vectors of a cosine of at least t lie within eps = sqrt(2 - 2t) of each other.
They are turned onto their principal directions, which keeps distances, and sorted by
their cells of width eps on the leading ones: dimension by dimension, an order in
which near vectors come close. The sequence is cut into blocks. Two blocks are joined
only where the boxes of their leading coordinates come within eps; inside a task
the same test halves intervals of the sequence recursively, so that only leaves of a
few vectors are compared, by exact cosines in double precision. Everything that is
skipped is provably farther apart.

Each length of vectors is joined by itself. Lengths that fill a block get directions and
an order of their own; all vectors of a rarer length fit into one block, whose leading
coordinates are the vector's first.

Equal vectors are one class and compared once. A joined pair of blocks yields counts
and a spanning forest of its links, never all links of a dense group.

Vectors that are null, empty, zero or hold a null or a number that isn't finite link
with nothing, and vectors link with those of their own length only. Ties at the threshold
link. Each row counts, also under a repeated or null id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.components import Forest, components
from waymark.llm.sums import partition_sums
from waymark.llm.tables import lookup, written

# Leading directions; vectors of a block and of a leaf; components of a block.
LEAD, BLOCK, LEAF, NUMBERS = 8, 16384, 128, 1 << 20
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector has numbers only, all finite and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(classes: DataFrame, size: int, lead: int) -> np.ndarray:
    def squares(total: np.ndarray, rows: pd.DataFrame) -> None:
        x = _units(rows["v"])
        total[:size] += x.T @ x
        total[size] += x.sum(0)
        total[size + 1] += len(x)

    sums = partition_sums(classes, (size + 2, size), squares)
    count = max(sums[size + 1, 0], 1)
    mean = sums[size] / count
    _, vectors = np.linalg.eigh(sums[:size] / count - np.outer(mean, mean))
    return vectors[:, ::-1][:, :lead]


def _gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """The squared distance of boxes."""
    return (np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0) ** 2).sum(-1)


class Interval:
    """A run of the sequence with the box of its leading coordinates, halved down to leaves."""

    def __init__(self, lead: np.ndarray, begin: int, end: int):
        self.begin, self.end, self.halves = begin, end, ()
        if end - begin > LEAF:
            middle = (begin + end) // 2
            self.halves = (Interval(lead, begin, middle), Interval(lead, middle, end))
            one, two = self.halves
            self.low, self.high = np.minimum(one.low, two.low), np.maximum(one.high, two.high)
        else:
            self.low, self.high = lead[begin:end].min(0), lead[begin:end].max(0)


def _leaves(a: Interval, b: Interval, eps: float, same: bool) -> Iterator[tuple[Interval, Interval]]:
    """The pairs of leaves that come within eps; same: a and b lie in one sequence, a not after b."""
    if _gap(a.low, a.high, b.low, b.high) > (eps + SLACK) ** 2:
        return
    if not a.halves and not b.halves:
        yield a, b
    elif same and a is b:
        yield from _leaves(a.halves[0], a.halves[0], eps, True)
        yield from _leaves(a.halves[0], a.halves[1], eps, True)
        yield from _leaves(a.halves[1], a.halves[1], eps, True)
    elif a.halves and (not b.halves or a.end - a.begin >= b.end - b.begin):
        for half in a.halves:
            yield from _leaves(half, b, eps, same)
    else:
        for half in b.halves:
            yield from _leaves(a, half, eps, same)


class Block:
    def __init__(self, row: dict, size: int):
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.x = np.frombuffer(row["units"]).reshape(-1, size)
        self.top = Interval(np.frombuffer(row["lead"]).reshape(len(self.keys), -1), 0, len(self.keys))


def _stars(near: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links of a leaf pair: (row, column) entries that connect what the whole matrix connects."""
    edges, rows = [], np.ones(near.shape[0], bool)
    for start in np.flatnonzero(near.any(1)):
        if not rows[start]:
            continue
        columns, new_rows = np.zeros(near.shape[1], bool), [start]
        rows[start] = False
        while new_rows:
            row = new_rows.pop()
            for column in np.flatnonzero(near[row] & ~columns):
                columns[column] = True
                edges.append((row, column))
                for other in np.flatnonzero(near[:, column] & rows):
                    rows[other] = False
                    edges.append((other, column))
                    new_rows.append(other)
    return edges


def _pair(row: dict, threshold: float, eps: float) -> tuple[dict, Forest]:
    same, size = row["i"] == row["j"], row["size"]
    first = Block({c: row[f"a_{c}"] for c in ("keys", "counts", "units", "lead")}, size)
    second = first if same else Block({c: row[f"b_{c}"] for c in ("keys", "counts", "units", "lead")}, size)
    links = [np.zeros(len(first.keys), np.int64), np.zeros(len(second.keys), np.int64)]
    forest = Forest()
    for a, b in _leaves(first.top, second.top, eps, same):
        near = first.x[a.begin:a.end] @ second.x[b.begin:b.end].T >= threshold
        if same and a is b:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        links[0][a.begin:a.end] += near @ second.counts[b.begin:b.end]
        if not (same and a is b):
            links[1][b.begin:b.end] += first.counts[a.begin:a.end] @ near
        forest.add((int(first.keys[a.begin + r]), int(second.keys[b.begin + c])) for r, c in _stars(near))
    total: dict[int, int] = {}
    for block, found in zip((first, second), links):
        for i in np.flatnonzero(found):
            total[int(block.keys[i])] = total.get(int(block.keys[i]), 0) + int(found[i])
    return total, forest


def _links(threshold: float, eps: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                total, forest = _pair(row, threshold, eps)
                nodes, roots = forest.stars()
                yield pd.DataFrame({"a": [*total, *nodes], "b": [*[-1] * len(total), *roots], "links": [*total.values(), *[0] * len(nodes)]}, dtype="int64")
    return rows


BLOCKS = "size int, block long, low array<double>, high array<double>, keys binary, counts binary, units binary, lead binary"


def _block(part: pd.DataFrame, number: int, turn: np.ndarray) -> pd.DataFrame:
    x = _units(part["v"])
    lead = np.ascontiguousarray(x @ turn)
    return pd.DataFrame({"size": [x.shape[1]], "block": [number], "low": [lead.min(0)], "high": [lead.max(0)], "keys": [part["key"].to_numpy(np.int64).tobytes()],
                         "counts": [part["n"].to_numpy(np.int64).tobytes()], "units": [x.tobytes()], "lead": [lead.tobytes()]})


def _blocks(turn: np.ndarray, block: int):
    """Blocks of a sorted partition, numbered by partition and place; the rows of one task make its blocks."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, number, kept = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            kept.append(batch)
            while sum(map(len, kept)) >= block:
                together = pd.concat(kept)
                yield _block(together.iloc[:block], (task << 32) + number, turn)
                kept, number = [together.iloc[block:]], number + 1
        if sum(map(len, kept)):
            yield _block(pd.concat(kept), (task << 32) + number, turn)
    return rows


def _whole(lead: int):
    """All vectors of a rare length as one block; -1 less the length can't be the number of another block of that length."""
    return lambda rows: _block(rows, -1 - len(rows["v"].iloc[0]), np.eye(len(rows["v"].iloc[0]))[:, :lead])


def _cells(turn: np.ndarray, eps: float):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = np.floor(_units(batch["v"]) @ turn / eps).astype(np.int32) if len(batch) else np.zeros((0, turn.shape[1]), np.int32)
            yield batch.assign(**{f"c{i}": cells[:, i] for i in range(turn.shape[1])})
    return rows


def linked_vectors(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links (other rows linked directly), component_id (the smallest vec_id reachable), kept."""
    spark, eps = vectors.sparkSession, float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    good = rows.filter(usable(F.col("v")))
    unlinked = rows.filter(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    grouped = good.groupBy("v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = written(grouped.withColumn("size", F.size("v")).withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    fits = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(NUMBERS) / F.col("size")))).cast("int")
    # Each of these lengths fills a block, so there are fewer than blocks.
    sizes = {r["size"]: r for r in classes.groupBy("size").agg(F.count("*").alias("n")).withColumn("block", fits).filter("n > block").collect()}
    parts = [classes.filter(~F.col("size").isin(list(sizes))).groupBy("size").applyInPandas(_whole(lead), BLOCKS)]
    for size, row in sizes.items():
        usual, leading = classes.filter(F.col("size") == size), min(lead, size)
        turn = _directions(usual, size, leading)
        cells = [f"c{i}" for i in range(leading)]
        shape = ", ".join(["v array<double>", "n long", "first " + dict(rows.dtypes)["vec_id"], "size int", "key long", *[f"{c} int" for c in cells]])
        ordered = usual.mapInPandas(_cells(turn, eps), shape).repartitionByRange(-(-row['n'] // row['block']), *cells).sortWithinPartitions(*cells).select("v", "n", "key")
        parts.append(ordered.mapInPandas(_blocks(turn, row['block']), BLOCKS))
    blocks = written(reduce(DataFrame.unionByName, parts), "vector-blocks")
    # Blocks whose boxes come within eps share a cell of the first direction, if one box is widened by a cell each way.
    boxes = lookup(written(blocks.select("size", "block", "low", "high"), "vector-boxes"))
    cell = [F.floor(F.col(c)[0] / F.lit(eps)).cast("long") for c in ("low", "high")]
    left = boxes.select("size", F.col("block").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"), F.explode(F.sequence(cell[0] - 1, cell[1] + 1)).alias("cell"))
    right = boxes.select("size", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.explode(F.sequence(*cell)).alias("cell"))
    zero = F.lit(0.0)
    apart = F.zip_with(F.zip_with("low_i", "high_j", lambda a, b: a - b), F.zip_with("low_j", "high_i", lambda a, b: a - b), lambda a, b: F.greatest(a, b, zero))
    gap = F.aggregate(apart, zero, lambda s, x: s + x * x)
    pairs = left.join(right, ["size", "cell"]).filter((F.col("i") <= F.col("j")) & (gap <= (eps + SLACK) ** 2)).select("size", "i", "j").distinct()
    data = blocks.select("size", "block", "keys", "counts", "units", "lead")
    one = data.select(*[F.col(c).alias({"block": "i", "size": "size"}.get(c, f"a_{c}")) for c in data.columns])
    two = data.select(*[F.col(c).alias({"block": "j", "size": "size"}.get(c, f"b_{c}")) for c in data.columns])
    met = written(pairs, "vector-pairs").join(one, ["size", "i"]).join(two, ["size", "j"])
    met = met.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = written(met.mapInPandas(_links(threshold, eps), "a long, b long, links long"), "vector-links")
    counts = found.filter("b < 0").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("others"))
    parts_of = components(found.filter("b >= 0").select("a", "b"))
    known = (classes.join(counts, "key", "left").join(parts_of.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("component", F.coalesce("component", "key")))
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    judged = written(known.join(least, "component").select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector-judged")
    linked = good.join(judged, "v").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return linked.unionByName(unlinked)
