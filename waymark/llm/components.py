"""Connected components of a table of edges, by large-star and small-star rounds.

Each task first shrinks its edges to a spanning forest of short stars; edges that one
task may hold (TASK_EDGES) are done then. Else a round ties every node's larger neighbours to the smallest node it knows (large star) and its
smaller ones likewise (small star); minima are aggregated before the shuffle, so a hub
costs one row for each task. Rounds go on until the edges no longer change, with the
edges written to the shared folder after each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waymark.llm.tables import written

TASK_EDGES = 1_000_000


class Forest:
    """Union-find over any ordered values; the root of a tree is its smallest member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up, top = self.up, x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x], x = top, nxt
        return top

    def join(self, a, b) -> bool:
        """Join two trees; whether they were two."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def add(self, edges: Iterable[tuple]) -> Forest:
        for a, b in edges:
            self.join(a, b)
        return self

    def stars(self) -> tuple[list, list]:
        """(node, root) of every node that isn't a root."""
        nodes = [x for x in self.up if self.root(x) != x]
        return nodes, [self.root(x) for x in nodes]


def _shrunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for rows in batches:
        forest.add(zip(rows["a"].tolist(), rows["b"].tolist()))
    nodes, roots = forest.stars()
    yield pd.DataFrame({"a": nodes, "b": roots}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): the smallest node reachable, for each node that has an edge to another.

    edges has long columns a and b; loops, repeated and reversed edges change nothing,
    edges with a null are left out, an empty table gives an empty result.
    """
    shape = "a long, b long"
    known = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"), "edges")
    tasks = -(-known.count() // TASK_EDGES)
    if tasks <= 1:
        return written(known.coalesce(1).mapInPandas(_shrunk, shape), "components").toDF("node", "component")
    stars, last = written(known.mapInPandas(_shrunk, shape).distinct(), "components"), None
    while True:
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(small, "a")
        stars = written(tied.select(F.col("b").alias("a"), F.col("m").alias("b")).union(tied.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "components")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
