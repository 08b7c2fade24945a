"""A quality classifier on document statistics.

Statistics of the whole text (character classes, repeated words, lengths) are
standardised and mapped to random Fourier features, which approximate a Gaussian
kernel. Normal equations summed over the partitions give ridge scores; isotonic
regression on labelled rows that the ridge fit has not seen turns a score into the
share of label 1. All labelled rows take part, no sample is drawn.

Null and empty texts have statistics of their own (all zero but for the constant
ones) and get a score like any other. Documents of equal text get equal scores, also
under equal ids; a document with several labels counts once, with their mean; labels
with a null id or value are left out. Without any label every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.sums import partition_sums
from waymark.llm.tables import fresh, written

# Character classes of the statistics, as bytes.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\r\n", b".,;:", b"!", b"?", b"#$%&*@^~+=", b"|<>{}[]()\\/_", b"\"'`-",
           bytes(range(128, 192)), bytes(range(192, 256))]
TABLE = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES):
    TABLE[list(_members), _i] = 1
N_STATS = len(CLASSES) + 8
FEATURES, RIDGE, BINS = 256, 1e-3, 1000


def statistics(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    share = counts[counts > 0] / size
    words = text.split()
    n = max(len(words), 1)
    repeats = sum(map(eq, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    return [*np.sqrt(counts @ TABLE / size), np.log1p(len(data)), np.log1p(n), repeats / n, len(set(words)) / n, (len(set(words)) / n) * np.log1p(n),
            lengths.mean() / 10, lengths.std() / 10, float(-(share * np.log(share)).sum())]


def stats_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or "") for t in texts])
    return stats(text)


@dataclass
class Model:
    """A fitted classifier; its size depends on the number of features alone."""

    mean: np.ndarray
    spread: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    shares: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.mean) / self.spread, -5, 5)
        waves = np.sqrt(2 / self.turn.shape[1]) * np.cos(scaled @ self.turn + self.shift)
        return np.hstack([waves, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def calibrated(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps, self.shares)

    def score(self, text: Column) -> Column:
        """The share of label 1 expected for a text, 0 to 1."""
        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                stats = np.array([statistics(t or "") for t in texts]).reshape(-1, N_STATS)
                yield pd.Series(self.calibrated(stats))
        return scored(text)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence next to values in weighted squares, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            u = pools[-1]
            u[0], u[1], u[2] = (u[0] * u[1] + v * w) / (u[1] + w), u[1] + w, u[2] + n
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _stats(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["stats"].to_numpy()).reshape(-1, N_STATS)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", features: int = FEATURES, ridge: float = RIDGE, seed: int = 3) -> Model:
    """Fit on the labelled rows of folds 1 to 3, calibrate on fold 4, leave fold 0 out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0)).groupBy(F.col(doc_id).alias("id")).agg(F.avg(label).cast("double").alias("y"))
    stats = docs.filter(fold(F.col(f"`{doc_id}`")) != 0).select(F.col(f"`{doc_id}`").alias("id"), stats_of(F.col(f"`{text}`")).alias("stats"))
    rows = written(stats.join(known, "id").select("stats", "y", (fold(F.col("id")) == 4).alias("calibrates")), "quality-stats")

    def moments(total: np.ndarray, part: pd.DataFrame) -> None:
        x = _stats(part)
        total += np.stack([x.sum(0), (x ** 2).sum(0), np.full(N_STATS, len(x))])

    learn, check = rows.filter("NOT calibrates"), rows.filter("calibrates")
    sums = partition_sums(learn, (3, N_STATS), moments)
    count = max(sums[2, 0], 1)
    mean = sums[0] / count
    rng = np.random.default_rng(seed)
    model = Model(mean, np.sqrt(np.maximum(sums[1] / count - mean ** 2, 1e-8)), rng.normal(0, 1 / np.sqrt(N_STATS), (N_STATS, features)),
                  rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not sums[2, 0]:
        return model

    def normal(total: np.ndarray, part: pd.DataFrame) -> None:
        z = model.features(_stats(part))
        total[:, :-1] += z.T @ z
        total[:, -1] += z.T @ part["y"].to_numpy()

    both = partition_sums(learn, (features + 1, features + 2), normal)
    penalty = np.diag(np.append(np.full(features, ridge * count), 1e-9))
    model.weights = np.linalg.solve(both[:, :-1] + penalty, both[:, -1])

    def histogram(total: np.ndarray, part: pd.DataFrame) -> None:
        cell = np.clip(((model.raw(_stats(part)) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        np.add.at(total[0], cell, 1)
        np.add.at(total[1], cell, part["y"].to_numpy())

    cells = partition_sums(check, (2, BINS), histogram)
    if not cells[0].sum():  # nothing to calibrate on
        cells = partition_sums(learn, (2, BINS), histogram)
    full = np.flatnonzero(cells[0])
    model.steps = (full + 0.5) / BINS * 2 - 0.5
    model.shares = np.clip(isotonic(cells[1, full] / cells[0, full], cells[0, full]), 0, 1)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add `out`; a column that is already named so is replaced, all others are kept."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    name = fresh(docs.columns, out)
    return docs.withColumn(name, model.score(F.col(f"`{text}`"))).select(*kept, F.col(name).alias(out))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    name = fresh(docs.columns, "quality_score")
    return scored(docs, model, text, name).filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
