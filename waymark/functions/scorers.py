"""Custom scorers: plug a model in where the n-gram candidates come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scored = list[tuple[str, float]] | dict[str, float] | list[str]


def ranked(result: Scored) -> list[tuple[str, float]]:
    """A ranked list, a list of pairs or a score map as pairs, best first."""
    if isinstance(result, dict):
        return sorted(result.items(), key=lambda kv: kv[1], reverse=True)
    return [r if isinstance(r, tuple) else (r, 0.0) for r in result]


def score_prefixes(prefixes: DataFrame, steps: str, scorer: Callable[[list[list[str]]], list[Scored]],
                   drop: tuple[str, ...] = ()) -> DataFrame:
    """Add candidates (array<struct<rank, next, p>>) from a scorer that takes Arrow batches of prefixes.

    Blank steps and the names in ``drop`` (special tokens) do not rank.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prefixes.schema)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = scorer([list(s) for s in pdf[steps]])
            pdf["candidates"] = [
                [{"rank": i, "next": name, "p": float(p)} for i, (name, p) in enumerate(
                    [(n, p) for n, p in ranked(r) if n and n not in drop], 1)] for r in found]
            yield pdf

    return prefixes.mapInPandas(score, f"{fields}, candidates array<struct<rank:int,next:string,p:double>>")
