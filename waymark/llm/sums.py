"""Matrices of a fixed shape summed over the partitions of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BLOCKS, GROUPS = 16, 32


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(rows["data"].iloc[0]) // 8)
    for data in rows["data"]:
        total += np.frombuffer(data)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "data": [total.tobytes()]})


def partition_sums(df: DataFrame, shape: tuple[int, ...], add: Callable[[np.ndarray, pd.DataFrame], None]) -> np.ndarray:
    """The sum over all rows of what add(total, rows) adds to a zero matrix.

    Each task keeps one matrix; the tasks' matrices are cut into blocks and summed by
    block in two steps, so no task holds more than a group's share of them. The
    result has the given shape, whatever the table's size, and goes to the driver.
    """
    size = int(np.prod(shape))
    length = -(-size // BLOCKS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for rows in batches:
            add(total, rows)
        flat = np.zeros(length * BLOCKS)
        flat[:size] = total.ravel()
        group = TaskContext.get().partitionId() % GROUPS
        yield pd.DataFrame({"block": range(BLOCKS), "part": group, "data": [x.tobytes() for x in flat.reshape(BLOCKS, length)]})

    parts = df.mapInPandas(sums, "block int, part int, data binary")
    grouped = parts.groupBy("block", "part").applyInPandas(_added, "block int, data binary")
    blocks = grouped.groupBy("block").applyInPandas(_added, "block int, data binary").collect()
    total = np.zeros(length * BLOCKS)
    for row in blocks:
        total[row.block * length:(row.block + 1) * length] = np.frombuffer(bytes(row.data))
    return total[:size].reshape(shape)
