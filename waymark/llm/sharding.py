"""Placing documents on shards through a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: an offset
and a step taken from the md5 of its name. The shards take turns, each claiming the
first free slot in its order, until the table is full; so any two shards hold the
same number of slots, give or take one, and a shard more or less moves few keys. A
document's slot is the md5 of its key modulo the table size: one look into a
broadcast table of fixed size, no shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm.tables import fresh

TABLE_SIZE = 65_537
# Hex digits of an md5 that make a positive long.
DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard in each slot. The work is bounded by the table, whatever the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("give one or more different shard names")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be a prime, at least the number of shards")
    slots, taken = [-1] * size, 0
    place = [_number(f"{name}/offset") % size for name in shards]
    step = [_number(f"{name}/step") % (size - 1) + 1 for name in shards]
    while True:
        for shard in range(len(shards)):
            while slots[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            slots[place[shard]] = shard
            taken += 1
            if taken == size:
                return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key; null keys give null."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("long") % F.lit(size)


def table(spark: SparkSession, shards: list[str], size: int, names: tuple[str, str]) -> DataFrame:
    """The filled table as rows (slot, shard); always `size` rows."""
    slots = fill(shards, size)
    return spark.createDataFrame(list(enumerate(slots)), f"`{names[0]}` long, `{names[1]}` int")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE, out: str = "shard") -> DataFrame:
    """Add the column `out`, the number of the shard of each row.

    Rows with equal keys share a shard; ties and repeated rows need nothing more. A
    null key is placed by the other columns of its row, so a table of many null keys
    still spreads. An empty table stays empty. A column that is already named `out`
    is replaced; all others are kept.
    """
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    slot, number = fresh(docs.columns, "slot"), fresh(docs.columns, "number")
    others = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and c != key], F.lit(0))
    keyed = docs.withColumn(slot, slot_of(F.coalesce(F.col(f"`{key}`").cast("string"), others.cast("string")), size))
    lookup = table(docs.sparkSession, shards, size, (slot, number))
    return keyed.join(F.broadcast(lookup), slot).select(*[F.col(f"`{c}`") for c in kept], F.col(number).alias(out))
