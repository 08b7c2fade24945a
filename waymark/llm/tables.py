"""Helpers of the operators: tables in the shared folder, free column names, safe broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from waymark.session import ensure_checkpoint_dir

# Words are runs of anything but blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
# A table is broadcast only if it was seen to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder in spark.checkpoint.dir, for one run of one operator."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back, which cuts its lineage.

    The files stay until the application's checkpoint folder is removed; a lost
    executor costs a reread, never a recomputation.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """name, with underscores in front until it clashes with none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions_for(spark: SparkSession, items: int, each: int) -> int:
    """Partitions for so many items of work, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // each), 1)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory; arrays, maps and structs count all they hold."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        size = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + _bytes(x, kind.elementType))
        size = size + 16
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + _bytes(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def broadcastable(table: DataFrame) -> bool:
    """Whether a written table's rows and bytes are seen to be within the bounds."""
    total = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in table.schema), F.lit(0).cast("long"))
    row = table.select(total.alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return row.n <= BROADCAST_ROWS and (row.b or 0) <= BROADCAST_BYTES


def lookup(table: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its rows and bytes are seen to be within the bounds.

    Larger ones come back as they are, and Spark joins by shuffle with AQE's split of skewed keys.
    """
    return F.broadcast(table) if broadcastable(table) else table


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, so that reruns agree."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))
