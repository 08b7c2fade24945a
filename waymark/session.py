"""Session helpers: the folder for cut lineage and size checks for broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

# A table is broadcast only after its row count was seen to be at most this.
BROADCAST_ROWS = 200_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back.

    The folder is the one named in ``spark.checkpoint.dir``. A private folder is
    made only where that setting is absent and the master is local.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for files of one run."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if it is seen to have at most max_rows rows.

    Larger tables come back without a hint, so that Spark joins by shuffle. The
    result is cut from its lineage, because the check has to compute it anyway.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def spread(scan: DataFrame) -> DataFrame:
    """A table scan of fewer partitions than cores, dealt out evenly; larger scans stay as they are.

    For costly work per row only, on a scan straight from files.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def by_distinct(df: DataFrame, column: str, build: Callable[[DataFrame], DataFrame],
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add columns that depend on one column only, computed once per distinct value.

    The distinct values are counted up to max_rows; if there are more, build runs
    on the rows themselves, which needs no join at all.
    """
    values = cut_lineage(df.select(column).distinct().limit(max_rows + 1))
    if values.count() > max_rows:
        return build(df)
    # NULL is a value like any other, so that the result is the one of build on the rows
    side = build(values).withColumnRenamed(column, "__value")
    return df.join(F.broadcast(side), F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")
