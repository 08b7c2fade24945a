"""Writers: step tables, submissions, blind splits, metrics, logs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions.arrays import encode_pipe
from waymark.operators.ordered import running_state

RANKS = [f"RANK_{i}" for i in range(1, 6)]


def _csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, emptyValue="", escape='"')


def write_steps(df: DataFrame, path: str, order: str, steps: str = "steps") -> None:
    """Long step table with ids seq_0001, seq_0002, ... in the given order; rows stay in order."""
    numbered = running_state(df.withColumn("__all", F.lit(0)), ["__all"], [order], index="__n")
    rows = numbered.select(F.col("__n"), F.posexplode(steps).alias("__p", "STEP"))
    placed = rows.repartitionByRange("__n").sortWithinPartitions("__n", "__p")  # a sequence stays in one file
    _csv(placed.select(F.format_string("seq_%04d", F.col("__n") + 1).alias("SEQUENCE_ID"), "STEP"), path)


def rank_columns(ranks: Column) -> list[Column]:
    """Five columns, filled up with blanks."""
    filled = F.slice(F.concat(ranks, F.array_repeat(F.lit(""), 5)), 1, 5)
    return [F.element_at(filled, i).alias(name) for i, name in enumerate(RANKS, 1)]


def next_step_submission(df: DataFrame, ranks: str) -> DataFrame:
    return df.select(F.col("example_id").alias("EXAMPLE_ID"), *rank_columns(F.col(ranks)))


def completion_submission(df: DataFrame, completion: str) -> DataFrame:
    return df.select(F.col("example_id").alias("EXAMPLE_ID"), encode_pipe(F.col(completion)).alias("PREDICTED_SEQUENCE"))


def anomaly_submission(df: DataFrame) -> DataFrame:
    return df.select(F.col("example_id").alias("EXAMPLE_ID"), F.col("is_valid").alias("IS_VALID"),
                     F.format_string("%.4f", "score").alias("SCORE"),
                     F.coalesce("rule", F.lit("")).alias("PREDICTED_RULE"))


def write_submission(df: DataFrame, path: str) -> None:
    _csv(df, path)


def write_blind_split(df: DataFrame, input_path: str, label_path: str, inputs: list[str], labels: list[str]) -> None:
    """The same rows as an input table without labels and a label table."""
    _csv(df.select("example_id", *inputs), input_path)
    _csv(df.select("example_id", *labels), label_path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add JSON lines to an experiment log."""
    df.write.mode("append").json(path)


def export(inputs: DataFrame, results: DataFrame, task: str) -> DataFrame:
    """Result table of a task for every input row; rows without a result get blanks.

    For completions the number of steps is exported, not the steps.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = inputs.select("example_id", "family").join(results, "example_id", "left")
    columns = {
        "nextstep": lambda: [F.coalesce(c, F.lit("")).alias(n) for c, n in zip(
            [F.try_element_at("predictions", F.lit(i)) for i in range(1, 6)], RANKS)],
        "complete": lambda: [text("is_valid").alias("IS_VALID"), F.when(F.col("is_valid").isNull(), "").otherwise(
            F.size("completion").cast("string")).alias("PREDICTED_STEPS")],
        "anomaly": lambda: [text("is_valid").alias("IS_VALID"), text("score").alias("SCORE"),
                            text("predicted_rule").alias("PREDICTED_RULE")],
    }[task]()
    return rows.select(F.col("example_id").alias("EXAMPLE_ID"), F.col("family").alias("FAMILY"), *columns)
