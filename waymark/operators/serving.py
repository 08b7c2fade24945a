"""Queries behind result pages: joined results, filters, pages, details, risk spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def joined_results(inputs: DataFrame, next_steps: DataFrame, completions: DataFrame, key: str) -> DataFrame:
    """Rows present in all three tables."""
    return inputs.join(next_steps, key).join(completions, key)


def choose(df: DataFrame, **equals: object) -> DataFrame:
    """Equality filters; a blank or missing value filters nothing."""
    for column, value in equals.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == value)
    return df


def page(df: DataFrame, sortable: list[str], sort_by: str, descending: bool, number: int, size: int,
         tie: str, default: str | None = None) -> DataFrame:
    """One page of the sorted rows with the total row count.

    An unknown sort column falls back to the default. Ties keep the order of
    ``tie`` in both directions. Spark keeps number * size rows per task only.
    """
    column = sort_by if sort_by in sortable else (default or sortable[0])
    order = F.col(column).desc() if descending else F.col(column).asc()
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return df.orderBy(order, F.col(tie).asc()).offset((number - 1) * size).limit(size).withColumn("total", total)


def detail(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == value)


def risk_band(risk: Column, width: float = 0.08) -> dict[str, Column]:
    """The risk with a band around it, within 0 and 1."""
    return {"risk_score": F.round(risk, 4), "confidence_lo": F.round(F.greatest(F.lit(0.0), risk - width), 4),
            "confidence_hi": F.round(F.least(F.lit(1.0), risk + width), 4)}


def risk_level(risk: Column) -> Column:
    return F.when(risk >= 0.85, "high").when(risk >= 0.70, "raised").otherwise("normal")


def risk_spans(df: DataFrame, keys: list[str], risk: str, index: str, limit: float = 0.70) -> DataFrame:
    """First and last risky position of each sequence that has one."""
    return (df.filter(F.col(risk) >= limit).groupBy(*keys)
            .agg(F.min(index).alias("first_risky"), F.max(index).alias("last_risky"),
                 F.count(F.lit(1)).alias("n_risky")))


def top_contributions(df: DataFrame, keys: list[str], value: str, tie: str, k: int = 10) -> DataFrame:
    """The k contributions of largest absolute value per key."""
    w = Window.partitionBy(*keys).orderBy(F.abs(value).desc(), tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def flatten_batches(batches: DataFrame) -> DataFrame:
    """One row per batch, step and contribution of the nested batch documents."""
    steps = batches.select("batch_id", F.posexplode("per_step").alias("step_index", "s"))
    return steps.select("batch_id", "step_index", "s.step_id", "s.step_name", "s.risk_score",
                        F.explode_outer("s.shap").alias("c")).select(
        "batch_id", "step_index", "step_id", "step_name", "risk_score", "c.feature", "c.value", "c.contribution")


def batch_summaries(batches: DataFrame, timestamp: Column) -> DataFrame:
    """Summary rows with defaults for missing fields and the defect probability."""
    chance = F.coalesce("predicted_yield", F.lit(0.5))
    return batches.select(
        "batch_id", timestamp.alias("timestamp"), F.coalesce("family", F.lit("IC")).alias("material"),
        chance.alias("predicted_yield"), F.round(1 - chance, 4).alias("defect_probability"),
        F.coalesce("confidence", F.lit(0.7)).alias("confidence"),
        F.coalesce("risk_steps_detected", F.lit(0)).alias("risk_steps_detected"))
