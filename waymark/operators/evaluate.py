"""Scores of predictions: next step, completion, anomaly, and how they are grouped.

Two scorers exist for each task. They differ on purpose (direction of the edit
measure, denominators, blanks, ties, base of the rule attribution) and are kept
apart as ``official`` and ``internal``. Row scores are plain columns; the means
over groups combine partially on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import arrays as A
from waymark.functions.steps import block, category, first_word
from waymark.operators.ordered import running_state


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


# -- matching predictions with the truth -------------------------------------------

def last_row(df: DataFrame, key: str, row_order: str) -> DataFrame:
    """One row per key, the one with the largest row_order (later rows win)."""
    others = [c for c in df.columns if c not in (key, row_order)]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(row_order)).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in others]))


def unmatched(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    return truth.join(predicted.select(key), key, "left_anti")


def supplement(truth: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """truth plus the rows of extra whose key is not in truth."""
    return truth.unionByName(extra.join(truth.select(key), key, "left_anti"))


def by_label(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids with their rule where invalid, and ids where valid."""
    bad = labels.filter(F.col("is_valid") == 0)
    return (bad.select("example_id", F.col("rule").alias("violation_rule")),
            labels.filter(F.col("is_valid") == 1).select("example_id"))


# -- next step -----------------------------------------------------------------------

def next_step_scores(ranks: Column, gold: Column, *, internal: bool = False) -> dict[str, Column]:
    """Hit and reciprocal rank columns.

    Official: blanks are removed first and the fifth measure counts any rank.
    Internal: blanks keep their place, and the category scores are added.
    """
    listed = ranks if internal else F.filter(ranks, lambda x: F.trim(x) != "")
    at = F.coalesce(F.array_position(listed, gold), F.lit(0))
    scores = {"top1": at == 1, "top3": (at >= 1) & (at <= 3),
              "top5": (at >= 1) & (at <= 5) if internal else at >= 1}
    out = {name: test.cast("double") for name, test in scores.items()}
    out["mrr"] = F.when(at > 0, 1 / at).otherwise(0.0)
    if internal:
        kinds = F.array_position(F.transform(listed, lambda s: category(s)), category(gold))
        out["top1_category"] = (F.coalesce(kinds, F.lit(0)) == 1).cast("double")
        out["mrr_category"] = F.when(kinds > 0, 1 / kinds).otherwise(0.0)
    return out


# -- completion ------------------------------------------------------------------------

def completion_scores(predicted: Column, gold: Column, *, internal: bool = False) -> dict[str, Column]:
    """Exact match, edit measure (official: distance, internal: similarity), token and block accuracy."""
    n, shorter = F.size(gold), F.least(F.size(predicted), F.size(gold))
    exact = (predicted == gold).cast("double")
    if not internal:
        p_blocks, g_blocks = (A.collapse(F.transform(s, lambda x: block(x))) for s in (predicted, gold))
        return {"ned": A.edit_rate(predicted, gold), "exact": exact,
                "token_accuracy": ratio(A.equal_rate(predicted, gold), shorter),
                "block_accuracy": ratio(A.equal_rate(p_blocks, g_blocks),
                                        F.least(F.size(p_blocks), F.size(g_blocks)))}
    p_words, g_words = (A.collapse(F.transform(s, lambda x: first_word(x))) for s in (predicted, gold))
    p_kinds, g_kinds = (F.transform(s, lambda x: category(x)) for s in (predicted, gold))
    length = F.greatest(F.lit(1), n)
    return {"exact": exact, "ned_similarity": 1 - A.edit_rate(predicted, gold),
            "token_accuracy": A.equal_rate(predicted, gold) / length,
            "category_token_accuracy": A.equal_rate(p_kinds, g_kinds) / length,
            "block_similarity": 1 - A.edit_rate(p_words, g_words)}


# -- anomaly --------------------------------------------------------------------------------

def coerce_verdict(text: Column) -> Column:
    """int(float(x)), or -1 where that fails."""
    number = F.trim(text).try_cast("double")
    return F.coalesce(number.try_cast("int"), F.lit(-1))


def coerce_score(text: Column, verdict: Column) -> Column:
    """The score, else the verdict as a number, else one half."""
    fallback = F.when(verdict >= 0, verdict.cast("double")).otherwise(0.5)
    return F.coalesce(F.trim(text).try_cast("double"), fallback)


def confusion(truth: Column, predicted: Column) -> dict[str, Column]:
    """Counts with invalid (0) as the positive class; fn is any prediction other than 0."""
    return {"n": F.count(F.lit(1)), "tp": F.count_if((truth == 0) & (predicted == 0)),
            "fp": F.count_if((truth == 1) & (predicted == 0)),
            "tn": F.count_if((truth == 1) & (predicted == 1)),
            "fn": F.count_if((truth == 0) & (predicted != 0)),
            "correct": F.count_if(truth == predicted)}


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "accuracy": ratio(F.col("correct"), F.col("n")), "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def rule_attribution(truth: Column, predicted: Column, rule: Column, predicted_rule: Column) -> dict[str, Column]:
    """Share of right rules: among detected invalid rows, and among all invalid rows."""
    invalid, detected = truth == 0, (truth == 0) & (predicted == 0)
    named, right = detected & (rule != ""), detected & (rule == predicted_rule)
    return {"attribution_detected": F.avg(F.when(named, right.cast("double"))),
            "attribution_all": F.coalesce(F.avg(F.when(invalid, right.cast("double"))), F.lit(0.0))}


def detection_by_rule(df: DataFrame, truth: str, predicted: str, rule: str) -> DataFrame:
    hit = (F.col(predicted) == 0).cast("bigint")
    return (df.filter(F.col(truth) == 0).groupBy(F.col(rule).alias("rule"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("detected"), F.avg(hit).alias("rate")))


def roc_auc(df: DataFrame, label: str, score: str, hot_rows: int | None = None) -> DataFrame:
    """P(a valid row scores above an invalid one), ties counting one half.

    Rows are first counted per distinct score; the running count over the scores
    is cut into chunks when there are too many for one task.
    """
    per_score = df.groupBy(F.lit(0).alias("__all"), F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
        F.sum((F.col(label) == 0).cast("bigint")).alias("neg"))
    below = running_state(per_score, ["__all"], ["score"], sums={"neg_below": F.col("neg")}, hot_rows=hot_rows)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    both = F.sum("pos") * F.sum("neg")
    return below.agg(F.when(both > 0, wins / both).alias("roc_auc"))


def roc_auc_by_rank(df: DataFrame, label: str, score: str, row_order: str, hot_rows: int | None = None) -> DataFrame:
    """Rank-sum form without tie handling: equal scores rank by row_order.

    Invalid is the positive class; 0.5 if only one class occurs. With many ties
    the value depends on the row order, so ``roc_auc`` is the default.
    """
    rows = df.select(F.lit(0).alias("__all"), (-F.col(score)).alias("s"), F.col(row_order).alias("o"),
                     (F.col(label) == 0).alias("inv"))
    ranked = running_state(rows, ["__all"], ["s", "o"], hot_rows=hot_rows)
    p = F.count_if("inv").cast("double")
    n = F.count(F.lit(1)) - p
    ranks = F.sum(F.when(F.col("inv"), F.col("step_index") + 1))
    return ranked.agg(F.when((p == 0) | (n == 0), F.lit(0.5))
                      .otherwise((ranks - p * (p + 1) / 2) / (p * n)).alias("roc_auc"))


# -- grouping ---------------------------------------------------------------------------------

def by_grouping(df: DataFrame, scores: dict[str, Column], family: str = "family",
                fraction: str = "fraction") -> DataFrame:
    """Means overall, per family and per fraction (three groupings, not the cube)."""
    rows = df.withColumns(scores).withColumn("__fraction", F.col(fraction).cast("string"))
    f, c = F.col(family), F.col("__fraction")
    grouped = rows.groupingSets([[], [f], [c]], f, c).agg(
        F.grouping_id().alias("__g"), F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(s) for s in scores])
    # bit 2: family is aggregated away, bit 1: fraction is
    gone = F.col("__g")
    return grouped.select(
        F.when(gone.bitwiseAND(F.lit(2)) != 0, "ALL").otherwise(f).alias("family"),
        F.when(gone.bitwiseAND(F.lit(1)) != 0, "ALL").otherwise(c).alias("fraction"), "n", *scores)


def transfer_drop(per_family: DataFrame, holdout: str, metrics: Sequence[str]) -> DataFrame:
    """Mean over the other families, the held-out family, and the difference."""
    columns = []
    for m in metrics:
        seen = F.avg(F.when(F.col("family") != holdout, F.col(m)))
        held = F.avg(F.when(F.col("family") == holdout, F.col(m)))
        columns += [seen.alias(f"id_{m}"), held.alias(f"ood_{m}"), (seen - held).alias(f"delta_{m}")]
    return per_family.agg(F.lit(holdout).alias("holdout"), *columns)


def reconstructed(predictions: DataFrame, keys: Sequence[str], prefix: str = "prefix", prediction: str = "prediction") -> DataFrame:
    """Long rows (keys, step_index, step) of prefix + prediction, for the rule checks and logic_validity."""
    whole = F.posexplode(A.reconstruct(F.col(prefix), F.col(prediction))).alias("step_index", "step")
    return predictions.select(*keys, whole)


def logic_validity(found: DataFrame, sequences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of sequences without a violation."""
    bad = found.select(*keys).distinct().withColumn("__bad", F.lit(1))
    joined = sequences.select(*keys).distinct().join(bad, list(keys), "left")
    return joined.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(F.avg(F.col("__bad").isNull().cast("double")), F.lit(0.0)).alias("validity"))


def curve(df: DataFrame, series: str, x: str, y: str) -> DataFrame:
    """Points of each series in order of x, one row per point (missing y is 0)."""
    return df.select(series, x, F.coalesce(F.col(y), F.lit(0.0)).alias(y)).orderBy(series, x)
