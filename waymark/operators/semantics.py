"""Descriptions and parameters of steps: merging, coverage, best description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.steps import category, lookup
from waymark.rulesets import fabrication as fab
from waymark.session import by_distinct, cut_lineage


def merge_semantics(rows: DataFrame) -> DataFrame:
    """step, descriptions, parameters, families from rows (ord, step, description, parameters, family).

    Texts are kept once each, in the order they first occur. Distinct texts are
    found before anything is collected, so a list holds different texts only.
    """
    def ordered(column: str) -> DataFrame:
        first = (rows.filter(F.coalesce(F.col(column), F.lit("")) != "")
                 .groupBy("step", F.col(column).alias("text")).agg(F.min("ord").alias("ord")))
        return first.groupBy("step").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias(f"all_{column}"))

    families = rows.filter(F.coalesce("family", F.lit("")) != "").groupBy("step").agg(
        F.array_sort(F.collect_set("family")).alias("families"))
    empty = F.array().cast("array<string>")
    return (rows.select("step").distinct().join(ordered("description"), "step", "left")
            .join(ordered("parameters"), "step", "left").join(families, "step", "left")
            .select("step", F.coalesce("all_description", empty).alias("descriptions"),
                    F.coalesce("all_parameters", empty).alias("parameters"),
                    F.coalesce("families", empty).alias("families")))


def coverage(vocabulary: DataFrame, semantics: DataFrame) -> DataFrame:
    """How much of a vocabulary (column step) has descriptions."""
    known = semantics.select("step", (F.size("parameters") > 0).alias("p"), F.lit(True).alias("k"))
    both = vocabulary.select("step", F.lit(True).alias("v")).distinct().join(known, "step", "full")
    return both.agg(F.count_if("v").alias("vocab_size"), F.count_if("k").alias("steps_with_semantics"),
                    F.count_if(F.col("v") & F.col("k")).alias("vocab_covered"),
                    F.count_if(F.col("v") & F.col("k").isNull()).alias("vocab_missing"),
                    F.count_if("p").alias("steps_with_parameters"))


def missing(vocabulary: DataFrame, semantics: DataFrame) -> DataFrame:
    return vocabulary.select("step").distinct().join(semantics.select("step"), "step", "left_anti")


def best_match(left: DataFrame, right: DataFrame, group: str, name: str, threshold: float = 0.5,
               rank: str | None = None) -> DataFrame:
    """For each left name the right name of the same group with the largest token overlap.

    Overlap is Jaccard over white-space tokens and must reach the threshold; ties
    go to the smaller ``rank`` (default: the name). Names with the same tokens are one
    set, compared once and expanded at the end. Sets are joined on the rarest few tokens
    of each: of two sets that reach the threshold both have one of those in common. A
    pair is dropped before it is compared if its sizes, or the tokens left behind the
    common one in order of rarity, can't reach the threshold. So the result is exact,
    while common tokens do not pair everything with everything.
    """
    rank = rank or name
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.trim(F.col(name)), r"\s+"), lambda t: t != "")))
    a = cut_lineage(left.select(group, name, tokens.alias("tokens")).filter(F.size("tokens") > 0).distinct())  # read three times
    b = cut_lineage(right.select(group, F.struct(F.col(rank).alias("rank"), F.col(name).alias("match")).alias("first"), tokens.alias("tokens"))
                    .filter(F.size("tokens") > 0).groupBy(group, "tokens").agg(F.min("first").alias("first")))
    sets = cut_lineage(a.select(group, "tokens").distinct())
    common = (sets.select(group, F.explode("tokens").alias("t")).unionByName(b.select(group, F.explode("tokens").alias("t")))
              .groupBy(group, "t").agg(F.count(F.lit(1)).alias("df")))

    def least(size: Column, share: float) -> Column:
        return F.ceil(F.lit(share) * size - 1e-9)

    def rarest(df: DataFrame, column: str) -> DataFrame:
        """Of n tokens the n - ceil(threshold * n) + 1 rarest ones, with their places."""
        size = F.size("tokens")
        w = Window.partitionBy(group, "tokens").orderBy("df", "t")
        placed = df.select(group, "tokens", F.explode("tokens").alias("t")).join(common, [group, "t"]).withColumn("n", F.row_number().over(w))
        kept = placed.filter(F.col("n") <= size - least(size, threshold) + 1)
        return kept.select(group, "t", F.col("tokens").alias(column), F.col("n").alias(f"{column}_at"))

    x, y = F.size("one"), F.size("two")
    sizes = (y >= least(x, threshold)) & (x >= least(y, threshold))
    behind = 1 + F.least(x - F.col("one_at"), y - F.col("two_at")) >= least(x + y, threshold / (1 + threshold))
    # the first token in common has the most tokens behind it, so a pair that can count is kept
    pairs = rarest(sets, "one").join(rarest(b, "two"), [group, "t"]).filter(sizes & behind).select(group, "one", "two").distinct()
    score = F.size(F.array_intersect("one", "two")) / F.size(F.array_union("one", "two"))
    scored = pairs.withColumn("score", score).filter(F.col("score") >= threshold).join(b.withColumnRenamed("tokens", "two"), [group, "two"])
    best = F.min(F.struct((-F.col("score")).alias("less"), F.col("first.rank"), F.col("first.match")))
    chosen = scored.groupBy(group, F.col("one").alias("tokens")).agg(best.alias("b"))
    return a.join(chosen, [group, "tokens"]).select(group, name, F.col("b.match").alias("match"), (-F.col("b.less")).alias("score"))


def describe(steps: DataFrame, semantics: DataFrame) -> DataFrame:
    """Best description of each step: its own, its documented twin's, the closest one's, its category."""
    def with_kind(df: DataFrame) -> DataFrame:
        return by_distinct(df, "step", lambda n: n.withColumn("kind", category(F.col("step"))))

    known = cut_lineage(semantics.filter(F.size("descriptions") > 0).select(
        "step", F.get("descriptions", F.lit(0)).alias("text")))
    wanted = cut_lineage(with_kind(steps.select("step").distinct()))
    twin = lookup(fab.DOCUMENTED_TWINS, F.col("step"), F.lit(None).cast("string"))
    out = wanted.join(known.withColumnRenamed("text", "own"), "step", "left").withColumn("twin", twin)
    out = out.join(known.select(F.col("step").alias("twin"), F.col("text").alias("of_twin")), "twin", "left")
    close = best_match(wanted, with_kind(known.select("step")), "kind", "step")
    texts = known.select(F.col("step").alias("match"), F.col("text").alias("of_match"))
    out = out.join(close.join(texts, "match").select("step", "of_match"), "step", "left")
    general = F.concat(F.lit("("), F.lower("kind"), F.lit(" operation)"))
    return out.select("step", F.coalesce("own", "of_twin", "of_match", general).alias("description"))


def look_up(steps: DataFrame, texts: DataFrame) -> DataFrame:
    """step, description: the text recorded for the upper-case name, else for the name as it is."""
    raw = texts.select("step", F.col("description").alias("as_is"))
    upper = texts.select(F.col("step").alias("up"), F.col("description").alias("as_upper"))
    out = steps.withColumn("up", F.upper("step")).join(upper, "up", "left").join(raw, "step", "left")
    return out.select("step", F.coalesce("as_upper", "as_is").alias("description"))


def render(step: Column, description: Column, parameters: Column) -> Column:
    """'step: description  [params: first]'."""
    first = F.get(parameters, F.lit(0))
    line = F.when(description != "", F.concat(step, F.lit(": "), description)).otherwise(step)
    return F.concat(line, F.when(first.isNotNull(), F.concat(F.lit("  [params: "), first, F.lit("]"))).otherwise(""))
