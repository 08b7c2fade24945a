"""Look-ahead advisories, three-way verdicts and the ordering heuristic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import steps as S
from waymark.operators.ordered import running_state
from waymark.session import by_distinct

# How soon a step must follow, anchors, order of blocks.
STRIP_WITHIN, CLEAN_WITHIN, ANNEAL_WITHIN = 6, 8, 12
FIRST_STEP, LAST_STEP = "RECEIVE WAFER LOT", "SHIP LOT"
ALIGN = "ALIGN MASK LEVEL "


def _has(step: Column, *parts: str) -> Column:
    test = F.lit(False)
    for p in parts:
        test = test | step.contains(p)
    return test


def strict_advisory(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: str = "step",
                    hot_rows: int | None = None) -> DataFrame:
    """keys, code, step_index, step, severity: documented habits that are not rules.

    Advice about what follows a step comes from a scan in reverse order, advice
    about mask cycles from one group per cycle, advice about the order of blocks
    from the first position of each block.
    """
    keys = list(keys)
    def build(names: DataFrame) -> DataFrame:
        known = names.withColumns({"up": F.upper("step"), "cat": S.category(F.col("step")),
                                   "known": S.is_categorised(F.col("step"))})
        u = F.col("up")
        event = lambda name: S.in_event(name, F.col("step"), F.col("cat"), F.col("known"))
        return known.withColumns({
            "align": u.startswith(ALIGN), "expose": event("EXPOSE"), "develop": event("DEVELOP"),
            "etch": event("PATTERNED_ETCH"), "clean": event("CLEAN_SURFACE"), "implant": event("IMPLANT"),
            "strip": u.startswith("STRIP "),
            "anneal": ((F.col("cat") == "ANNEAL") | _has(u, "ANNEAL", "DRIVE IN", "RAPID THERMAL")
                       | u.startswith("RTA"))}).drop("cat", "known")

    flagged = by_distinct(df.select(*keys, *order, F.col(step).alias("step")), "step", build)

    ahead = running_state(
        flagged, keys, order, reverse=True, index="left", hot_rows=hot_rows,
        last={"next_strip": F.col("strip"), "next_clean": F.col("clean"), "next_anneal": F.col("anneal")})
    rows = running_state(ahead, keys, order, total="n", sums={"earlier": F.col("align").cast("bigint")},
                         hot_rows=hot_rows).withColumn("cycle", F.col("earlier") + F.col("align").cast("bigint"))

    def soon(name: str, within: int) -> Column:
        return F.coalesce(F.col("left") - F.col(name) <= within, F.lit(False))

    def advice(test: Column, code: str, severity: str = "physical") -> Column:
        return F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    level = F.trim(F.element_at(F.split(F.col("up"), ALIGN), -1))
    single = rows.select(*keys, "step_index", "step", F.explode(F.array_compact(F.array(
        advice((F.col("step_index") == 0) & (F.col("up") != FIRST_STEP), "SPEC_BAD_START", "convention"),
        advice((F.col("step_index") == F.col("n") - 1) & (F.col("up") != LAST_STEP), "SPEC_BAD_END", "convention"),
        advice(F.col("align") & (F.col("cycle") == 1) & F.rlike(level, F.lit("^[0-9]+$"))
               & (level.try_cast("int") != 1), "SPEC_LITHO_FIRST_NOT_1", "convention"),
        advice(F.col("etch") & ~soon("next_strip", STRIP_WITHIN), "SPEC_ETCH_NO_STRIP"),
        advice(F.col("etch") & ~soon("next_clean", CLEAN_WITHIN), "SPEC_ETCH_NO_CLEAN"),
        advice(F.col("implant") & ~soon("next_anneal", ANNEAL_WITHIN), "SPEC_IMPLANT_NO_ANNEAL")))).alias("a"))

    start = F.min(F.struct("step_index", "step")).alias("start")
    cycles = rows.filter("cycle > 0").groupBy(*keys, "cycle").agg(
        F.bool_or("expose").alias("expose"), F.bool_or("develop").alias("develop"), start)
    cycle_advice = cycles.select(*keys, "start.step_index", "start.step", F.coalesce(
        advice(~F.col("develop"), "SPEC_LITHO_NO_DEVELOP"),
        advice(~F.col("expose"), "SPEC_LITHO_NO_EXPOSE")).alias("a")).filter("a IS NOT NULL")

    def first(test: Column) -> Column:
        return F.min(F.when(test, F.struct("step_index", "step")))

    u = F.col("up")
    blocks = {
        "ild": _has(u, "INTERLAYER DIELECTRIC", "INTERLEVEL DIELECTRIC"),
        "via": _has(u, "VIA") & _has(u, "FILL", "ETCH"),
        "metal": u.isin("DEPOSIT METAL 1", "DEPOSIT TOP METAL"),
        "passivation": u.startswith("DEPOSIT PASSIVATION"),
        "backside": u == "DEPOSIT BACKSIDE METAL", "ship": u == "SHIP LOT",
        "sort": u == "WAFER SORT TEST", "yield": u == "YIELD ANALYSIS",
        "param": u.isin("PARAMETRIC TEST", "ELECTRICAL PARAMETRIC TEST")}
    firsts = rows.groupBy(*keys).agg(*[first(t).alias(n) for n, t in blocks.items()])
    present = F.array_compact(F.array(*[F.col(n) for n in list(blocks)[:6]]))
    pairs = F.filter(F.transform(present, lambda b, i: F.when(
        (i > 0) & (F.get(present, i - 1)["step_index"] > b["step_index"]),
        F.struct(F.lit("SPEC_BLOCK_ORDER").alias("code"), F.lit("physical").alias("severity"),
                 b["step_index"].alias("step_index"), b["step"].alias("step")))), lambda x: x.isNotNull())
    test_order = lambda test, at: F.when(test, F.struct(
        F.lit("SPEC_TEST_ORDER").alias("code"), F.lit("convention").alias("severity"),
        F.col(f"{at}.step_index").alias("step_index"), F.col(f"{at}.step").alias("step")))
    tests = F.array_compact(F.array(
        test_order(F.col("param.step_index") > F.col("sort.step_index"), "param"),
        test_order(F.col("yield.step_index") < F.col("sort.step_index"), "yield")))
    order_advice = firsts.select(*keys, F.explode(F.concat(pairs, tests)).alias("a")).select(
        *keys, "a.step_index", "a.step", F.struct("a.code", "a.severity").alias("a"))

    out = single.unionByName(cycle_advice).unionByName(order_advice)
    return out.select(*keys, "a.code", "step_index", "step", "a.severity")


def verdicts(found: DataFrame, rows: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """INVALID, else INSUFFICIENT_INFORMATION if a name has no category, else VALID."""
    keys = list(keys)
    name = F.col(step)
    unknown = ((S.category(name) == "UNKNOWN") & (name != "")
               & ~(name.startswith("[") & F.endswith(name, F.lit("]"))))
    broken = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("v"))
    out = rows.groupBy(*keys).agg(F.count_if(unknown).alias("u")).join(broken, keys, "left")
    verdict = (F.when(F.col("v") > 0, "INVALID").when(F.col("u") > 0, "INSUFFICIENT_INFORMATION").otherwise("VALID"))
    return out.select(*keys, verdict.alias("verdict"), F.coalesce("v", F.lit(0)).alias("n_violations"),
                      F.when(F.col("v") > 0, 0).otherwise(F.col("u")).alias("n_unknown"))


def yield_of(is_valid: Column) -> dict[str, Column]:
    """Fixed score, yield and confidence of a verdict."""
    return {"score": F.when(is_valid, 0.95).otherwise(0.05),
            "predicted_yield": F.when(is_valid, 0.92).otherwise(0.35),
            "confidence": F.when(is_valid, 0.91).otherwise(0.95)}


def ordering_heuristic(df: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str,
                       hot_rows: int | None = None) -> DataFrame:
    """Yield and confidence from how often the kind changes between neighbours."""
    rows = running_state(df, keys, order, lags={"prior": (F.col(kind), 1)}, hot_rows=hot_rows)
    n, changes = F.count(F.lit(1)), F.count_if(F.col("prior") != F.col(kind))
    scored = rows.groupBy(*keys).agg(F.when(n > 1, 1 - changes / (n - 1)).otherwise(1.0).alias("s"))
    return scored.select(*keys, F.round(0.55 + F.col("s") * 0.40, 3).alias("predicted_yield"),
                         F.round(0.65 + F.col("s") * 0.25, 3).alias("confidence"))
