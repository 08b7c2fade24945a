"""Repair of sequences until no class rule is broken.

One row is one bounded segment. The repair rounds are a fold over a fixed number
of rounds inside the row: no shuffle, no collected state, rows that are valid
pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.functions.arrays import let
from waymark.operators.rules import array_violations, rule_name
from waymark.rulesets import fabrication as fab

BOOK = fab.BY_CLASS
STEP_TYPE = "struct<step:string,mask:int,level:int>"

# What is inserted before the step that lacks it.
INSERTED = {
    "RULE_DEP_NO_CLEAN": ["CLEAN AFTER ETCH"], "RULE_ETCH_NO_MASK": ["DEVELOP PHOTORESIST"],
    "RULE_METAL_ETCH_NO_LITHO": ["EXPOSE LITHO LEVEL 4", "DEVELOP PHOTORESIST"],
    "RULE_IMPLANT_NO_MASK": ["DEVELOP PHOTORESIST"], "RULE_CMP_NO_DEP": ["FILL VIA METAL"],
}
CURE, SHIP, SORT = "CURE PASSIVATION", "SHIP LOT", "WAFER SORT TEST"


def _items(*names: str) -> Column:
    return S.literal_steps(*names).cast(f"array<{STEP_TYPE}>")


def _named(*names: str):
    return lambda x: x["step"].isin(list(names))


def _last_index(steps: Column, test) -> Column:
    return F.array_max(F.array_compact(F.transform(steps, lambda x, i: F.when(test(x), i))))


def worst(violations: Column) -> Column:
    """The most severe violation, the earliest step first, then in rule order."""
    ranked = F.transform(violations, lambda v: F.struct(
        v["severity"].alias("severity"), (-v["pos"]).alias("back"), (-v["rule_no"]).alias("order"), v.alias("v")))
    return F.array_max(F.transform(ranked, lambda r: F.struct(
        r["severity"], r["back"], r["order"], r["v"]["rule_no"].alias("rule_no"), r["v"]["pos"].alias("pos"),
        r["v"]["step"].alias("step"))))


def _passivation_order(steps: Column, at: Column) -> Column:
    """Bring deposit, cure and their consumers into order, whichever is missing or misplaced."""
    is_dep, is_cure = _named(*fab.PASSIVATIONS), _named(CURE)
    has_dep = F.exists(steps, is_dep)
    has_cure = F.exists(steps, is_cure)

    def reorder(s: Column) -> Column:
        cure = A.first_index(s, is_cure)
        dep = A.first_index(s, is_dep)
        ordered = F.when(dep > cure, A.move_before(s, dep, cure)).otherwise(s)
        return let(ordered, lambda o: A.insert_at(o, _last_index(o, is_cure) + 1, F.array(F.get(steps, at))))

    consumer = A.first_index(steps, lambda x: BOOK.has(x["mask"], "PAD_WINDOW_OPEN")
                             | BOOK.has(x["mask"], "ELECTRICAL_TEST") | BOOK.has(x["mask"], "BACKSIDE_METAL"))
    return (F.when(has_dep & has_cure, let(A.drop_at(steps, at), reorder))
            .when(has_cure, A.insert_at(steps, A.first_index(steps, is_cure), _items("DEPOSIT PASSIVATION")))
            .when(has_dep, A.insert_at(steps, _last_index(steps, is_dep) + 1, _items(CURE)))
            .otherwise(A.insert_at(steps, F.coalesce(consumer, F.size(steps)), _items("DEPOSIT PASSIVATION", CURE))))


def _ship_last(steps: Column) -> Column:
    def place(rest: Column) -> Column:
        sort = A.first_index(rest, _named(SORT))
        return (F.when(sort.isNull(), F.concat(rest, _items(SORT, SHIP)))
                .otherwise(A.insert_at(rest, sort + 1, _items(SHIP))))
    return let(F.filter(steps, lambda x: x["step"] != SHIP), place)


def _renumber(steps: Column) -> Column:
    is_align = lambda x: x["step"].startswith("ALIGN MASK LEVEL")
    def one(x: Column, i: Column) -> Column:
        level = F.size(F.filter(F.slice(steps, 1, i + 1), is_align))
        return F.when(is_align(x), F.struct(F.concat(F.lit("ALIGN MASK LEVEL "), level.cast("string")).alias("step"),
                                            x["mask"].alias("mask"), level.cast("int").alias("level"))).otherwise(x)
    return F.transform(steps, one)


def fix(steps: Column, rule: Column, at: Column) -> Column:
    """The steps after one repair of the given rule at the given position."""
    chain = F
    for name, items in INSERTED.items():
        chain = chain.when(rule == name, A.insert_at(steps, at, _items(*items)))
    return (chain.when(rule == "RULE_LITHO_LEVEL_SKIP", _renumber(steps))
            .when(rule == "RULE_SHIP_BEFORE_TEST", _ship_last(steps))
            .otherwise(_passivation_order(steps, at)))


def repair(df: DataFrame, steps: str, max_rounds: int = 30) -> DataFrame:
    """Add repaired, fixes (what was done), now_valid and remaining rules.

    steps and repaired are array<struct<step, mask, level>> with class masks.
    """
    start = F.struct(F.col(steps).cast(f"array<{STEP_TYPE}>").alias("steps"),
                     F.array().cast("array<string>").alias("fixes"), F.lit(True).alias("open"))

    def round_(state: Column, _: Column) -> Column:
        def apply(v: Column) -> Column:
            rule = rule_name(BOOK, v["rule_no"])
            def log(fixed: Column) -> Column:
                stuck = fixed == state["steps"]
                text = F.when(stuck, F.concat(F.lit("unresolved "), rule)).otherwise(
                    F.concat(rule, F.lit(" @ "), v["pos"].cast("string")))
                return F.struct(fixed.alias("steps"), F.concat(state["fixes"], F.array(text)).alias("fixes"),
                                (~stuck).alias("open"))
            return let(fix(state["steps"], rule, v["pos"]), log)
        closed = F.struct(state["steps"].alias("steps"), state["fixes"].alias("fixes"), F.lit(False).alias("open"))
        return F.when(~state["open"], state).otherwise(let(worst(array_violations(BOOK, state["steps"])), lambda v: F.when(
            v.isNull(), closed).otherwise(apply(v))))

    rounds = F.sequence(F.lit(1), F.lit(max_rounds))
    out = df.withColumn("__r", A.once(F.aggregate(rounds, start.cast(
        f"struct<steps:array<{STEP_TYPE}>,fixes:array<string>,open:boolean>"), round_)))
    left = F.transform(array_violations(BOOK, F.col("__r.steps")), lambda v: rule_name(BOOK, v["rule_no"]))
    return (out.withColumn("__left", A.once(F.array_sort(F.array_distinct(left))))
            .withColumns({"repaired": F.col("__r.steps"), "fixes": F.col("__r.fixes"),
                          "now_valid": F.size("__left") == 0, "remaining": F.col("__left")})
            .drop("__r", "__left"))


def certify(df: DataFrame, steps: str) -> DataFrame:
    """Add is_valid and the number of violations under the class rules."""
    n = F.size(array_violations(BOOK, F.col(steps)))
    return df.withColumn("n_violations", n).withColumn("is_valid", F.col("n_violations") == 0)


def fixes_for(rules: Sequence[str]) -> dict[str, str]:
    """What a repair does, per rule, for reports."""
    text = {r: "insert " + " and ".join(items) + " before the step" for r, items in INSERTED.items()}
    text["RULE_LITHO_LEVEL_SKIP"] = "number the mask levels 1, 2, 3, ..."
    text["RULE_SHIP_BEFORE_TEST"] = "move SHIP LOT behind WAFER SORT TEST"
    for r in ("RULE_PAD_OPEN_BEFORE_DEP", "RULE_TEST_BEFORE_PASSIVATION", "RULE_BACKSIDE_BEFORE_PASSIVATION"):
        text[r] = "deposit and cure passivation before the step"
    return {r: text.get(r, "no automatic fix") for r in rules}
