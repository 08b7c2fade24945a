"""Labelled test sets: violations injected into sequences, renamed and reshaped variants.

Injection works on one row per bounded segment, without a shuffle; random choices
are ordered by digests of the row's key, so they repeat exactly, in SQL too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.functions.arrays import let
from waymark.operators.ordered import running_state
from waymark.operators.rules import Level, array_violations, rule_name
from waymark.rulesets import fabrication as fab
from waymark.session import by_distinct


def injectors(steps: Column, name: Callable[[Column], Column] = lambda x: x) -> dict[str, Column]:
    """rule -> the steps with that rule broken, or NULL where it does not apply.

    Elements are step names, or anything of which ``name`` gives the step name.
    """
    def _among(values: Sequence[str]):
        return lambda x: name(x).isin(list(values))

    def _starts(prefix: str):
        return lambda x: name(x).startswith(prefix)

    out = {}
    for rule, triggers, removed, window in fab.REMOVALS:
        at = A.first_index(steps, _among(triggers))
        out[rule] = F.when(at.isNotNull(), A.remove_before(steps, at, _among(removed), window))

    metal = A.first_index(steps, _among(fab.METAL_ETCHES))
    masked = A.remove_before(steps, metal, _among(fab.DEVELOPS), 15)
    # the metal etch has moved, so its position is looked up again
    unlit = let(masked, lambda m: A.remove_before(m, A.first_index(m, _among(fab.METAL_ETCHES)),
                                                  _starts("EXPOSE LITHO LEVEL"), 15))
    out["RULE_METAL_ETCH_NO_LITHO"] = F.when(metal.isNotNull(), unlit)

    aligned = F.transform(steps, lambda s, i: F.when(name(s).startswith("ALIGN MASK LEVEL"), i))
    swapped = let(F.array_compact(aligned), lambda at: F.when(
        F.size(at) >= 2, A.swap(steps, F.get(at, F.lit(0)), F.get(at, F.lit(1)))))
    out["RULE_LITHO_LEVEL_SKIP"] = swapped
    for rule, moved, target in fab.MOVES:
        out[rule] = A.move_before(steps, A.first_index(steps, _among(moved)), A.first_index(steps, _among(target)))
    return {rule.rule: out[rule.rule] for rule in fab.EXACT.rules}


def constructed() -> dict[str, Column]:
    """rule -> a step that breaks it at the front of any sequence, as array<struct<step, mask, level>>.

    Nothing is in front of the first step, so what the step needs is missing whatever
    follows. A level can only be wrong after another one, so that rule has none.
    """
    return {rule.rule: S.literal_steps(fab.EXACT.events[rule.trigger][0]) for rule in fab.EXACT.rules if not isinstance(rule, Level)}


def digest_order(seed: int, *parts: Column | str) -> Column:
    """A text that orders rows or choices as if at random."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def inject(df: DataFrame, steps: str, key: Sequence[str], seed: int) -> DataFrame:
    """Add injected_steps and injected_rule: one violation per row, sure to fire.

    steps is an array<struct<step, mask, level>> with the masks of the exact rules.

    All injectors are tried, those whose own rule fires are kept, and the one
    that comes first in the digest order of the row is taken. Where none fires,
    as in a sequence without any step that needs another one, a step that needs one is
    put in front; its rule is chosen by digest too. So every row gets a violation.
    """
    variants = injectors(F.col(steps), lambda x: x["step"])
    names = {rule: f"__v_{i}" for i, rule in enumerate(variants)}
    tried = df.withColumn("__v", A.once(F.struct(*[v.alias(names[r]) for r, v in variants.items()])))
    tried = tried.select(*df.columns, "__v.*")

    def option(rule: str, changed: Column, kind: str) -> Column:
        return F.struct(digest_order(seed, *key, F.lit(rule), F.lit(kind)).alias("h"), F.lit(rule).alias("rule"), changed.alias("steps"))

    options = [F.when(F.size(array_violations(fab.EXACT, F.col(column), only=rule)) > 0, option(rule, F.col(column), "changed"))
               for rule, column in names.items()]
    made = [option(rule, F.concat(front, F.col(steps)), "made") for rule, front in constructed().items()]
    best = F.coalesce(F.array_min(F.array_compact(F.array(*options))), F.array_min(F.array(*made)))
    return (tried.withColumn("__best", A.once(best))
            .withColumns({"injected_steps": F.col("__best.steps"), "injected_rule": F.col("__best.rule")})
            .drop("__best", *names.values()))


def inject_by_class(steps: Column) -> Column:
    """struct<steps, rule> for any vocabulary, or NULL; steps are class steps.

    First the cleans before the first deposition are dropped; if that breaks
    nothing, the nearest develop before the first patterned etch is.
    """
    book = fab.BY_CLASS
    is_in = lambda event: (lambda x: book.has(x["mask"], event))

    def labelled(changed: Column) -> Column:
        return let(changed, lambda c: let(array_violations(book, c), lambda v: F.when(
            F.size(v) > 0, F.struct(c.alias("steps"), rule_name(book, F.get(v, F.lit(0))["rule_no"]).alias("rule")))))

    first_deposit = A.first_index(steps, is_in("DEPOSITION"))
    unclean = A.remove_before(steps, first_deposit, is_in("CLEAN_SURFACE"), 12)
    a = F.when(first_deposit.isNotNull() & (F.size(unclean) < F.size(steps)), labelled(unclean))
    etch = A.first_index(steps, is_in("PATTERNED_ETCH"))
    near = F.array_max(F.array_compact(F.transform(steps, lambda x, i: F.when(
        (i < etch) & (i >= etch - 12) & book.has(x["mask"], "DEVELOP"), i))))
    b = F.when(near.isNotNull(), labelled(A.drop_at(steps, near)))
    return F.coalesce(a, b)


# -- data sets -------------------------------------------------------------------------------

def anomaly_rows(df: DataFrame, family: str, key: Sequence[str], steps: str, n_valid: int, n_invalid: int,
                 seed: int, hot_rows: int | None = None) -> DataFrame:
    """Per family: n_valid sequences as they are (all, if fewer) and exactly n_invalid injected ones.

    Injected rows are made from the sequences left over, used in turn; if none
    are left over, from all of them.
    """
    shuffled = df.withColumn("__h", digest_order(seed, *key))
    ranked = running_state(shuffled, [family], ["__h", *key], index="__r", total="__n", hot_rows=hot_rows)
    valid = ranked.filter(F.col("__r") < n_valid).select(
        F.format_string("%s_valid_%04d", family, "__r").alias("example_id"), family,
        F.col(steps).alias("steps"), F.lit(1).alias("is_valid"), F.lit("").alias("rule"))
    rest = F.col("__n") > n_valid
    place = F.when(rest, F.col("__r") - n_valid).otherwise(F.col("__r"))
    pool = F.when(rest, F.col("__n") - n_valid).otherwise(F.col("__n"))
    bases = (ranked.withColumns({"__p": place, "__pool": pool})
             .filter((F.col("__p") >= 0) & (F.col("__p") < n_invalid))
             .withColumn("__i", F.explode(F.sequence(F.col("__p"), F.lit(n_invalid - 1).cast("bigint"), F.col("__pool")))))
    broken = inject(bases, steps, [*key, "__i"], seed)
    invalid = broken.select(
        F.format_string("%s_inval_%04d", family, "__i").alias("example_id"), family,
        F.col("injected_steps").alias("steps"), F.lit(0).alias("is_valid"), F.col("injected_rule").alias("rule"))
    return valid.unionByName(invalid)


def training_twins(df: DataFrame, key: Sequence[str], family: str, steps: str, seed: int) -> DataFrame:
    """Each valid sequence and an injected copy of it; sequences already broken are left out."""
    checked = df.filter(F.size(array_violations(fab.EXACT, F.col(steps))) == 0)
    both = inject(checked, steps, key, seed)
    twins = F.array(
        F.struct(F.col(steps).alias("steps"), F.lit(1).alias("is_valid"), F.lit("").alias("rule")),
        F.struct(F.col("injected_steps").alias("steps"), F.lit(0).alias("is_valid"),
                 F.col("injected_rule").alias("rule")))
    return both.select(*key, family, F.explode(twins).alias("t")).filter("t.steps IS NOT NULL").select(
        *key, family, "t.*")


def _unit(*columns: Column) -> Column:
    """A hashed uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / float(1 << 20)


def add_steps(steps: Column, *key: Column) -> Column:
    """Insert up to three cleans and maybe a second metal cycle at the next mask level."""
    def with_cleans(values: Column) -> Column:
        n = F.when(F.size(values) < 3, 0).otherwise(F.floor(_unit(F.lit("cleans"), *key) * 4))
        def insert(acc: Column, k: Column) -> Column:
            at = 1 + F.floor(_unit(F.lit("at"), k, *key) * (F.size(acc) - 1)).cast("int")
            return F.when(k <= n, A.insert_at(acc, at, S.literal_steps("CLEAN AFTER ETCH"))).otherwise(acc)
        return F.aggregate(F.array(*[F.lit(k) for k in (1, 2, 3)]), values, insert)

    def with_cycle(values: Column) -> Column:
        level = F.coalesce(F.array_max(F.transform(values, lambda x: x["level"])), F.lit(0)) + 1
        anchor = F.array_max(F.array_compact(F.transform(
            values, lambda x, i: F.when(x["step"] == "CLEAN AFTER METAL ETCH", i))))
        constants = S.literal_steps(*fab.SECOND_METAL_CYCLE)
        cycle = F.transform(constants, lambda x: F.struct(
            F.replace(x["step"], F.lit("{n}"), level.cast("string")).alias("step"), x["mask"].alias("mask"),
            F.when(x["step"].startswith("ALIGN"), level).cast("int").alias("level")))
        wanted = (_unit(F.lit("cycle"), *key) < 0.5) & anchor.isNotNull()
        return F.when(wanted, A.insert_at(values, anchor + 1, cycle)).otherwise(values)

    return let(let(steps, with_cleans), with_cycle)


def novel_variants(df: DataFrame, key: Sequence[str], steps: str, tag: str, fractions: Sequence[float],
                   structural: bool = True) -> DataFrame:
    """Variants with new names (and, for half of them, a new shape) that break no class rule.

    df has arrays of step names; the result one row per input row and rename
    fraction with steps as array<struct<step, mask, level>>. Of the distinct
    eligible names of a row max(1, round(fraction * count)) are renamed, in hash
    order. Names are classified once per distinct name, on exploded rows.
    """
    keys = [*key, "rename_fraction"]
    cols = [F.col(k) for k in keys]
    rows = df.select(*key, F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("rename_fraction"),
                     F.col(steps).alias("__s")).select(*keys, F.posexplode("__s").alias("pos", "step"))

    def name_columns(names: DataFrame) -> DataFrame:
        kinds = names.withColumn("category", S.category(F.col("step")))
        return kinds.withColumns({"eligible": S.may_rename(F.col("step"), F.col("category")),
                                  "new_step": S.rename(F.col("step"), F.col("category"), F.lit(tag))})

    named = by_distinct(rows, "step", name_columns)
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("step", *cols), "step")
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    chosen = (named.filter("eligible").select(*keys, "step", "new_step").distinct()
              .withColumns({"__r": F.row_number().over(order), "__n": count})
              .filter(F.col("__r") <= F.greatest(F.lit(1), F.bround(F.col("rename_fraction") * F.col("__n"))))
              .select(*keys, "step", F.col("new_step").alias("chosen")))
    out = named.join(chosen, [*keys, "step"], "left").withColumn("step", F.coalesce("chosen", "step"))
    half = _unit(F.lit("shape"), *cols) < 0.5
    if structural:
        lost = half & F.col("category").isin("MEASURE", "INSPECT", "PATTERN_INSPECT") & (
            _unit(F.lit("drop"), "pos", *cols) < 0.3)
        out = out.filter(~lost)
    arrays = collect_steps(S.with_classes(out.select(*keys, "pos", "step")), keys, fab.BY_CLASS)
    if structural:
        arrays = arrays.withColumn("steps", A.once(
            F.when(half, add_steps(F.col("steps"), *cols)).otherwise(F.col("steps"))))
    return arrays.filter(F.size(array_violations(fab.BY_CLASS, F.col("steps"))) == 0).withColumn("tag", F.lit(tag))


def collect_steps(rows: DataFrame, keys: Sequence[str], book, mask: str = "class_mask", pos: str = "pos") -> DataFrame:
    """Exploded rows of bounded segments back to array<struct<step, mask, level>>."""
    item = F.struct(F.col(pos).alias("i"), F.col("step"), F.col(mask).alias("mask"),
                    book.level_of(F.col("step")).alias("level"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(
        x["step"].alias("step"), x["mask"].alias("mask"), x["level"].alias("level"))).alias("steps"))
