"""Column functions on step names: spelling, category, flags, events, blocks."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from waymark.rulesets import fabrication as fab
from waymark.session import by_distinct


def canonical(step: Column) -> Column:
    """Upper case, trimmed, inner white space as one blank."""
    return F.upper(F.trim(F.regexp_replace(step, r"\s+", " ")))


def to_token(step: Column) -> Column:
    return F.translate(F.trim(step), " ", "_")


def from_token(token: Column) -> Column:
    """Inverse of to_token for names without an underscore of their own."""
    return F.translate(token, "_", " ")


def lookup(mapping: dict[str, str], key: Column, default: Column) -> Column:
    """Value for key from a fixed mapping, else default."""
    by_value: dict[str, list[str]] = {}
    for k, v in mapping.items():
        by_value.setdefault(v, []).append(k)
    chain = F
    for value, names in by_value.items():
        chain = chain.when(key.isin(names), F.lit(value))
    return chain.otherwise(default)


def canonical_synonym(step: Column, synonyms: dict[str, str] | None = None, enabled: bool = True) -> Column:
    """One pass of synonym -> canonical name; off leaves the step as it is."""
    return lookup(synonyms or fab.SYNONYMS, step, step) if enabled else step


def category(step: Column, exact=None, prefixes=None, keywords=None) -> Column:
    """Exact name, then first prefix, then first keyword, else UNKNOWN."""
    exact = fab.CATEGORY_STEPS if exact is None else exact
    upper, chain = F.upper(step), F
    for name, steps in exact.items():
        chain = chain.when(step.isin(steps), F.lit(name))
    for prefix, name in fab.CATEGORY_PREFIXES if prefixes is None else prefixes:
        chain = chain.when(upper.startswith(prefix), F.lit(name))
    for word, name in fab.CATEGORY_KEYWORDS if keywords is None else keywords:
        chain = chain.when(upper.contains(word), F.lit(name))
    return chain.otherwise(F.lit("UNKNOWN"))


def is_categorised(step: Column) -> Column:
    return step.isin(fab.CATEGORISED)


def in_vocabulary(step: Column) -> Column:
    return step.isin(fab.VOCABULARY)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def flag(name: str, step: Column, cat: Column) -> Column:
    """One feature flag of a step with its category."""
    up = F.upper(step)
    coat = up.contains("SPIN COAT") | up.contains("COAT PHOTORESIST")
    litho = cat == "LITHO"
    expose = litho & ~coat & up.contains("EXPOSE")
    develop = litho & ~coat & ~up.contains("EXPOSE") & up.contains("DEVELOP")
    bake = (litho & ~coat & ~up.contains("EXPOSE") & ~up.contains("DEVELOP")
            & up.contains("BAKE"))
    base = cat.isin([c for c, names in fab.CATEGORY_FLAGS.items() if name in names])
    deposit, cure = cat == "DEPOSIT", up == "CURE PASSIVATION"
    oxidation, ship = up == "THERMAL OXIDATION", up.contains("SHIP LOT")
    return {
        "coats_resist": litho & coat,
        "needs_resist_present": expose | bake,
        "exposes_resist": expose,
        "advances_litho_level": expose & (up.contains("ALIGN MASK LEVEL")
                                          | up.contains("EXPOSE LITHO LEVEL")),
        "needs_resist_exposed": develop, "develops_resist": develop,
        "opens_implant_window": base | develop,
        "marks_passivation_exist": deposit & up.contains("PASSIVATION"),
        "needs_passivation_cured": base | (deposit & up.contains("BACKSIDE METAL")),
        "needs_passivation_exist": cure, "marks_passivation_cured": cure,
        "activates_dopants": base & ~cure,
        "marks_sort_done": up.contains("WAFER SORT TEST"),
        "needs_sort_done": ship, "is_logistics_only": base | ship,
        "makes_surface_dirty": base & ~oxidation, "makes_surface_clean": base | oxidation,
    }.get(name, base)


def feature_flags(step: Column, cat: Column) -> dict[str, Column]:
    return {name: flag(name, step, cat) for name in fab.FLAGS}


def in_event(event: str, step: Column, cat: Column, known: Column | None = None) -> Column:
    """Event membership: prefix, or the name list if known, or what the name suggests."""
    known = is_categorised(step) if known is None else known
    up = F.upper(step)
    by_prefix = _any([up.startswith(p) for p in fab.EVENT_PREFIXES.get(event, [])])
    names = fab.EXACT.events[event]
    listed = step.isin([n for n in names if not n.endswith("*")])
    return by_prefix | F.when(known, listed).otherwise(_suggested(event, step, cat))


def _suggested(event: str, step: Column, cat: Column) -> Column:
    hints, up = fab.UNKNOWN_EVENTS[event], F.upper(step)
    tests = []
    if "categories" in hints:
        tests.append(cat.isin(hints["categories"]))
    if "words" in hints:
        words = F.split(up, r"\s+")
        groups = _any([reduce(lambda a, b: a & b, [F.array_contains(words, w) for w in g]) for g in hints["words"]])
        tests.append(cat.isin(hints["word_categories"]) & groups)
    tests += [flag(f, step, cat) for f in hints.get("flags", [])]
    tests += [_suggested(e, step, cat) for e in hints.get("events", [])]
    return _any(tests)


def reaches(milestone: str, step: Column) -> Column:
    """Milestone set by its exact names or by telling words."""
    up = F.upper(step)
    stem, others = fab.MILESTONE_WORDS[milestone]
    return up.isin(fab.EXACT.events[milestone]) | (
        up.contains(stem) & _any([up.contains(o) for o in others]))


def class_mask(step: Column, cat: Column, known: Column) -> Column:
    """Event classes and milestones of any step name as one integer."""
    parts = []
    for name, bit in fab.BY_CLASS.bits.items():
        test = reaches(name, step) if name in fab.MILESTONE_WORDS else in_event(name, step, cat, known)
        parts.append(F.when(test, bit).otherwise(0))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def with_classes(df: DataFrame, step: str = "step") -> DataFrame:
    """Add the category and the class mask of a step column, judged once per distinct name."""
    kind, known, mask = _class_columns(step, df.sparkSession.sparkContext.applicationId)

    def build(names: DataFrame) -> DataFrame:
        return (names.withColumns({"category": kind, "known_name": known}).withColumn("class_mask", mask)
                .drop("known_name"))
    return by_distinct(df, step, build)


@lru_cache(maxsize=16)
def _class_columns(step: str, application: str) -> tuple[Column, Column, Column]:
    """The expressions of with_classes; building them takes long enough to keep them."""
    name = F.col(step)
    return category(name), is_categorised(name), class_mask(name, F.col("category"), F.col("known_name"))


def literal_steps(*names: str) -> Column:
    """array<struct<step, mask, level>> of names from the vocabulary, as a constant."""
    items = []
    for name in names:
        level = re.search(r"^ALIGN MASK LEVEL.*?(\d+)$", name)
        items.append(F.struct(F.lit(name).alias("step"), F.lit(_mask_of_known(name)).alias("mask"),
                              F.lit(int(level.group(1)) if level else None).cast("int").alias("level")))
    return F.array(*items)


def _mask_of_known(name: str) -> int:
    listed = lambda kind: any(name.startswith(n[:-1]) if n.endswith("*") else name == n for n in kind)
    return sum(bit for event, bit in fab.BY_CLASS.bits.items() if listed(fab.EXACT.events[event]))


def block(step: Column) -> Column:
    """Coarse block of a step, the first matching test decides."""
    up, chain = F.upper(step), F
    for name, parts, starts in fab.BLOCKS:
        tests = [up.contains(p) for p in parts] + [up.startswith(p) for p in starts]
        chain = chain.when(_any(tests), F.lit(name))
    return chain.otherwise(F.lit("OTHER"))


def first_word(step: Column) -> Column:
    return F.element_at(F.split(F.trim(step), r"\s+"), 1)


def rename(step: Column, cat: Column, tag: Column) -> Column:
    """A new name in the same category; steps without a template keep theirs."""
    words = F.split(step, " ")
    core = F.when(F.element_at(words, 1).isin(fab.RENAME_VERBS) & (F.size(words) > 1),
                  F.array_join(F.slice(words, 2, F.size(words) - 1), " ")).otherwise(step)
    chain = F.when(~may_rename(step, cat), step)
    for name, template in fab.RENAME_TEMPLATES.items():
        filled = F.replace(F.replace(F.lit(template), F.lit("{tag}"), tag), F.lit("{core}"), core)
        chain = chain.when(cat == name, F.trim(F.regexp_replace(filled, r"\s+", " ")))
    return chain.otherwise(step)


def may_rename(step: Column, cat: Column) -> Column:
    return (~step.isin(fab.RENAME_KEEP) & ~cat.isin(fab.RENAME_KEEP_CATEGORIES)
            & cat.isin(list(fab.RENAME_TEMPLATES)))


def family_of(example_id: Column) -> Column:
    return F.upper(F.element_at(F.split(example_id, "_"), 1))


def humanize(name: Column) -> Column:
    """Display name of a feature; other names get blanks and capital initials."""
    words = F.transform(F.split(F.translate(name, "_", " "), r"(?<=\W)"),
                        lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    chain = F
    for key, label in fab.FEATURE_NAMES.items():
        chain = chain.when(name == key, F.lit(label))
    return chain.otherwise(F.array_join(words, ""))
