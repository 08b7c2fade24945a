"""Sequence rules declared as data and compiled to column expressions.

A RuleBook names event classes and rules over them. The same book is evaluated
in two forms: over long rows (any length, by ``running_state``) and over arrays
of steps (bounded segments, no shuffle), which the injectors and the repair and
completion loops use.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from waymark.functions.arrays import let
from waymark.operators.ordered import running_state


@dataclass(frozen=True)
class Windowed:
    """The trigger needs each (event, n): the event within the n steps before."""
    rule: str
    trigger: str
    needs: Sequence[tuple[str, int]]
    severity: int = 1
    reason: str = ""


@dataclass(frozen=True)
class Milestone:
    """The trigger needs each event to have happened at any earlier step."""
    rule: str
    trigger: str
    needs: Sequence[str]
    severity: int = 1
    reason: str = ""


@dataclass(frozen=True)
class FirstOf(Milestone):
    """Like Milestone, for the first trigger of a sequence only."""


@dataclass(frozen=True)
class Level:
    """Numbers in matching steps may stay or grow by one."""
    rule: str
    prefix: str
    pattern: str
    ignore_zero: bool = False
    severity: int = 1
    reason: str = ""


@dataclass(frozen=True)
class RuleBook:
    """Event classes and rules.

    events maps a name to step names (a trailing ``*`` makes a prefix), to a
    function from the step column to a boolean column, or to None where the mask
    column is made elsewhere. Rules count in list order for attribution, before
    the position (default) or after it (step_major).
    """
    events: dict[str, object]
    rules: Sequence[object]
    step_major: bool = False
    bits: dict[str, int] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "bits", {n: 1 << i for i, n in enumerate(self.events)})

    @property
    def level(self) -> Level | None:
        return next((r for r in self.rules if isinstance(r, Level)), None)

    @property
    def enablers(self) -> list[str]:
        names = [e for r in self.rules if isinstance(r, Windowed) for e, _ in r.needs]
        names += [e for r in self.rules if isinstance(r, Milestone) for e in r.needs]
        names += [r.trigger for r in self.rules if isinstance(r, FirstOf)]
        return list(dict.fromkeys(names))

    def mask(self, step: Column) -> Column:
        """The event classes of a step as one integer."""
        parts = [F.when(member(kind, step), bit).otherwise(0)
                 for (name, kind), bit in zip(self.events.items(), self.bits.values())]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    def level_of(self, step: Column) -> Column:
        """The level number of a step, or NULL."""
        if self.level is None:
            return F.lit(None).cast("int")
        number = F.regexp_extract(step, self.level.pattern, 1)
        return F.when(step.startswith(self.level.prefix) & (number != ""), number.cast("int"))

    def has(self, mask: Column, event: str) -> Column:
        return mask.bitwiseAND(F.lit(self.bits[event])) != 0


def member(kind: object, step: Column) -> Column:
    if callable(kind):
        return kind(step)
    names = [n for n in kind if not n.endswith("*")]
    tests = [step.isin(names)] if names else []
    tests += [step.startswith(n[:-1]) for n in kind if n.endswith("*")]
    return reduce(lambda a, b: a | b, tests)


# -- one place for the meaning of every rule -------------------------------------

def fires(book: RuleBook, rule, mask: Column, level: Column, position: Column,
          last: Callable[[str], Column], previous_level: Column) -> Column:
    """True where the step breaks the rule, given the state before the step."""
    if isinstance(rule, Windowed):
        near = [F.coalesce(position - last(e) <= n, F.lit(False)) for e, n in rule.needs]
        return book.has(mask, rule.trigger) & ~reduce(lambda a, b: a & b, near)
    if isinstance(rule, Level):
        return _moved(rule, level, previous_level)
    missing = reduce(lambda a, b: a | b, [last(e).isNull() for e in rule.needs])
    broken = book.has(mask, rule.trigger) & missing
    return broken & last(rule.trigger).isNull() if isinstance(rule, FirstOf) else broken


def describe(rule, step: Column, level: Column, previous_level: Column) -> Column:
    """What is wrong, in words."""
    if isinstance(rule, Windowed):
        wanted = " and ".join(f"{e} within {n} steps" for e, n in rule.needs)
        return F.format_string(f"'%s' needs {wanted} before it", step)
    if isinstance(rule, Level):
        return F.when(level > previous_level, F.format_string("level jumps from %d to %d", previous_level, level)) \
            .otherwise(F.format_string("level falls from %d to %d", previous_level, level))
    return F.format_string(f"'%s' needs {' and '.join(rule.needs)} before it", step)


# -- long rows ----------------------------------------------------------------------

def with_state(df: DataFrame, book: RuleBook, keys: Sequence[str], order: Sequence[str], *,
               step: str = "step", mask: Column | None = None, lags=None, sums=None, total: str | None = None,
               hot_rows: int | None = None) -> DataFrame:
    """Long rows with mask, level, position and the state before each step."""
    marked = df.withColumns({"mask": book.mask(F.col(step)) if mask is None else mask,
                             "level": book.level_of(F.col(step))})
    values = {}
    if book.level is not None:
        values["previous_level"] = (F.col("level").isNotNull(), F.col("level"))
    out = running_state(
        marked, keys, order, total=total, lags=lags, sums=sums, hot_rows=hot_rows, values=values,
        last={f"last_{e}": book.has(F.col("mask"), e) for e in book.enablers})
    return out if values else out.withColumn("previous_level", F.lit(None).cast("int"))


def any_broken(book: RuleBook) -> Column:
    """True where a row of ``with_state`` breaks any rule."""
    tests = [fires(book, rule, F.col("mask"), F.col("level"), F.col("step_index"), lambda e: F.col(f"last_{e}"),
                   F.col("previous_level")) for rule in book.rules]
    return reduce(lambda a, b: a | b, tests)


def violations(state: DataFrame, book: RuleBook, keys: Sequence[str], *, step: str = "step") -> DataFrame:
    """One row per broken rule: keys, rule, rule_ord, step_index, step, severity, description, reason."""
    level, previous = F.col("level"), F.col("previous_level")
    found = []
    for i, rule in enumerate(book.rules, 1):
        hit = fires(book, rule, F.col("mask"), level, F.col("step_index"), lambda e: F.col(f"last_{e}"), previous)
        found.append(F.when(hit, F.struct(
            F.lit(rule.rule).alias("rule"), F.lit(i).alias("rule_ord"),
            F.lit(rule.severity).alias("severity"),
            describe(rule, F.col(step), level, previous).alias("description"),
            F.lit(rule.reason).alias("reason"))))
    exploded = state.select(*keys, "step_index", step, F.explode(F.array_compact(F.array(*found))).alias("v"))
    return exploded.select(*keys, "v.rule", "v.rule_ord", "step_index", step, "v.severity", "v.description",
                           "v.reason")


def check(df: DataFrame, book: RuleBook, keys: Sequence[str], order: Sequence[str], **options) -> DataFrame:
    return violations(with_state(df, book, keys, order, **options), book, keys,
                      step=options.get("step", "step"))


def attribution_order(book: RuleBook) -> Column:
    """Smallest value = the violation a sequence is attributed to."""
    first = ["step_index", "rule_ord"] if book.step_major else ["rule_ord", "step_index"]
    return F.struct(*[F.col(c).cast("bigint").alias(c) for c in first])


def first_violation(found: DataFrame, book: RuleBook, keys: Sequence[str]) -> DataFrame:
    best = F.min(F.struct(attribution_order(book).alias("at"), F.col("rule"), F.col("step_index"))).alias("v")
    return found.groupBy(*keys).agg(best).select(*keys, "v.rule", "v.step_index")


def oracle(found: DataFrame, sequences: DataFrame, book: RuleBook, keys: Sequence[str]) -> DataFrame:
    """keys, is_valid (1 or 0) and the attributed rule ('' if valid) of every sequence."""
    first = first_violation(found, book, keys).select(*keys, "rule")
    joined = sequences.select(*keys).distinct().join(first, list(keys), "left")
    return joined.select(*keys, F.col("rule").isNull().cast("int").alias("is_valid"),
                         F.coalesce("rule", F.lit("")).alias("rule"))


def violation_text() -> Column:
    """'[rule] step i ('name'): description' of a row of ``violations``."""
    return F.format_string("[%s] step %d ('%s'): %s", "rule", "step_index", "step", "description")


def report(found: DataFrame, sequences: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sequence: validity, number of violations, its distinct rules in order.

    Distinct rules are bounded by the rule book, so nothing here grows with the
    length of a sequence.
    """
    per_rule = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_violations"),
                                        F.array_sort(F.collect_set("rule")).alias("rules"))
    joined = sequences.select(*keys).distinct().join(per_rule, list(keys), "left")
    return joined.select(
        *keys, F.col("n_violations").isNull().alias("is_valid"),
        F.coalesce("n_violations", F.lit(0)).alias("n_violations"),
        F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


# -- arrays of steps ---------------------------------------------------------------------

def array_violations(book: RuleBook, column: Column, only: str | None = None) -> Column:
    """Violations of an array<struct<step, mask, level>> as an ordered array.

    Elements are struct<a, b, rule_no, severity, pos, step>, (a, b) being the order of
    attribution; pos is 0-based. Everything stays in one row. With ``only``, one
    rule is checked.
    """
    def hits(i: int, rule, masks: Column) -> Column:
        def one(x: Column, p: Column) -> Column:
            if isinstance(rule, Windowed):
                broken = book.has(x["mask"], rule.trigger) & ~reduce(
                    lambda a, b: a & b, [_seen(book, masks, e, p, n) for e, n in rule.needs])
            elif isinstance(rule, Level):
                prior = F.filter(F.slice(column, 1, p), lambda y: y["level"].isNotNull())
                broken = let(F.try_element_at(prior, F.lit(-1))["level"], lambda before: _moved(
                    rule, x["level"], before))
                broken = x["level"].isNotNull() & broken
            else:
                broken = book.has(x["mask"], rule.trigger) & ~reduce(
                    lambda a, b: a & b, [_seen(book, masks, e, p, None) for e in rule.needs])
                if isinstance(rule, FirstOf):
                    broken = broken & ~_seen(book, masks, rule.trigger, p, None)
            rank = (p.cast("bigint"), F.lit(i).cast("bigint"))
            a, b = rank if book.step_major else rank[::-1]
            return F.when(broken, F.struct(a.alias("a"), b.alias("b"), F.lit(i).alias("rule_no"),
                                           F.lit(rule.severity).alias("severity"), p.alias("pos"),
                                           x["step"].alias("step")))
        return F.transform(column, one)

    return let(F.transform(column, lambda x: x["mask"]), lambda masks: F.array_sort(F.array_compact(
        F.concat(*[hits(i, rule, masks) for i, rule in enumerate(book.rules, 1)
                   if only is None or rule.rule == only]))))


def _moved(rule: Level, level: Column, before: Column) -> Column:
    moved = (level > before + 1) | (level < before)
    return F.coalesce(moved & (before > 0) if rule.ignore_zero else moved, F.lit(False))


def _seen(book: RuleBook, masks: Column, event: str, p: Column, within: int | None) -> Column:
    earlier = F.slice(masks, 1, p) if within is None else \
        F.slice(masks, F.greatest(p - within, F.lit(0)) + 1, F.least(p, F.lit(within)))
    return F.exists(earlier, lambda m: book.has(m, event))


def rule_name(book: RuleBook, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r.rule) for r in book.rules]), number)


# -- one step after another, where a keyed task gets them in order ---------------------------------

class Fold:
    """One sequence: feed it steps in order, it names the rules each one breaks."""

    def __init__(self, book: RuleBook):
        self.names = book.enablers
        self.bits = [book.bits[e] for e in self.names]
        self.place = {e: i for i, e in enumerate(self.names)}
        self.rules, self.trigger = book.rules, book.bits

    def broken(self, position: int, last: list[int], level: int | None, mask: int, new_level: int | None):
        """The rules that a step breaks, given the position, the last position of each enabler (-1: none) and the last level."""
        for rule in self.rules:
            if isinstance(rule, Level):
                moves = level is not None and new_level is not None and (level > 0 or not rule.ignore_zero)
                if moves and (new_level > level + 1 or new_level < level):
                    yield rule.rule
                continue
            if not mask & self.trigger[rule.trigger]:
                continue
            if isinstance(rule, Windowed):
                near = [last[self.place[e]] for e, _ in rule.needs]
                if any(at < 0 or position - at > n for at, (_, n) in zip(near, rule.needs)):
                    yield rule.rule
            elif isinstance(rule, Milestone):
                first = not isinstance(rule, FirstOf) or last[self.place[rule.trigger]] < 0
                if first and any(last[self.place[e]] < 0 for e in rule.needs):
                    yield rule.rule


def findings_function(book: RuleBook):
    """A table function for SQL: the broken rules of each partition of its table argument, as the rows come.

    Register it with ``spark.udtf.register`` and call it on a table that has the columns
    step, mask and level, partitioned and ordered by the caller:

        SELECT * FROM findings(TABLE(steps) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id')

    The result has the named column, rule, rule_ord, step_index, step and severity. Only the
    fold's few numbers are kept of the rows that have passed.
    """
    fold = Fold(book)
    numbers = {rule.rule: (i, rule.severity) for i, rule in enumerate(book.rules, 1)}

    @udtf
    class Findings:
        def __init__(self):
            self.position, self.last, self.level = 0, [-1] * len(fold.names), None

        @staticmethod
        def analyze(table: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in table.dataType.fields} if table.isTable else {}
            missing = {"step", "mask", "level", key.value} - set(kinds)
            if missing:
                raise ValueError(f"the table argument has no column {', '.join(sorted(map(str, missing)))}")
            return AnalyzeResult(T.StructType().add(key.value, kinds[key.value]).add("rule", T.StringType()).add("rule_ord", T.IntegerType())
                                 .add("step_index", T.LongType()).add("step", T.StringType()).add("severity", T.IntegerType()))

        def eval(self, row, key):
            mask, level = row["mask"], row["level"]
            for rule in fold.broken(self.position, self.last, self.level, mask, level):
                yield row[key], rule, numbers[rule][0], self.position, row["step"], numbers[rule][1]
            for i, bit in enumerate(fold.bits):
                if mask & bit:
                    self.last[i] = self.position
            self.level = self.level if level is None else level
            self.position += 1

    return Findings


# -- rules as a graph ------------------------------------------------------------------------

def causal_edges(book: RuleBook, spark) -> DataFrame:
    """Enabler -> trigger edges of a book; window is NULL for milestones."""
    rows = []
    for rule in book.rules:
        if isinstance(rule, Windowed):
            rows += [(e, rule.trigger, rule.rule, n, "needs-within", rule.reason) for e, n in rule.needs]
        elif isinstance(rule, Milestone):
            rows += [(e, rule.trigger, rule.rule, None, "needs-before", rule.reason) for e in rule.needs]
    return spark.createDataFrame(rows, "source string, target string, rule string, window int, "
                                       "kind string, why string")
