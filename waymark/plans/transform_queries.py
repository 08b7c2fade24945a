"""Injected, renamed, repaired and completed sequences; merged groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.operators import components, decode, inject, mining as M, repair
from waymark.operators.ordered import running_state
from waymark.operators.rules import Milestone, Windowed, any_broken, array_violations, rule_name, with_state
from waymark.plans.inputs import (ORDER, ROUTES, ROUTE_SEGMENTS, classed_segments, names, route_segments, routes,
                                  table)
from waymark.plans.registry import query
from waymark.plans.score_queries import FRACTIONS, NGRAMS
from waymark.plans.sql_text import CLASS_FLAGS, CLASS_VIOLATIONS, exact_violations
from waymark.rulesets import fabrication as fab
from waymark.session import by_distinct, cut_lineage, small

KEYS = ["user_id", "family"]


# -- single injectors ---------------------------------------------------------------------

def _first_sql(values, start: str = "") -> str:
    test = f"starts_with(steps[i], '{start}')" if start else f"steps[i] IN ({names(values)})"
    return f"list_min(list_filter(range(1, CAST(len(steps) AS BIGINT) + 1), lambda i: {test}))"


def _injected(name: str, rule: str, sql: str):
    @query(name, sql)
    def plan(spark, sf):
        steps = inject.injectors(F.col("steps"))[rule]
        return (route_segments(spark, sf).withColumn("changed", steps).filter("changed IS NOT NULL")
                .select("user_id", "segment", F.array_join("changed", "|").alias("steps")))
    return plan


for _rule, _triggers, _removed, _window in fab.REMOVALS:
    _injected("inject_" + _rule[5:].lower(), _rule, f"""WITH {ROUTES}, {ROUTE_SEGMENTS},
a AS (SELECT *, {_first_sql(_triggers)} AS pos FROM s)
SELECT user_id, segment, array_to_string(list_transform(list_filter(range(1, CAST(len(steps) AS BIGINT) + 1), lambda i:
  NOT (i >= pos - {_window} AND i < pos AND steps[i] IN ({names(_removed)}))), lambda i: steps[i]), '|') AS steps
FROM a WHERE pos IS NOT NULL""")
for _rule, _moved, _target in fab.MOVES:
    _injected("inject_" + _rule[5:].lower(), _rule, f"""WITH {ROUTES}, {ROUTE_SEGMENTS},
a AS (SELECT *, {_first_sql(_moved)} AS src, {_first_sql(_target)} AS dst FROM s)
SELECT user_id, segment, array_to_string(list_concat(list_concat(list_concat(steps[1:dst - 1], [steps[src]]),
  steps[dst:src - 1]), steps[src + 1:]), '|') AS steps FROM a WHERE src > dst""")
_injected("inject_litho_level_skip", "RULE_LITHO_LEVEL_SKIP", f"""WITH {ROUTES}, {ROUTE_SEGMENTS},
a AS (SELECT *, list_filter(range(1, CAST(len(steps) AS BIGINT) + 1),
  lambda i: starts_with(steps[i], 'ALIGN MASK LEVEL')) AS pos FROM s)
SELECT user_id, segment, array_to_string(list_transform(range(1, CAST(len(steps) AS BIGINT) + 1), lambda i:
  CASE WHEN i = pos[1] THEN steps[pos[2]] WHEN i = pos[2] THEN steps[pos[1]] ELSE steps[i] END), '|') AS steps
FROM a WHERE len(pos) >= 2""")
_injected("inject_metal_etch_no_litho", "RULE_METAL_ETCH_NO_LITHO", f"""WITH {ROUTES}, {ROUTE_SEGMENTS},
a AS (SELECT user_id, segment, steps, {_first_sql(fab.METAL_ETCHES)} AS pos FROM s),
b AS (SELECT user_id, segment, list_transform(list_filter(range(1, CAST(len(steps) AS BIGINT) + 1), lambda i:
  NOT (i >= pos - 15 AND i < pos AND steps[i] IN ({names(fab.DEVELOPS)}))), lambda i: steps[i]) AS steps
  FROM a WHERE pos IS NOT NULL),
c AS (SELECT *, {_first_sql(fab.METAL_ETCHES)} AS pos FROM b)
SELECT user_id, segment, array_to_string(list_transform(list_filter(range(1, CAST(len(steps) AS BIGINT) + 1), lambda i:
  NOT (starts_with(steps[i], 'EXPOSE LITHO LEVEL') AND i < pos AND pos - i <= 15)), lambda i: steps[i]), '|') AS steps
FROM c""")


# -- data sets with hash-ordered choices ---------------------------------------------------------

def step_names(column: str):
    return F.array_join(F.transform(column, lambda x: x["step"]), "|")


def repaired(spark, sf):
    """Names of the route segments after repair, those that became valid.

    Written once, because the callers read it for the distinct names and again for the rows.
    """
    fixed = repair.repair(classed_segments(spark, sf, fab.BY_CLASS), "steps").filter("now_valid")
    return cut_lineage(fixed.select("user_id", "segment", "family",
                                    F.transform("repaired", lambda x: x["step"]).alias("steps")))


# Canonical routes as whole lists, every injector's variant of each base row (key, family, steps, seed of its
# digests), its violations under the exact rules, and the variant or the step put in front that comes first.
CANONICAL = """jc AS (SELECT user_id, family, step_index, upper(trim(regexp_replace(step, '\\s+', ' ', 'g'))) AS step FROM j),
s AS (SELECT user_id, family, list(step ORDER BY step_index) AS steps FROM jc GROUP BY 1, 2)"""
_RULE_NUMBERS = {r.rule: n for n, r in enumerate(fab.EXACT.rules, 1)}
_POSITIONS = "range(1, CAST(len(steps) AS BIGINT) + 1)"


def _digest(rule: str, kind: str) -> str:
    return f"md5(concat_ws('|', seed, key, {rule}, '{kind}'))"


def injected_sql(bases: str) -> str:
    """CTEs that end in `injected` (key, family, rule, steps) of the CTE named by bases."""
    variants = []
    for rule, triggers, removed, window in fab.REMOVALS:
        variants.append(f"""SELECT key, family, seed, '{rule}' AS rule, list_transform(list_filter({_POSITIONS}, lambda i:
  NOT (i >= pos - {window} AND i < pos AND steps[i] IN ({names(removed)}))), lambda i: steps[i]) AS steps
FROM (SELECT *, {_first_sql(triggers)} AS pos FROM {bases}) WHERE pos IS NOT NULL""")
    for rule, moved, target in fab.MOVES:
        variants.append(f"""SELECT key, family, seed, '{rule}' AS rule, list_concat(list_concat(list_concat(steps[1:dst - 1], [steps[src]]),
  steps[dst:src - 1]), steps[src + 1:]) AS steps
FROM (SELECT *, {_first_sql(moved)} AS src, {_first_sql(target)} AS dst FROM {bases}) WHERE src > dst""")
    variants.append(f"""SELECT key, family, seed, 'RULE_LITHO_LEVEL_SKIP' AS rule, list_transform({_POSITIONS}, lambda i:
  CASE WHEN i = pos[1] THEN steps[pos[2]] WHEN i = pos[2] THEN steps[pos[1]] ELSE steps[i] END) AS steps
FROM (SELECT *, list_filter({_POSITIONS}, lambda i: starts_with(steps[i], 'ALIGN MASK LEVEL')) AS pos FROM {bases}) WHERE len(pos) >= 2""")
    variants.append(f"""SELECT key, family, seed, 'RULE_METAL_ETCH_NO_LITHO' AS rule, list_transform(list_filter({_POSITIONS}, lambda i:
  NOT (starts_with(steps[i], 'EXPOSE LITHO LEVEL') AND i < pos AND pos - i <= 15)), lambda i: steps[i]) AS steps
FROM (SELECT *, {_first_sql(fab.METAL_ETCHES)} AS pos FROM (
  SELECT key, family, seed, list_transform(list_filter({_POSITIONS}, lambda i:
    NOT (i >= pos - 15 AND i < pos AND steps[i] IN ({names(fab.DEVELOPS)}))), lambda i: steps[i]) AS steps
  FROM (SELECT *, {_first_sql(fab.METAL_ETCHES)} AS pos FROM {bases}) WHERE pos IS NOT NULL))""")
    fronts = " UNION ALL ".join(f"SELECT '{r.rule}' AS rule, '{fab.EXACT.events[r.trigger][0]}' AS front"
                                for r in fab.EXACT.rules if r.rule != "RULE_LITHO_LEVEL_SKIP")
    return f"""variants AS ({' UNION ALL '.join(variants)}),
numbered AS (SELECT *, row_number() OVER () AS user_id FROM variants),
flat AS (SELECT user_id, family, i AS ts, i AS event_id, i AS step_index, steps[i] AS step
  FROM (SELECT user_id, family, steps, unnest({_POSITIONS}) AS i FROM numbered)),
{exact_violations('flat')},
fired AS (SELECT * FROM numbered n WHERE EXISTS (SELECT 1 FROM v WHERE v.user_id = n.user_id AND v.rule = n.rule)),
changed AS (SELECT key, family, rule, steps FROM fired
  QUALIFY row_number() OVER (PARTITION BY key, family ORDER BY {_digest('rule', 'changed')}) = 1),
made AS (SELECT key, family, rule, list_concat([front], steps) AS steps FROM {bases}, ({fronts})
  WHERE (key, family) NOT IN (SELECT (key, family) FROM changed)
  QUALIFY row_number() OVER (PARTITION BY key, family ORDER BY {_digest('rule', 'made')}) = 1),
injected AS (FROM changed UNION ALL FROM made)"""


@query("injected_sequences", f"""WITH {ROUTES}, {CANONICAL},
bases AS (SELECT concat_ws('|', user_id, 0) AS key, family, steps, '11' AS seed FROM s), {injected_sql('bases')}
SELECT CAST(string_split(key, '|')[1] AS BIGINT) AS user_id, CAST(0 AS BIGINT) AS segment, rule AS injected_rule,
  array_to_string(steps, '|') AS steps FROM injected""")
def injected_sequences(spark, sf):
    rows = inject.inject(classed_segments(spark, sf, fab.EXACT), "steps", ["user_id", "segment"], seed=11)
    return rows.select("user_id", "segment", "injected_rule", step_names("injected_steps").alias("steps"))


@query("anomaly_eval_rows", f"""WITH {ROUTES}, {CANONICAL},
half AS (SELECT greatest(1, count(DISTINCT user_id) // 6) AS half FROM events),
ranked AS (SELECT user_id, family, steps, half, concat_ws('|', user_id, 0) AS key, count(*) OVER (PARTITION BY family) AS n,
  row_number() OVER (PARTITION BY family ORDER BY md5(concat_ws('|', '5', user_id, 0)), user_id) - 1 AS r FROM s, half),
placed AS (SELECT *, CASE WHEN n > half THEN r - half ELSE r END AS p, CASE WHEN n > half THEN n - half ELSE n END AS pool FROM ranked),
bases AS (SELECT concat_ws('|', key, i) AS key, family, steps, '5' AS seed, i
  FROM (SELECT *, unnest(generate_series(p, half - 1, pool)) AS i FROM placed WHERE p >= 0 AND p < half)), {injected_sql('bases')}
SELECT format('{{}}_valid_{{:04d}}', family, r) AS example_id, family, array_to_string(steps, '|') AS steps, 1 AS is_valid, '' AS rule
FROM ranked WHERE r < half
UNION ALL SELECT format('{{}}_inval_{{:04d}}', family, CAST(string_split(key, '|')[3] AS BIGINT)), family, array_to_string(steps, '|'), 0, rule
FROM injected""")
def anomaly_eval_rows(spark, sf):
    """Per family as many valid as injected rows as the table has sequences for."""
    rows = classed_segments(spark, sf, fab.EXACT)
    half = max(1, table(spark, sf, "events").select("user_id").distinct().count() // 6)
    out = inject.anomaly_rows(rows, "family", ["user_id", "segment"], "steps", half, half, seed=5)
    return out.withColumn("steps", step_names("steps"))


@query("training_twins")
def training_twins(spark, sf):
    """Pairs of repaired sequences and their injected copies."""
    rows = repaired(spark, sf).select("user_id", "segment", "family", F.posexplode("steps").alias("pos", "step"))
    masked = by_distinct(rows, "step", lambda names: names.withColumn("mask", fab.EXACT.mask(F.col("step"))))
    arrays = inject.collect_steps(masked, ["user_id", "segment", "family"], fab.EXACT, "mask")
    out = inject.training_twins(arrays, ["user_id", "segment"], "family", "steps", seed=3)
    return out.withColumn("steps", step_names("steps"))


@query("novel_variants")
def novel_variants(spark, sf):
    out = inject.novel_variants(repaired(spark, sf), ["user_id", "segment"], "steps", "SICFET", [0.25, 0.5, 0.75, 1.0])
    return out.withColumn("steps", step_names("steps"))


@query("novelty_curve")
def novelty_curve(spark, sf):
    """Per rename fraction: variants that stay valid, and how many can be broken again by class."""
    variants = inject.novel_variants(repaired(spark, sf), ["user_id", "segment"], "steps", "OOD", [0.0, 0.5, 1.0],
                                     structural=False)
    broken = variants.withColumn("broken", inject.inject_by_class(F.col("steps")))
    return broken.groupBy("rename_fraction").agg(
        F.count(F.lit(1)).alias("n"), F.count("broken").alias("n_invalid_constructible"))


@query("repair_to_valid")
def repair_to_valid(spark, sf):
    out = repair.repair(classed_segments(spark, sf, fab.BY_CLASS), "steps")
    return out.select("user_id", "segment", step_names("repaired").alias("repaired"),
                      F.array_join("fixes", "; ").alias("fixes"), "now_valid",
                      F.array_join("remaining", ",").alias("remaining"))


_SEVERITY = "CASE rule " + " ".join(f"WHEN '{r.rule}' THEN {r.severity}" for r in fab.BY_CLASS.rules) + " END"
_ORDER = "CASE rule " + " ".join(f"WHEN '{r.rule}' THEN {n}" for n, r in enumerate(fab.BY_CLASS.rules, 1)) + " END"


@query("most_severe_violation", f"""WITH {ROUTES}, {CLASS_FLAGS}, {CLASS_VIOLATIONS}
SELECT user_id, rule, CAST({_SEVERITY} AS INT) AS severity, CAST(step_index AS INT) AS pos, step FROM cv
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_SEVERITY} DESC, step_index, {_ORDER}) = 1""")
def most_severe_violation(spark, sf):
    """The violation that a repair takes up first."""
    worst = repair.worst(array_violations(fab.BY_CLASS, F.col("steps")))
    out = classed_segments(spark, sf, fab.BY_CLASS).withColumn("w", A.once(worst)).filter("w IS NOT NULL")
    return out.select("user_id", rule_name(fab.BY_CLASS, F.col("w.rule_no")).alias("rule"), F.col("w.severity").alias("severity"),
                      F.col("w.pos").alias("pos"), F.col("w.step").alias("step"))


@query("certified_sequences", f"""WITH {ROUTES}, {CLASS_FLAGS}, {CLASS_VIOLATIONS},
n AS (SELECT user_id, count(*) AS n FROM cv GROUP BY 1)
SELECT user_id, CAST(0 AS BIGINT) AS segment, n IS NULL AS is_valid, CAST(coalesce(n, 0) AS INT) AS n_violations
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN n USING (user_id)""")
def certified_sequences(spark, sf):
    return repair.certify(classed_segments(spark, sf, fab.BY_CLASS), "steps").select(
        "user_id", "segment", "is_valid", "n_violations")


# -- legality-aware next steps and completions --------------------------------------------------------

def model_and_prefixes(spark, sf, k=None):
    """Candidate lists, step profiles, category pairs and the prefix states at every cut.

    The n-gram table is written once; step profiles and the category grammar are
    read off it, so the routes are scanned for the counts and for the prefixes only.
    """
    rows = routes(spark, sf).withColumn("step", S.canonical(F.col("step")))
    state = with_state(S.with_classes(rows), fab.BY_CLASS, KEYS, ORDER, mask=F.col("class_mask"), total="n",
                       lags={"lag1": (F.col("step"), 1), "lag2": (F.col("step"), 2), "lag3": (F.col("step"), 3),
                             "previous_category": (F.col("category"), 1)},
                       sums={"tests_before": (F.col("step") == decode.LAST_TEST).cast("bigint")})
    lagged = M.with_lags(rows, KEYS, ORDER)
    counts = cut_lineage(M.ngram_counts(lagged, KEYS))

    closing = spark.createDataFrame([(decode.LAST_TEST,), (decode.TERMINAL,)], "step string")
    steps = counts.filter("len = 0").select(F.col("next").alias("step")).unionByName(closing).distinct()
    profile = cut_lineage(S.with_classes(steps).select(
        F.col("step").alias("next"), F.col("class_mask").alias("mask"),
        fab.BY_CLASS.level_of(F.col("step")).alias("level"), "category"))
    kind = profile.select(F.col("next").alias("context"), F.col("category").alias("from_kind"))
    pairs = (counts.filter("len = 1").join(kind, "context").join(profile, "next")
             .select("from_kind", F.col("category").alias("to_kind")).distinct())

    # a prefix is valid if no earlier row of it broke a rule: one more sum over the same sorted rows
    judged = running_state(state.withColumn("broken", any_broken(fab.BY_CLASS).cast("bigint")), KEYS, ORDER,
                           index="i", sums={"broken_before": F.col("broken")})
    fractions = F.explode(F.array(*[F.lit(f) for f in FRACTIONS])).alias("fraction")
    cuts = judged.select("*", fractions).filter(
        F.col("step_index") == F.greatest(F.lit(1), F.floor(F.col("n") * F.col("fraction"))))
    prefixes = cuts.withColumns({"prefix_valid": F.col("broken_before") == 0, "has_test": F.col("tests_before") > 0,
                                 "cut": F.col("step_index")})
    keep = [*KEYS, "fraction", "cut", "lag1", "lag2", "lag3", "previous_category", "prefix_valid", "has_test",
            *decode.state_columns(fab.BY_CLASS), F.col("step").alias("gold")]
    return decode.candidates(counts, profile, k), profile, pairs, prefixes.select(*keep)


_STATE = ["clean12", "expose15", "develop15", "develop12", "opener15", "fill6", "deposited", "cured", "sorted", "prior"]
_CANDIDATE = [f"is_{e.lower()}" for e in fab.BY_CLASS.events]
# the windows of the row after the cut are the state a candidate meets
RERANK = f"""{ROUTES}, {CLASS_FLAGS}, {CLASS_VIOLATIONS},
{NGRAMS.replace('FROM j', 'FROM c')},
n AS (SELECT user_id, count(*) AS n FROM j GROUP BY 1),
d AS (SELECT DISTINCT step AS next, category AS kind, level AS c_level, {', '.join(f'{f} AS c_{f}' for f in _CANDIDATE)} FROM cx),
e AS (SELECT l.user_id, l.step AS gold, l.lag1, l.lag2, lc.step AS lag3, fr AS fraction, {', '.join('cx.' + s for s in _STATE)}, pc.category AS kind0
  FROM l JOIN n USING (user_id) JOIN cx ON cx.user_id = l.user_id AND cx.step_index = l.step_index
  LEFT JOIN c pc ON pc.user_id = l.user_id AND pc.step_index = l.step_index - 1
  LEFT JOIN c lc ON lc.user_id = l.user_id AND lc.step_index = l.step_index - 3,
  (SELECT unnest([0.6::DOUBLE, 0.8::DOUBLE]) AS fr) WHERE l.step_index = greatest(1, floor(n * fr))),
gr AS (SELECT DISTINCT a.category AS k0, b.category AS k1 FROM c a JOIN c b ON b.user_id = a.user_id
  AND b.step_index = a.step_index + 1),
b AS (SELECT e.*, CASE WHEN lag2 IS NOT NULL THEN 2 ELSE 1 END AS want FROM e),
k AS (SELECT b.*, r.rank, r.next, d.* EXCLUDE (next) FROM b JOIN r ON r.len = want
  AND r.context = CASE want WHEN 2 THEN lag2 || '|' || lag1 ELSE lag1 END JOIN d ON d.next = r.next),
g2 AS (SELECT *, CASE WHEN (c_is_deposition = 1 AND clean12 = 0) OR (c_is_metal_etch = 1 AND (expose15 = 0 OR develop15 = 0))
    OR (c_is_patterned_etch = 1 AND develop12 = 0) OR (c_is_implant = 1 AND opener15 = 0) OR (c_is_cmp = 1 AND fill6 = 0)
    OR coalesce(prior > 0 AND (c_level > prior + 1 OR c_level < prior), FALSE)
    OR (c_is_pad_window_open = 1 AND (deposited = 0 OR cured = 0)) OR (c_is_electrical_test = 1 AND cured = 0)
    OR (c_is_ship = 1 AND sorted = 0) OR (c_is_backside_metal = 1 AND cured = 0) THEN 2
  WHEN EXISTS (SELECT 1 FROM gr WHERE k0 = kind0 AND k1 = kind) THEN 0 ELSE 1 END AS grp FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, fraction ORDER BY grp, rank) AS place FROM g2),
rr AS (SELECT user_id, fraction, any_value(gold) AS gold,
  string_agg(next, '|' ORDER BY rank) FILTER (rank <= 5) AS model_next,
  string_agg(next, '|' ORDER BY place) FILTER (place <= 5) AS reranked,
  string_agg(next, '|' ORDER BY rank) FILTER (rank <= 3) AS baseline3,
  string_agg(next, '|' ORDER BY place) FILTER (place <= 3) AS model3,
  any_value(CASE WHEN lag2 IS NULL THEN lag1 ELSE coalesce(lag3 || ' -> ', '') || lag2 || ' -> ' || lag1 END) AS tail FROM o GROUP BY 1, 2)"""


def reranked(spark, sf, mode="soft"):
    lists, _, pairs, prefixes = model_and_prefixes(spark, sf)
    with_candidates = M.back_off(prefixes, small(lists), ["lag1", "lag2"])
    out = decode.rerank(with_candidates, fab.BY_CLASS, 5, mode, pairs)
    model = F.transform("candidates", lambda c: c["next"])
    return out.select("user_id", "fraction", "gold", F.array_join(F.slice(model, 1, 5), "|").alias("model_next"),
                      F.array_join("reranked", "|").alias("reranked"),
                      F.concat_ws(" -> ", "lag3", "lag2", "lag1").alias("prefix_tail"))


@query("legality_rerank", f"WITH {RERANK} SELECT user_id, fraction, gold, model_next, reranked FROM rr")
def legality_rerank(spark, sf):
    return reranked(spark, sf).drop("prefix_tail")


_SEEN_PAIR = "WHEN EXISTS (SELECT 1 FROM gr WHERE k0 = kind0 AND k1 = kind) THEN 0 ELSE 1 END"


@query("constrained_next_step", f"""WITH {RERANK.replace(_SEEN_PAIR, 'ELSE 0 END')}
SELECT user_id, fraction, gold, model_next, reranked FROM rr""")
def constrained_next_step(spark, sf):
    """Legal candidates first, whatever their category."""
    return reranked(spark, sf, "off").drop("prefix_tail")


@query("strict_next_step", f"""WITH {RERANK.replace(_SEEN_PAIR, _SEEN_PAIR.replace('ELSE 1', 'ELSE 2'))}
SELECT user_id, fraction, gold, model_next, reranked FROM rr""")
def strict_next_step(spark, sf):
    """A candidate in a category never seen after the previous one counts as illegal."""
    return reranked(spark, sf, "hard").drop("prefix_tail")


@query("baseline_next_to_model", f"""WITH {RERANK}
SELECT user_id, fraction, tail AS prefix_tail, baseline3 AS baseline_next, model3 AS model_next FROM rr""")
def baseline_next_to_model(spark, sf):
    """The plain and the legality-aware three next steps side by side, with the tail of the prefix."""
    out = reranked(spark, sf)
    first = lambda c: F.array_join(F.slice(F.split(c, r"\|"), 1, 3), "|")
    return out.select("user_id", "fraction", "prefix_tail", first("model_next").alias("baseline_next"),
                      first("reranked").alias("model_next"))


def _illegal(c: str, get: str = "") -> str:
    """Whether candidate c breaks a rule in the state of the row, whose columns start with get."""
    tests = []
    for rule in fab.BY_CLASS.rules:
        if isinstance(rule, Windowed):
            tests += [f"({c}.is_{rule.trigger.lower()} = 1 AND NOT coalesce({get}pos - {get}l_{e.lower()} <= {n}, FALSE))" for e, n in rule.needs]
        elif isinstance(rule, Milestone):
            tests += [f"({c}.is_{rule.trigger.lower()} = 1 AND {get}l_{e.lower()} IS NULL)" for e in rule.needs]
        else:
            tests.append(f"coalesce({get}prior > 0 AND ({c}.level > {get}prior + 1 OR {c}.level < {get}prior), FALSE)")
    return " OR ".join(tests)


def _cycling(steps: str) -> str:
    """Whether the last eight steps repeat with period 1 to 4."""
    last = lambda i: f"{steps}[len({steps}) - {7 - i}]"
    periods = [" AND ".join(f"{last(i)} = {last(i % p)}" for i in range(p, 8)) for p in (1, 2, 3, 4)]
    return f"(len({steps}) >= 8 AND ({' OR '.join(f'({p})' for p in periods)}))"


_ENABLERS = [e.lower() for e in fab.BY_CLASS.enablers]
_FIELDS = ", ".join(f"'is_{e.lower()}': d.is_{e.lower()}" for e in fab.BY_CLASS.events)
_BEFORE = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
# every prefix at its cut with its state, and the candidate lists
PREFIXES_AND_LISTS = f"""{ROUTES}, {CLASS_FLAGS}, {CLASS_VIOLATIONS},
{NGRAMS.replace('FROM j', 'FROM c')},
d AS (SELECT DISTINCT step AS next, level, {', '.join(f'is_{e.lower()}' for e in fab.BY_CLASS.events)} FROM cx),
m AS (SELECT len, context, list({{'next': r.next, 'p': r.cnt / t.total, 'level': d.level, {_FIELDS}}} ORDER BY rank) AS cands
  FROM r JOIN d USING (next) JOIN (SELECT len, context, sum(cnt) AS total FROM g GROUP BY 1, 2) t USING (len, context) WHERE rank <= {{k}} GROUP BY 1, 2),
anyc AS (SELECT cands AS all_cands FROM m WHERE len = 0),
st AS (SELECT cx.user_id, cx.step_index AS pos, l.lag1, l.lag2, prior, count(*) OVER (PARTITION BY cx.user_id) AS n,
  coalesce(max(CASE WHEN cx.step = '{decode.LAST_TEST}' THEN 1 END) {_BEFORE.replace('user_id', 'cx.user_id').replace('ts,', 'cx.ts,').replace(' event_id', ' cx.event_id')}, 0) = 1 AS has_test,
  {', '.join(f"max(CASE WHEN cx.is_{e} = 1 THEN cx.step_index END) {_BEFORE.replace('user_id', 'cx.user_id').replace('ts,', 'cx.ts,').replace(' event_id', ' cx.event_id')} AS l_{e}" for e in _ENABLERS)}
  FROM cx JOIN l ON l.user_id = cx.user_id AND l.step_index = cx.step_index),
start AS (SELECT st.*, fr AS fraction, NOT EXISTS (SELECT 1 FROM cv WHERE cv.user_id = st.user_id AND cv.step_index < st.pos) AS prefix_valid
  FROM st, (SELECT unnest([0.6::DOUBLE, 0.8::DOUBLE]) AS fr) WHERE pos = greatest(1, floor(n * fr)))"""


def _completion_sql(k: int, fallback: bool, finish: bool) -> str:
    opened = "coalesce(lag1 <> 'SHIP LOT', TRUE)" + " AND prefix_valid" * finish
    states = ", ".join(f"CASE WHEN pick IS NOT NULL AND pick.is_{e} = 1 THEN pos ELSE l_{e} END AS l_{e}" for e in _ENABLERS)
    end = ""
    if finish:
        end = """fin AS (SELECT user_id, fraction, prefix_valid,
  CASE WHEN coalesce(lag1 <> 'SHIP LOT', TRUE) AND NOT has_test THEN list_append(comp, 'WAFER SORT TEST') ELSE comp END AS comp,
  coalesce(lag1 <> 'SHIP LOT', TRUE) AND (NOT has_test OR l_sort_test IS NOT NULL) AS ships FROM ended)
SELECT user_id, fraction, CASE WHEN NOT prefix_valid THEN '' WHEN ships THEN array_to_string(list_append(comp, 'SHIP LOT'), '|')
  ELSE array_to_string(comp, '|') END AS completion FROM fin"""
    else:
        end = "last AS (FROM ended) SELECT user_id, fraction, array_to_string(comp, '|') AS completion FROM last"
    pick = "coalesce(legal[1], cands[1])" if fallback else "legal[1]"
    return f"""WITH RECURSIVE {PREFIXES_AND_LISTS.replace("{k}", str(k))},
go AS (
  SELECT user_id, fraction, 0 AS i, pos, lag1, lag2, prior, has_test, prefix_valid, {', '.join(f'l_{e}' for e in _ENABLERS)},
    CAST([] AS VARCHAR[]) AS comp, {opened} AS open FROM start
  UNION ALL
  SELECT user_id, fraction, i + 1, CASE WHEN pick IS NULL THEN pos ELSE pos + 1 END, coalesce(pick.next, lag1),
    CASE WHEN pick IS NULL THEN lag2 ELSE lag1 END, coalesce(pick.level, prior), has_test OR coalesce(pick.next = '{decode.LAST_TEST}', FALSE),
    prefix_valid, {states}, grown, pick IS NOT NULL AND pick.next <> '{decode.TERMINAL}' AND NOT {_cycling('grown')}
  FROM (SELECT *, CASE WHEN pick IS NULL THEN comp ELSE list_append(comp, pick.next) END AS grown
    FROM (SELECT *, {pick} AS pick FROM (SELECT *, list_filter(cands, lambda c: NOT ({_illegal('c')})) AS legal
      FROM (SELECT go.*, coalesce(m2.cands, m1.cands, all_cands) AS cands FROM go CROSS JOIN anyc
        LEFT JOIN m m2 ON m2.len = 2 AND m2.context = lag2 || '|' || lag1 LEFT JOIN m m1 ON m1.len = 1 AND m1.context = lag1
        WHERE open AND i < 160))))),
ended AS (SELECT * FROM go QUALIFY row_number() OVER (PARTITION BY user_id, fraction ORDER BY i DESC) = 1),
{end}"""


@query("greedy_completion", _completion_sql(1 << 30, False, True))
def greedy_completion(spark, sf):
    lists, profile, _, prefixes = model_and_prefixes(spark, sf)
    out = decode.complete(prefixes, lists, fab.BY_CLASS, profile)
    return out.select("user_id", "fraction", F.array_join("completion", "|").alias("completion"))


@query("top_ten_completion", _completion_sql(10, True, False))
def top_ten_completion(spark, sf):
    lists, profile, _, prefixes = model_and_prefixes(spark, sf, k=10)
    out = decode.complete(prefixes, lists, fab.BY_CLASS, profile, top=10,
                          fallback=True, finish=False)
    return out.select("user_id", "fraction", F.array_join("completion", "|").alias("completion"))


@query("beam_completion")
def beam_completion(spark, sf):
    lists, profile, _, prefixes = model_and_prefixes(spark, sf)
    out = decode.beam_complete(prefixes, [*KEYS, "fraction"], lists, fab.BY_CLASS, profile)
    return out.select("user_id", "fraction", F.array_join("completion", "|").alias("completion"),
                      F.round("logp", 6).alias("logp"))


# -- merged groups: orders of one customer that share a month or a priority ---------------------------

@query("synonym_components", """WITH RECURSIVE g AS (
  SELECT o_custkey || 'm' || strftime(o_orderdate, '%Y-%m') AS gid, o_orderkey AS m FROM orders
  UNION SELECT o_custkey || 'p' || o_orderpriority || year(o_orderdate), o_orderkey FROM orders),
e AS (SELECT DISTINCT a.m AS x, b.m AS y FROM g a JOIN g b USING (gid)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS member, min(y) AS component FROM r GROUP BY x""")
def synonym_components(spark, sf):
    merged = components.merge_groups(order_groups(spark, sf))
    return components.component_of(table(spark, sf, "orders").select(F.col("o_orderkey").alias("member")), merged)


def order_groups(spark, sf):
    orders = table(spark, sf, "orders")
    month = orders.select(F.concat(F.col("o_custkey"), F.lit("m"), F.date_format("o_orderdate", "yyyy-MM")).alias("group_id"),
                          F.col("o_orderkey").alias("member"))
    priority = orders.select(F.concat(F.col("o_custkey"), F.lit("p"), "o_orderpriority", F.year("o_orderdate")).alias("group_id"),
                             F.col("o_orderkey").alias("member"))
    return month.unionByName(priority)


@query("stop_set_components", """WITH RECURSIVE g0 AS (
  SELECT o_custkey || 'm' || strftime(o_orderdate, '%Y-%m') AS gid, o_orderkey AS m FROM orders
  UNION SELECT o_custkey || 'p' || o_orderpriority || year(o_orderdate), o_orderkey FROM orders),
g1 AS (SELECT * FROM g0 WHERE m % 5 <> 0),
g AS (SELECT * FROM g1 WHERE gid IN (SELECT gid FROM g1 GROUP BY 1 HAVING count(*) > 1)),
e AS (SELECT DISTINCT a.m AS x, b.m AS y FROM g a JOIN g b USING (gid)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS member, min(y) AS component FROM r GROUP BY x""")
def stop_set_components(spark, sf):
    """Merged groups without the members that connect too much; groups left with one member connect nothing."""
    stop = table(spark, sf, "orders").select(F.col("o_orderkey").alias("member")).filter("member % 5 = 0")
    return components.merge_groups(order_groups(spark, sf), stop=stop)
