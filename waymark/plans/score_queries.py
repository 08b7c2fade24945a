"""Evaluation rows, predictions and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import arrays as A
from waymark.operators import evaluate as E
from waymark.operators import mining as M
from waymark.operators.ordered import running_state
from waymark.operators.rules import RuleBook, Windowed, check, oracle
from waymark.plans.inputs import (FAMILIES, GRADED, JOURNEY_BOOK, JOURNEYS, ORDER, ROUTES, ROUTE_SEGMENTS, SEGMENTS, journey_segments,
                                  journeys, names, route_segments, routes)
from waymark.plans.registry import query
from waymark.plans.rule_queries import JOURNEY_RULES, journey_violations
from waymark.plans.sql_text import block_case, category_case
from waymark.session import cut_lineage, small

FRACTIONS = [0.6, 0.8]
FAMILY_SQL = f"[{names(FAMILIES)}][CAST(user_id % 3 AS INT) + 1]"


def family_column():
    return F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("user_id") % 3 + 1).cast("int"))


# -- cutting sequences ------------------------------------------------------------------

def examples(segments, family=None):
    """Each segment cut at every fraction: prefix, next step and suffix as columns."""
    family = family_column() if family is None else family
    fractions = F.explode(F.array(*[F.lit(f) for f in FRACTIONS])).alias("fraction")
    rows = segments.select("*", fractions).withColumn("cut", A.cut_point(F.size("steps"), F.col("fraction")))
    sid = F.format_string("seq_%d_%d", "user_id", "segment")
    return rows.select(
        "user_id", "segment", family.alias("family"), "fraction", "cut", "steps",
        F.concat_ws("_", family, sid, F.floor(F.col("fraction") * 100).cast("string")).alias("example_id"),
        A.head(F.col("steps"), F.col("cut")).alias("partial"), A.rest(F.col("steps"), F.col("cut")).alias("suffix"))


EXAMPLES = f"""x0 AS (SELECT *, len(steps) AS n, fr AS fraction,
  CAST(greatest(1, floor(len(steps) * fr)) AS INT) AS cut FROM s, (SELECT unnest([0.6::DOUBLE, 0.8::DOUBLE]) AS fr)),
x AS (SELECT *, {FAMILY_SQL} AS fam, {FAMILY_SQL} || '_seq_' || user_id || '_' || segment || '_' ||
  CAST(floor(fr * 100) AS INT) AS example_id, steps[1:cut] AS part, steps[cut + 1:] AS suffix FROM x0)"""


@query("cut_points", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT example_id, user_id, segment, fraction, CAST(n AS INT) AS n, cut FROM x""")
def cut_points(spark, sf):
    return examples(journey_segments(spark, sf)).select("example_id", "user_id", "segment", "fraction",
                                                        F.size("steps").alias("n"), "cut")


@query("eval_rows", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT example_id, fam AS family, fraction, array_to_string(part, '|') AS partial_sequence,
  array_to_string(steps, '|') AS full_sequence FROM x""")
def eval_rows(spark, sf):
    return examples(journey_segments(spark, sf)).select(
        "example_id", "family", "fraction", A.encode_pipe(F.col("partial")).alias("partial_sequence"),
        A.encode_pipe(F.col("steps")).alias("full_sequence"))


@query("next_step_gold", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT example_id, coalesce(steps[cut + 1], '') AS next_step FROM x""")
def next_step_gold(spark, sf):
    """The element of the full sequence after the partial one, which the same row holds."""
    partial, full = (A.decode_pipe(F.col(c), False) for c in ("partial_sequence", "full_sequence"))
    step = F.try_element_at(full, F.size(partial) + 1)
    return eval_rows(spark, sf).select("example_id", F.coalesce(step, F.lit("")).alias("next_step"))


@query("holdout_examples", f"""WITH {ROUTES}, {ROUTE_SEGMENTS}, c AS (SELECT *, CAST(greatest(1, floor(len(steps) * 0.8::DOUBLE))
  AS INT) AS cut FROM s WHERE family <> 'IGBT')
SELECT user_id, segment, family, cut, steps[cut + 1] AS next_step FROM c WHERE cut < len(steps)""")
def holdout_examples(spark, sf):
    """One example per sequence of the families that are not held out, where something follows the cut."""
    return M.holdout_examples(route_segments(spark, sf), "IGBT", 0.8).select(
        "user_id", "segment", "family", "cut", F.get("steps", F.col("cut")).alias("next_step"))


@query("suffix_gold", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT example_id, array_to_string(suffix, '|') AS suffix, CAST(len(suffix) AS INT) AS n FROM x""")
def suffix_gold(spark, sf):
    return examples(journey_segments(spark, sf)).select("example_id", A.encode_pipe(F.col("suffix")).alias("suffix"),
                                                        F.size("suffix").alias("n"))


# -- n-grams and next-step predictions -------------------------------------------------------

LAGGED = """l AS (SELECT *, lag(step, 1) OVER w AS lag1, lag(step, 2) OVER w AS lag2 FROM j
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
NGRAMS = f"""{LAGGED}, ctx AS (
  SELECT 0 AS len, '' AS context, step AS next, user_id, step_index FROM l
  UNION ALL SELECT 1, lag1, step, user_id, step_index FROM l WHERE lag1 IS NOT NULL
  UNION ALL SELECT 2, lag2 || '|' || lag1, step, user_id, step_index FROM l WHERE lag2 IS NOT NULL),
g AS (SELECT len, context, next, count(*) AS cnt, min(user_id * 1000000 + step_index) AS seen FROM ctx GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY len, context ORDER BY cnt DESC, seen) AS rank FROM g)"""


def lagged_journeys(spark, sf):
    return M.with_lags(journeys(spark, sf), ["user_id"], ORDER)


def journey_ngrams(spark, sf):
    """The n-gram table, written once for its several readers."""
    return cut_lineage(M.ngram_counts(lagged_journeys(spark, sf), ["user_id"]))


@query("ngram_counts", f"WITH {JOURNEYS}, {NGRAMS} SELECT len, context, next, CAST(cnt AS BIGINT) AS cnt FROM g")
def ngram_counts(spark, sf):
    return M.ngram_counts(lagged_journeys(spark, sf), ["user_id"]).drop("first_seen")


@query("ngram_topk", f"""WITH {JOURNEYS}, {NGRAMS} SELECT len, context, next, CAST(cnt AS BIGINT) AS cnt,
  CAST(rank AS INT) AS rank FROM r WHERE rank <= 3""")
def ngram_topk(spark, sf):
    return M.ranked_next(M.ngram_counts(lagged_journeys(spark, sf), ["user_id"]), 3).drop("first_seen")


@query("unigram_topk", f"""WITH {JOURNEYS}, {NGRAMS} SELECT next AS step, CAST(cnt AS BIGINT) AS cnt FROM r
WHERE len = 0 AND rank <= 5""")
def unigram_topk(spark, sf):
    seen = F.min(F.struct("user_id", "step_index"))
    rows = running_state(journeys(spark, sf), ["user_id"], ORDER)
    return (rows.groupBy("step").agg(F.count(F.lit(1)).alias("cnt"), seen.alias("seen"))
            .orderBy(F.col("cnt").desc(), "seen").limit(5).select("step", "cnt"))


def prefix_rows(lagged, n="n"):
    """Rows that follow the cut of their sequence: the next step and the last steps of the prefix."""
    fractions = F.explode(F.array(*[F.lit(f) for f in FRACTIONS])).alias("fraction")
    rows = lagged.select("*", fractions)
    return rows.filter(F.col("step_index") == F.greatest(F.lit(1), F.floor(F.col(n) * F.col("fraction"))))


def predicted(df, keys):
    """Top five next steps by back-off for every cut of every sequence."""
    lagged = running_state(df, keys, ORDER, total="n",
                           lags={"lag1": (F.col("step"), 1), "lag2": (F.col("step"), 2)})
    lists = small(M.candidate_lists(cut_lineage(M.ngram_counts(lagged, keys)), 5))
    out = M.back_off(prefix_rows(lagged), lists, ["lag1", "lag2"])
    return out.withColumn("ranks", F.transform("candidates", lambda c: c["next"]))


CUTS = """n AS (SELECT user_id, count(*) AS n FROM j GROUP BY 1),
e AS (SELECT l.*, fr AS fraction FROM l JOIN n USING (user_id), (SELECT unnest([0.6::DOUBLE, 0.8::DOUBLE]) AS fr)
  WHERE step_index = greatest(1, floor(n * fr))),
t AS (SELECT len, context, list(next ORDER BY rank) AS ranks FROM r WHERE rank <= 5 GROUP BY 1, 2),
p AS (SELECT e.*, coalesce(a.ranks, b.ranks, z.ranks) AS ranks FROM e
  LEFT JOIN t a ON a.len = 2 AND a.context = lag2 || '|' || lag1
  LEFT JOIN t b ON b.len = 1 AND b.context = lag1 LEFT JOIN t z ON z.len = 0)"""


@query("next_step_predictions", f"""WITH {JOURNEYS}, {NGRAMS}, {CUTS}
SELECT user_id, fraction, step AS gold, array_to_string(ranks, '|') AS ranks FROM p""")
def next_step_predictions(spark, sf):
    return predicted(journeys(spark, sf), ["user_id"]).select("user_id", "fraction", F.col("step").alias("gold"),
                                                              F.array_join("ranks", "|").alias("ranks"))


def rounded(df, columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_RANK = "list_position(ranks, step)"
_GROUPS = """SELECT 'ALL' AS family, 'ALL' AS fraction, * EXCLUDE (f, c) FROM q
UNION ALL SELECT f, 'ALL', * EXCLUDE (f, c) FROM q UNION ALL SELECT 'ALL', c, * EXCLUDE (f, c) FROM q"""


@query("nextstep_metrics_grouping_sets", f"""WITH {JOURNEYS}, {NGRAMS}, {CUTS},
q AS (SELECT {FAMILY_SQL} AS f, CAST(fraction AS VARCHAR) AS c, coalesce({_RANK}, 0) AS k FROM p), a AS ({_GROUPS})
SELECT family, fraction, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(k = 1 AS INT)), 6) AS top1,
  round(avg(CAST(k BETWEEN 1 AND 3 AS INT)), 6) AS top3, round(avg(CAST(k >= 1 AS INT)), 6) AS top5,
  round(avg(CASE WHEN k > 0 THEN 1.0::DOUBLE / k ELSE 0 END), 6) AS mrr FROM a GROUP BY 1, 2""")
def nextstep_metrics_grouping_sets(spark, sf):
    rows = predicted(journeys(spark, sf), ["user_id"]).withColumn("family", family_column())
    scores = E.next_step_scores(F.col("ranks"), F.col("step"))
    return rounded(E.by_grouping(rows, scores), scores)


@query("nextstep_category_metrics", f"""WITH {ROUTES}, {NGRAMS}, {CUTS},
q AS (SELECT family, coalesce({_RANK}, 0) AS k,
  coalesce(list_position(list_transform(ranks, lambda x: {category_case('x')}), {category_case('step')}), 0) AS kc FROM p)
SELECT family, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(k = 1 AS INT)), 6) AS top1,
  round(avg(CAST(k BETWEEN 1 AND 5 AS INT)), 6) AS top5,
  round(avg(CASE WHEN k > 0 THEN 1.0::DOUBLE / k ELSE 0 END), 6) AS mrr,
  round(avg(CAST(kc = 1 AS INT)), 6) AS top1_category,
  round(avg(CASE WHEN kc > 0 THEN 1.0::DOUBLE / kc ELSE 0 END), 6) AS mrr_category FROM q GROUP BY 1""")
def nextstep_category_metrics(spark, sf):
    rows = predicted(routes(spark, sf), ["user_id", "family"])
    scores = E.next_step_scores(F.col("ranks"), F.col("step"), internal=True)
    keep = ["top1", "top5", "mrr", "top1_category", "mrr_category"]
    means = rows.withColumns({k: scores[k] for k in keep}).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(k) for k in keep])
    return rounded(means, keep)


@query("ood_delta", f"""WITH {ROUTES}, {NGRAMS}, {CUTS},
q AS (SELECT family, avg(CAST(coalesce({_RANK}, 0) = 1 AS INT)) AS top1,
  avg(CAST(coalesce(list_position(list_transform(ranks, lambda x: {category_case('x')}), {category_case('step')}), 0) = 1
  AS INT)) AS top1_category FROM p GROUP BY 1),
h AS (SELECT unnest([{names(FAMILIES)}]) AS holdout),
d AS (SELECT holdout, avg(top1) FILTER (family <> holdout) AS a, avg(top1) FILTER (family = holdout) AS b,
  avg(top1_category) FILTER (family <> holdout) AS c, avg(top1_category) FILTER (family = holdout) AS e
  FROM q, h GROUP BY 1)
SELECT holdout, round(a, 6) AS id_top1, round(b, 6) AS ood_top1, round(a - b, 6) AS delta_top1,
  round(c, 6) AS id_top1_category, round(e, 6) AS ood_top1_category, round(c - e, 6) AS delta_top1_category FROM d""")
def ood_delta(spark, sf):
    rows = predicted(routes(spark, sf), ["user_id", "family"])
    scores = E.next_step_scores(F.col("ranks"), F.col("step"), internal=True)
    keep = ["top1", "top1_category"]
    per_family = rows.withColumns({k: scores[k] for k in keep}).groupBy("family").agg(
        *[F.avg(k).alias(k) for k in keep])
    out = None
    for holdout in FAMILIES:
        one = E.transfer_drop(per_family, holdout, keep)
        out = one if out is None else out.unionByName(one)
    return rounded(out, [c for c in out.columns if c != "holdout"])


# -- completions: the suffix of the next user stands for a prediction -------------------------

def with_predictions(rows, keys=("segment", "fraction")):
    other = rows.select((F.col("user_id") - 1).alias("user_id"), *keys, F.col("suffix").alias("predicted"))
    return rows.join(other, ["user_id", *keys])


PREDICTED = """y AS (SELECT x.*, o.suffix AS predicted FROM x JOIN x o ON o.user_id = x.user_id + 1
  AND o.segment = x.segment AND o.fraction = x.fraction)"""
_CODE = "array_to_string(list_transform({}, lambda s: s[1]), '')"


def equal(a: str, b: str) -> str:
    """Positions with equal elements, in SQL."""
    return (f"coalesce(list_sum(list_transform(range(1, CAST(least(len({a}), len({b})) AS BIGINT) + 1), "
            f"lambda i: CAST({a}[i] = {b}[i] AS INT))), 0)")


def collapsed(a: str) -> str:
    return (f"list_transform(list_filter(range(1, CAST(len({a}) AS BIGINT) + 1), "
            f"lambda i: i = 1 OR {a}[i] <> {a}[i - 1]), lambda i: {a}[i])")


def _rate(count: str, size: str) -> str:
    return f"CASE WHEN {size} = 0 THEN 0 ELSE CAST({count} AS DOUBLE) / {size} END"


@query("completion_official", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}, {PREDICTED},
z AS (SELECT *, list_transform(predicted, lambda s: {block_case('s')}) AS pb0,
  list_transform(suffix, lambda s: {block_case('s')}) AS gb0 FROM y),
zz AS (SELECT *, {collapsed('pb0')} AS pb, {collapsed('gb0')} AS gb FROM z),
q AS (SELECT fam AS f, CAST(fraction AS VARCHAR) AS c,
  CAST(levenshtein({_CODE.format('predicted')}, {_CODE.format('suffix')}) AS DOUBLE) /
    greatest(len(predicted), len(suffix)) AS ned, CAST(predicted = suffix AS INT) AS exact,
  {_rate(equal('predicted', 'suffix'), 'least(len(predicted), len(suffix))')} AS tok,
  {_rate(equal('pb', 'gb'), 'least(len(pb), len(gb))')} AS blk FROM zz), a AS ({_GROUPS})
SELECT family, fraction, CAST(count(*) AS BIGINT) AS n, round(avg(ned), 6) AS ned, round(avg(exact), 6) AS exact,
  round(avg(tok), 6) AS token_accuracy, round(avg(blk), 6) AS block_accuracy FROM a GROUP BY 1, 2""")
def completion_official(spark, sf):
    rows = with_predictions(examples(journey_segments(spark, sf)))
    scores = E.completion_scores(F.col("predicted"), F.col("suffix"))
    return rounded(E.by_grouping(rows, scores), scores)


_WORD = "split_part(trim(s), ' ', 1)"
_LETTERS = ("array_to_string(list_transform({0}, lambda w: chr(CAST(33 + list_position(sym, w) AS INT))), '')")


@query("completion_internal", f"""WITH {ROUTES}, {ROUTE_SEGMENTS}, {EXAMPLES},
y AS (SELECT x.*, o.suffix AS predicted FROM x JOIN x o ON o.user_id = x.user_id + 1 AND o.segment = x.segment
  AND o.fraction = x.fraction),
z AS (SELECT *, list_transform(predicted, lambda s: {_WORD}) AS pw0, list_transform(suffix, lambda s: {_WORD}) AS gw0,
  list_transform(predicted, lambda s: {category_case('s')}) AS pc,
  list_transform(suffix, lambda s: {category_case('s')}) AS gc FROM y),
zz AS (SELECT *, {collapsed('pw0')} AS pw, {collapsed('gw0')} AS gw FROM z),
zs AS (SELECT *, list_distinct(list_concat(pw, gw)) AS sym, list_distinct(list_concat(predicted, suffix)) AS sym2 FROM zz),
q AS (SELECT fam, CAST(predicted = suffix AS INT) AS exact, 1 - CAST(levenshtein(
  {_LETTERS.format('predicted').replace('sym', 'sym2')}, {_LETTERS.format('suffix').replace('sym', 'sym2')}) AS DOUBLE) /
    greatest(len(predicted), len(suffix)) AS ned,
  CAST({equal('predicted', 'suffix')} AS DOUBLE) / greatest(1, len(suffix)) AS tok,
  CAST({equal('pc', 'gc')} AS DOUBLE) / greatest(1, len(suffix)) AS cat,
  1 - CAST(levenshtein({_LETTERS.format('pw')}, {_LETTERS.format('gw')}) AS DOUBLE) / greatest(len(pw), len(gw)) AS blk
  FROM zs)
SELECT fam AS family, CAST(count(*) AS BIGINT) AS n, round(avg(exact), 6) AS exact, round(avg(ned), 6) AS ned_similarity,
  round(avg(tok), 6) AS token_accuracy, round(avg(cat), 6) AS category_token_accuracy,
  round(avg(blk), 6) AS block_similarity FROM q GROUP BY 1""")
def completion_internal(spark, sf):
    rows = with_predictions(examples(route_segments(spark, sf), F.col("family")))
    scores = E.completion_scores(F.col("predicted"), F.col("suffix"), internal=True)
    means = rows.withColumns(scores).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(s) for s in scores])
    return rounded(means, scores)


@query("logic_validity", f"""WITH {JOURNEY_RULES}, u AS (SELECT DISTINCT user_id FROM events),
b AS (SELECT DISTINCT user_id FROM v WHERE rule IN ('PURCHASE_BEFORE_SIGNUP', 'FIRST_CLICK_BEFORE_VIEW'))
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(b.user_id IS NULL AS INT)), 6) AS validity
FROM u LEFT JOIN b USING (user_id)""")
def logic_validity(spark, sf):
    found = journey_violations(spark, sf).filter(F.col("rule").isin("PURCHASE_BEFORE_SIGNUP", "FIRST_CLICK_BEFORE_VIEW"))
    return rounded(E.logic_validity(found, journeys(spark, sf), ["user_id"]), ["validity"])


# the rules of the journeys over prefixes with a predicted step behind them, as sequences of their own
_COMPLETED_RULES = JOURNEY_RULES[len(GRADED) + 2:].replace("FROM j)", "FROM j2)")
COMPLETED = f"""{GRADED}, {NGRAMS}, {CUTS},
w AS (SELECT p.user_id * 10 + CASE WHEN p.fraction < 0.7 THEN 6 ELSE 8 END AS user_id, j.step_index, j.step
  FROM p JOIN j ON j.user_id = p.user_id AND j.step_index < p.step_index
  UNION ALL SELECT user_id * 10 + CASE WHEN fraction < 0.7 THEN 6 ELSE 8 END, step_index, ranks[1] FROM p),
j2 AS (SELECT user_id, step_index AS ts, 0 AS event_id, step_index, step, split_part(step, ' ', 1) AS kind,
  CAST(split_part(step, ' ', 2) AS BIGINT) AS grade FROM w),
{_COMPLETED_RULES}"""
COMPLETED_BOOK = RuleBook(events=JOURNEY_BOOK.events, rules=[r for r in JOURNEY_BOOK.rules if not isinstance(r, Windowed)])


def completed(spark, sf):
    """(user_id, fraction, step_index, step) of every prefix with its first predicted step behind it."""
    rows = predicted(journeys(spark, sf, graded=True), ["user_id"])
    guess = rows.select("user_id", "fraction", F.slice("ranks", 1, 1).alias("prediction"))
    prefixes = examples(journey_segments(spark, sf, graded=True)).select("user_id", "fraction", F.col("partial").alias("prefix"))
    return E.reconstructed(prefixes.join(guess, ["user_id", "fraction"]), ["user_id", "fraction"])


@query("completed_verdicts", f"""WITH {COMPLETED}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rule_ord, step_index) AS k
  FROM v WHERE rule_ord > 2)
SELECT w.user_id // 10 AS user_id, (w.user_id % 10) / 10.0::DOUBLE AS fraction, CAST(b.rule IS NULL AS INT) AS is_valid, coalesce(b.rule, '') AS rule
FROM (SELECT DISTINCT user_id FROM w) w LEFT JOIN b ON b.user_id = w.user_id AND k = 1""")
def completed_verdicts(spark, sf):
    """Validity of each completed prefix and the rule that it breaks first."""
    keys, rows = ["user_id", "fraction"], completed(spark, sf)
    return oracle(check(rows, COMPLETED_BOOK, keys, ["step_index"]), rows, COMPLETED_BOOK, keys)


@query("completed_validity", f"""WITH {COMPLETED}, b AS (SELECT DISTINCT user_id FROM v WHERE rule_ord IN (4, 5))
SELECT w.user_id % 3 AS part, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(b.user_id IS NULL AS INT)), 6) AS validity
FROM (SELECT DISTINCT user_id // 10 AS user_id, user_id AS k FROM w) w LEFT JOIN b ON b.user_id = w.k GROUP BY 1""")
def completed_validity(spark, sf):
    """Share of completed prefixes that break no milestone, for each third of the users."""
    keys, rows = ["user_id", "fraction"], cut_lineage(completed(spark, sf))
    found = check(rows, COMPLETED_BOOK, keys, ["step_index"]).filter("rule <> 'VIEW_LEVEL_SKIP'")
    out = None
    for part in range(3):
        one = E.logic_validity(found, rows.filter(F.col("user_id") % 3 == part), keys).select(F.lit(part).cast("bigint").alias("part"), "n", "validity")
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["validity"])


# -- anomaly verdicts: the milestone rules are the truth, the earliest violation is the guess -----

def anomaly(spark, sf):
    """user_id, family, truth, rule, predicted, predicted_rule, score per journey."""
    found = journey_violations(spark, sf)
    true_rule = F.col("rule").isin("PURCHASE_BEFORE_SIGNUP", "FIRST_CLICK_BEFORE_VIEW")
    per_user = found.groupBy("user_id").agg(
        F.min(F.when(true_rule, F.struct("rule_ord", "rule")))["rule"].alias("rule"),
        F.min(F.struct("step_index", "rule_ord", "rule"))["rule"].alias("guess"),
        F.count(F.lit(1)).alias("v"))
    users = journeys(spark, sf).select("user_id").distinct()
    hit = F.coalesce(F.col("guess").isin("PURCHASE_BEFORE_SIGNUP", "FIRST_CLICK_BEFORE_VIEW"), F.lit(False))
    return users.join(per_user, "user_id", "left").select(
        "user_id", family_column().alias("family"), F.col("rule").isNull().cast("int").alias("truth"),
        F.coalesce("rule", F.lit("")).alias("rule"), (~hit).cast("int").alias("predicted"),
        F.when(hit, F.col("guess")).otherwise("").alias("predicted_rule"),
        (1 / (1 + F.coalesce(F.floor(F.col("v") / 5), F.lit(0)))).alias("score"))


ANOMALY = f"""{JOURNEY_RULES},
w AS (SELECT *, rule IN ('PURCHASE_BEFORE_SIGNUP', 'FIRST_CLICK_BEFORE_VIEW') AS true_rule,
  row_number() OVER (PARTITION BY user_id ORDER BY step_index, rule_ord) AS k FROM v),
pu AS (SELECT user_id, max(CASE WHEN k = 1 THEN rule END) AS guess, count(*) AS v,
  arg_min(rule, rule_ord) FILTER (true_rule) AS rule FROM w GROUP BY 1),
q AS (SELECT u.user_id, [{names(FAMILIES)}][CAST(u.user_id % 3 AS INT) + 1] AS family,
  CASE WHEN rule IS NULL THEN 1 ELSE 0 END AS truth, coalesce(rule, '') AS rule,
  CASE WHEN guess IN ('PURCHASE_BEFORE_SIGNUP', 'FIRST_CLICK_BEFORE_VIEW') THEN 0 ELSE 1 END AS predicted,
  CASE WHEN guess IN ('PURCHASE_BEFORE_SIGNUP', 'FIRST_CLICK_BEFORE_VIEW') THEN guess ELSE '' END AS predicted_rule,
  1.0::DOUBLE / (1 + coalesce(floor(v / 5.0), 0)) AS score
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN pu USING (user_id))"""
_PRF = """CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (truth = 0 AND predicted = 0) AS BIGINT) AS tp,
  CAST(count(*) FILTER (truth = 1 AND predicted = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (truth = 1 AND predicted = 1) AS BIGINT) AS tn,
  CAST(count(*) FILTER (truth = 0 AND predicted <> 0) AS BIGINT) AS fn"""
_PRF_RATES = """round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1"""
RATES = ["accuracy", "precision", "recall", "f1"]


@query("anomaly_confusion_prf", f"WITH {ANOMALY}, m AS (SELECT {_PRF} FROM q) SELECT *, {_PRF_RATES} FROM m")
def anomaly_confusion_prf(spark, sf):
    counts = anomaly(spark, sf).agg(*[c.alias(n) for n, c in E.confusion(F.col("truth"), F.col("predicted")).items()])
    return rounded(E.with_rates(counts).drop("correct"), RATES)


@query("per_family_metrics", f"""WITH {ANOMALY}, m AS (SELECT family, {_PRF} FROM q GROUP BY 1)
SELECT *, {_PRF_RATES} FROM m""")
def per_family_metrics(spark, sf):
    counts = anomaly(spark, sf).groupBy("family").agg(
        *[c.alias(n) for n, c in E.confusion(F.col("truth"), F.col("predicted")).items()])
    return rounded(E.with_rates(counts).drop("correct"), RATES)


@query("roc_auc_ties", f"""WITH {ANOMALY} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE
  WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS roc_auc
FROM q p JOIN q n ON p.truth = 1 AND n.truth = 0""")
def roc_auc_ties(spark, sf):
    return rounded(E.roc_auc(anomaly(spark, sf), "truth", "score"), ["roc_auc"])


@query("roc_auc_row_order", f"""WITH {ANOMALY}, k AS (SELECT truth, row_number() OVER (ORDER BY -score, user_id) AS k FROM q),
c AS (SELECT sum(k) FILTER (truth = 0) AS s, CAST(count(*) FILTER (truth = 0) AS DOUBLE) AS p,
  CAST(count(*) FILTER (truth = 1) AS DOUBLE) AS n FROM k)
SELECT round(CASE WHEN p = 0 OR n = 0 THEN 0.5 ELSE (s - p * (p + 1) / 2) / (p * n) END, 6) AS roc_auc FROM c""")
def roc_auc_row_order(spark, sf):
    return rounded(E.roc_auc_by_rank(anomaly(spark, sf), "truth", "score", "user_id"), ["roc_auc"])


@query("rule_attribution_both", f"""WITH {ANOMALY}
SELECT round(avg(CAST(predicted = 0 AND rule = predicted_rule AS INT)) FILTER (truth = 0 AND predicted = 0), 6)
  AS attribution_detected,
  round(coalesce(avg(CAST(predicted = 0 AND rule = predicted_rule AS INT)) FILTER (truth = 0), 0), 6) AS attribution_all
FROM q""")
def rule_attribution_both(spark, sf):
    measures = E.rule_attribution(F.col("truth"), F.col("predicted"), F.col("rule"), F.col("predicted_rule"))
    return rounded(anomaly(spark, sf).agg(*[c.alias(n) for n, c in measures.items()]), measures)


@query("detection_by_rule", f"""WITH {ANOMALY} SELECT rule, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (predicted = 0) AS BIGINT) AS detected, round(avg(CAST(predicted = 0 AS INT)), 6) AS rate
FROM q WHERE truth = 0 GROUP BY 1""")
def detection_by_rule(spark, sf):
    return rounded(E.detection_by_rule(anomaly(spark, sf), "truth", "predicted", "rule"), ["rate"])


# -- matching ids: graded documents against their labels --------------------------------------------

@query("last_row_wins", """SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS priority,
  CAST(max(o_orderkey) AS BIGINT) AS o_orderkey FROM orders GROUP BY 1""")
def last_row_wins(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_custkey", F.col("o_orderpriority").alias("priority"), "o_orderkey", F.col("o_orderkey").alias("ord"))
    return E.last_row(rows, "o_custkey", "ord")


@query("unmatched_count", """SELECT CAST(count(*) AS BIGINT) AS unmatched FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unmatched_count(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return E.unmatched(docs.select("doc_id"), labels, "doc_id").agg(F.count(F.lit(1)).alias("unmatched"))


@query("supplement_union", """SELECT doc_id, quality FROM labels
UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def supplement_union(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return E.supplement(labels.select("doc_id", "quality"),
                        docs.select("doc_id", F.lit(1).alias("quality")), "doc_id")


@query("label_partition", f"""WITH {ANOMALY} SELECT user_id AS example_id, CASE WHEN truth = 0 THEN rule ELSE 'valid' END
AS part FROM q""")
def label_partition(spark, sf):
    labels = anomaly(spark, sf).select(F.col("user_id").alias("example_id"), F.col("truth").alias("is_valid"), "rule")
    bad, good = E.by_label(labels)
    return bad.withColumnRenamed("violation_rule", "part").unionByName(good.withColumn("part", F.lit("valid")))


@query("coerced_predictions", """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1.0' WHEN 1 THEN ' 0 '
  WHEN 2 THEN '' WHEN 3 THEN 'yes' ELSE '0' END AS verdict,
  CASE WHEN event_id % 3 = 0 THEN CAST(round(value / 1000, 3) AS VARCHAR) ELSE '' END AS score FROM events),
c AS (SELECT event_id, coalesce(TRY_CAST(TRY_CAST(trim(verdict) AS DOUBLE) AS INT), -1) AS is_valid, score FROM t)
SELECT event_id, is_valid, round(coalesce(TRY_CAST(trim(score) AS DOUBLE),
  CASE WHEN is_valid >= 0 THEN CAST(is_valid AS DOUBLE) ELSE 0.5 END), 6) AS score FROM c""")
def coerced_predictions(spark, sf):
    """Verdicts and scores read from text of mixed quality."""
    e = F.col("event_id")
    text = F.when(e % 5 == 0, "1.0").when(e % 5 == 1, " 0 ").when(e % 5 == 2, "").when(e % 5 == 3, "yes").otherwise("0")
    score = F.when(e % 3 == 0, F.round(F.col("value") / 1000, 3).cast("string")).otherwise("")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", text.alias("v"), score.alias("s"))
    verdict = E.coerce_verdict(F.col("v"))
    return rows.select("event_id", verdict.alias("is_valid"),
                       F.round(E.coerce_score(F.col("s"), verdict), 6).alias("score"))


@query("verdict_constants", f"""WITH {ANOMALY}
SELECT user_id, CASE WHEN truth = 1 THEN 0.95::DOUBLE ELSE 0.05 END AS score,
  CASE WHEN truth = 1 THEN 0.92::DOUBLE ELSE 0.35 END AS predicted_yield,
  CASE WHEN truth = 1 THEN 0.91::DOUBLE ELSE 0.95 END AS confidence,
  round(1 - CASE WHEN truth = 1 THEN 0.92::DOUBLE ELSE 0.35 END, 4) AS defect_probability FROM q""")
def verdict_constants(spark, sf):
    from waymark.operators.advisory import yield_of
    out = anomaly(spark, sf).select("user_id", *[c.alias(n) for n, c in yield_of(F.col("truth") == 1).items()])
    return out.withColumn("defect_probability", F.round(1 - F.col("predicted_yield"), 4))


@query("hybrid_verdict", f"""WITH {ANOMALY}
SELECT q.user_id, q.truth AS is_valid, round(coalesce(m.score, CASE WHEN truth = 1 THEN 0.95 ELSE 0.05 END), 4) AS score
FROM q LEFT JOIN (SELECT user_id, score FROM q WHERE score < 0.5) m USING (user_id)""")
def hybrid_verdict(spark, sf):
    """The rules give the verdict, a model score is used where there is one."""
    rows = anomaly(spark, sf)
    scores = rows.filter("score < 0.5").select("user_id", F.col("score").alias("model_score"))
    fixed = F.when(F.col("truth") == 1, 0.95).otherwise(0.05)
    return rows.join(scores, "user_id", "left").select(
        "user_id", F.col("truth").alias("is_valid"), F.round(F.coalesce("model_score", fixed), 4).alias("score"))
