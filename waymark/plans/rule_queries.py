"""Rule checks: windows, milestones, levels, attribution, verdicts, advisories."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from waymark.functions import steps as S
from waymark.operators import advisory
from waymark.operators.ordered import running_state, segments
from waymark.operators.rules import (check, findings_function, first_violation, oracle, report, violation_text, violations,
                                     with_state)
from waymark.plans.inputs import (GRADED, JOURNEY_BOOK, JOURNEY_BOOK_BY_STEP, JOURNEYS, MAX_LEN, ORDER, ROUTES,
                                  isin, journey_segments, journeys, routes, table)
from waymark.plans.registry import query
from waymark.plans.sql_text import ADVISORY_SQL, CLASS_FLAGS, CLASS_VIOLATIONS, category_case, exact_violations
from waymark.rulesets import fabrication as fab
from waymark.session import small

USER = ["user_id"]


# -- sequences ------------------------------------------------------------------------

@query("journeys_long", f"WITH {JOURNEYS} SELECT user_id, step_index, step FROM j")
def journeys_long(spark, sf):
    return running_state(journeys(spark, sf), USER, ORDER).select("user_id", "step_index", "step")


@query("journeys_array", f"""WITH {JOURNEYS}
SELECT user_id, CAST(step_index // {MAX_LEN} AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n_steps,
       string_agg(step, '|' ORDER BY step_index) AS steps FROM j GROUP BY 1, 2""")
def journeys_array(spark, sf):
    return journey_segments(spark, sf).select("user_id", "segment", F.size("steps").cast("bigint").alias("n_steps"),
                                              F.array_join("steps", "|").alias("steps"))


@query("dialogues_array", f"""WITH j AS (SELECT conv_id, role,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, CAST(i // {MAX_LEN} AS BIGINT) AS segment, string_agg(role, '|' ORDER BY i) AS roles FROM j GROUP BY 1, 2""")
def dialogues_array(spark, sf):
    rows = running_state(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    return segments(rows, ["conv_id"], {"role": F.col("role")}).select(
        "conv_id", "segment", F.array_join("steps", "|").alias("roles"))


@query("order_routes_long", """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
  l_returnflag, l_linestatus) - 1 AS step_index, l_returnflag || l_linestatus AS step FROM lineitem""")
def order_routes_long(spark, sf):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
             "l_tax", "l_returnflag", "l_linestatus"]
    rows = table(spark, sf, "lineitem").select("l_orderkey", *order,
                                               F.concat("l_returnflag", "l_linestatus").alias("step"))
    return running_state(rows, ["l_orderkey"], order).select("l_orderkey", "step_index", "step")


# -- rules on graded journeys ------------------------------------------------------------

def _window(kind: str, n: int) -> str:
    return (f"coalesce(max(CASE WHEN kind = '{kind}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id "
            f"ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0)")


def _before(kind: str) -> str:
    return (f"coalesce(max(CASE WHEN kind = '{kind}' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id "
            "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")


JOURNEY_RULES = f"""{GRADED},
f AS (SELECT *, {_window('click', 3)} AS click3, {_window('view', 4)} AS view4, {_window('click', 4)} AS click4,
  {_before('signup')} AS signed, {_before('view')} AS viewed, {_before('click')} AS clicked,
  last_value(CASE WHEN kind = 'view' THEN grade END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM j),
v AS (
  SELECT user_id, step_index, step, 1 AS rule_ord, 'PURCHASE_NO_CLICK' AS rule FROM f
    WHERE kind = 'purchase' AND click3 = 0
  UNION ALL SELECT user_id, step_index, step, 2, 'ERROR_NO_TRACE' FROM f
    WHERE kind = 'error' AND (view4 = 0 OR click4 = 0)
  UNION ALL SELECT user_id, step_index, step, 3, 'VIEW_LEVEL_SKIP' FROM f
    WHERE kind = 'view' AND (grade > prior + 1 OR grade < prior)
  UNION ALL SELECT user_id, step_index, step, 4, 'PURCHASE_BEFORE_SIGNUP' FROM f
    WHERE kind = 'purchase' AND (signed = 0 OR viewed = 0)
  UNION ALL SELECT user_id, step_index, step, 5, 'FIRST_CLICK_BEFORE_VIEW' FROM f
    WHERE kind = 'click' AND clicked = 0 AND viewed = 0)"""


def journey_violations(spark, sf, book=JOURNEY_BOOK):
    return check(journeys(spark, sf, graded=True), book, USER, ORDER)


def _one_rule(name: str, rule: str):
    @query(name, f"WITH {JOURNEY_RULES} SELECT user_id, step_index, step FROM v WHERE rule = '{rule}'")
    def plan(spark, sf):
        return journey_violations(spark, sf).filter(F.col("rule") == rule).select("user_id", "step_index", "step")
    return plan


windowed_violations = _one_rule("windowed_violations", "PURCHASE_NO_CLICK")
_one_rule("two_enabler_violations", "ERROR_NO_TRACE")
_one_rule("level_skip_violations", "VIEW_LEVEL_SKIP")
_one_rule("milestone_violations", "PURCHASE_BEFORE_SIGNUP")
_one_rule("first_order_violations", "FIRST_CLICK_BEFORE_VIEW")


@query("all_violations", f"WITH {JOURNEY_RULES} SELECT user_id, step_index, step, rule_ord, rule FROM v")
def all_violations(spark, sf):
    return journey_violations(spark, sf).select("user_id", "step_index", "step", "rule_ord", "rule")


@query("first_violation_rule_major", f"""WITH {JOURNEY_RULES}, r AS (SELECT user_id, rule, step_index,
  row_number() OVER (PARTITION BY user_id ORDER BY rule_ord, step_index) AS n FROM v)
SELECT user_id, rule, step_index FROM r WHERE n = 1""")
def first_violation_rule_major(spark, sf):
    return first_violation(journey_violations(spark, sf), JOURNEY_BOOK, USER)


@query("first_violation_step_major", f"""WITH {JOURNEY_RULES}, r AS (SELECT user_id, rule, step_index,
  row_number() OVER (PARTITION BY user_id ORDER BY step_index, rule_ord) AS n FROM v)
SELECT user_id, rule, step_index FROM r WHERE n = 1""")
def first_violation_step_major(spark, sf):
    return first_violation(journey_violations(spark, sf), JOURNEY_BOOK_BY_STEP, USER)


@query("validation_summary", f"""WITH {JOURNEY_RULES}, c AS (SELECT user_id, count(*) AS n FROM v GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id % 3 AS family, CAST(count(*) AS BIGINT) AS sequences, CAST(count(c.n) AS BIGINT) AS invalid,
  CAST(coalesce(sum(c.n), 0) AS BIGINT) AS violations FROM u LEFT JOIN c USING (user_id) GROUP BY 1""")
def validation_summary(spark, sf):
    per_user = report(journey_violations(spark, sf), journeys(spark, sf), USER)
    return per_user.groupBy((F.col("user_id") % 3).alias("family")).agg(
        F.count(F.lit(1)).alias("sequences"), F.count_if(~F.col("is_valid")).alias("invalid"),
        F.sum("n_violations").alias("violations"))


@query("violation_report", f"""WITH {JOURNEY_RULES}, c AS (SELECT user_id, count(*) AS n,
  string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM v GROUP BY 1),
u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, CAST(c.n IS NULL AS INT) AS is_valid, CAST(coalesce(c.n, 0) AS BIGINT) AS n_violations,
  coalesce(rules, '') AS rules FROM u LEFT JOIN c USING (user_id)""")
def violation_report(spark, sf):
    found = report(journey_violations(spark, sf), journeys(spark, sf), USER)
    return found.select("user_id", F.col("is_valid").cast("int").alias("is_valid"), "n_violations",
                        F.array_join("rules", ",").alias("rules"))


@query("ranked_findings", f"""WITH {JOURNEY_RULES}, w AS (SELECT *, CASE rule WHEN 'PURCHASE_BEFORE_SIGNUP' THEN 4
  WHEN 'PURCHASE_NO_CLICK' THEN 3 WHEN 'ERROR_NO_TRACE' THEN 2 ELSE 1 END AS severity FROM v),
r AS (SELECT user_id, rule, step_index, severity, row_number() OVER (PARTITION BY user_id
  ORDER BY severity DESC, step_index, rule_ord) AS place FROM w)
SELECT user_id, rule, step_index, severity, CAST(place AS INT) AS place FROM r WHERE place <= 3""")
def ranked_findings(spark, sf):
    order = F.col("severity").desc(), F.col("step_index"), F.col("rule_ord")
    ranked = journey_violations(spark, sf).withColumn(
        "place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    return ranked.filter("place <= 3").select("user_id", "rule", "step_index", "severity", "place")


@query("findings_table_function", f"""WITH {JOURNEY_RULES}, w AS (SELECT *, CASE rule WHEN 'PURCHASE_BEFORE_SIGNUP' THEN 4
  WHEN 'PURCHASE_NO_CLICK' THEN 3 WHEN 'ERROR_NO_TRACE' THEN 2 ELSE 1 END AS severity FROM v)
SELECT user_id, rule, rule_ord, step_index, step, severity FROM w""")
def findings_table_function(spark, sf):
    """The same findings by one SQL call of a table function."""
    spark.udtf.register("journey_findings", findings_function(JOURNEY_BOOK))
    marked = journeys(spark, sf, graded=True).withColumns({"mask": JOURNEY_BOOK.mask(F.col("step")), "level": JOURNEY_BOOK.level_of(F.col("step"))})
    return spark.sql("SELECT * FROM journey_findings(TABLE({steps}) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id')",
                     steps=marked.select("user_id", "ts", "event_id", "step", "mask", "level"))


# -- fabrication rules on routes ------------------------------------------------------------

def exact_state(spark, sf):
    return with_state(routes(spark, sf), fab.EXACT, ["user_id", "family"], ORDER)


def class_state(spark, sf, **options):
    rows = routes(spark, sf).withColumn("step", S.canonical(F.col("step")))
    classed = S.with_classes(rows)
    return with_state(classed, fab.BY_CLASS, ["user_id", "family"], ORDER, mask=F.col("class_mask"), **options)


FAB_COLUMNS = ["user_id", "family", "rule", "step_index", "step"]


@query("fab_violations", f"WITH {ROUTES}, {exact_violations()} SELECT user_id, family, rule, step_index, step FROM v")
def fab_violations(spark, sf):
    return violations(exact_state(spark, sf), fab.EXACT, ["user_id", "family"]).select(*FAB_COLUMNS)


@query("fab_first_violation", f"""WITH {ROUTES}, {exact_violations()}, r AS (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY rule_ord, step_index) AS n FROM v)
SELECT user_id, family, rule, step_index FROM r WHERE n = 1""")
def fab_first_violation(spark, sf):
    found = violations(exact_state(spark, sf), fab.EXACT, ["user_id", "family"])
    return first_violation(found, fab.EXACT, ["user_id", "family"])


@query("rule_oracle", f"""WITH {ROUTES}, {exact_violations()}, r AS (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY rule_ord, step_index) AS n FROM v),
u AS (SELECT DISTINCT user_id, family FROM j)
SELECT u.user_id, u.family, CAST(r.rule IS NULL AS INT) AS is_valid, coalesce(r.rule, '') AS rule
FROM u LEFT JOIN (SELECT * FROM r WHERE n = 1) r ON r.user_id = u.user_id""")
def rule_oracle(spark, sf):
    found = violations(exact_state(spark, sf), fab.EXACT, ["user_id", "family"])
    return oracle(found, routes(spark, sf), fab.EXACT, ["user_id", "family"])


@query("violation_texts", f"""WITH {JOURNEY_RULES} SELECT user_id, '[' || rule || '] step ' || step_index || ' (''' || step
  || '''): ''' || step || ''' needs CLICK within 3 steps before it' AS line FROM v WHERE rule = 'PURCHASE_NO_CLICK'""")
def violation_texts(spark, sf):
    found = journey_violations(spark, sf).filter(F.col("rule") == "PURCHASE_NO_CLICK")
    return found.select("user_id", violation_text().alias("line"))


@query("fab_class_violations", f"""WITH {ROUTES}, {CLASS_FLAGS}, {CLASS_VIOLATIONS}
SELECT user_id, family, rule, step_index, step FROM cv""")
def fab_class_violations(spark, sf):
    return violations(class_state(spark, sf), fab.BY_CLASS, ["user_id", "family"]).select(*FAB_COLUMNS)


def routed(spark, sf):
    """Exact rules for sequences of known names only, class rules for the others."""
    keys = ["user_id", "family"]
    rows = routes(spark, sf).withColumn("step", S.canonical(F.col("step")))
    known = small(rows.groupBy(*keys).agg(F.bool_and(S.in_vocabulary(F.col("step"))).alias("known")))
    marked = rows.join(known, keys)  # routed before the rules run, so each row meets one rule book
    exact = violations(with_state(marked.filter("known"), fab.EXACT, keys, ORDER), fab.EXACT, keys)
    by_class = with_state(S.with_classes(marked.filter("NOT known")), fab.BY_CLASS, keys, ORDER, mask=F.col("class_mask"))
    return exact.unionByName(violations(by_class, fab.BY_CLASS, keys)), rows, known


ROUTED_SQL = f"""{ROUTES}, {CLASS_FLAGS}, {CLASS_VIOLATIONS}, {exact_violations('c')},
k AS (SELECT user_id, bool_and({isin('step', fab.VOCABULARY)}) AS known FROM c GROUP BY 1),
rv AS (SELECT v.user_id, v.family, v.rule, v.step_index, v.step FROM v JOIN k USING (user_id) WHERE known
  UNION ALL SELECT cv.user_id, cv.family, cv.rule, cv.step_index, cv.step FROM cv JOIN k USING (user_id)
  WHERE NOT known)"""


@query("routed_violations", f"WITH {ROUTED_SQL} SELECT user_id, family, rule, step_index, step FROM rv")
def routed_violations(spark, sf):
    return routed(spark, sf)[0].select(*FAB_COLUMNS)


@query("verdict_with_confidence", f"""WITH {ROUTED_SQL},
n AS (SELECT user_id, count(*) AS n FROM rv GROUP BY 1),
u AS (SELECT user_id, count(*) AS unknown FROM c WHERE category = 'UNKNOWN' AND step <> ''
  AND NOT (starts_with(step, '[') AND ends_with(step, ']')) GROUP BY 1),
q AS (SELECT DISTINCT user_id FROM j)
SELECT user_id, CASE WHEN n.n > 0 THEN 'INVALID' WHEN unknown > 0 THEN 'INSUFFICIENT_INFORMATION' ELSE 'VALID' END
  AS verdict, CAST(coalesce(n.n, 0) AS BIGINT) AS n_violations,
  CAST(CASE WHEN n.n > 0 THEN 0 ELSE coalesce(unknown, 0) END AS BIGINT) AS n_unknown
FROM q LEFT JOIN n USING (user_id) LEFT JOIN u USING (user_id)""")
def verdict_with_confidence(spark, sf):
    found, rows, _ = routed(spark, sf)
    return advisory.verdicts(found, rows, USER).select("user_id", "verdict", "n_violations", "n_unknown")


@query("strict_advisory", ADVISORY_SQL)
def strict_advisory(spark, sf):
    return advisory.strict_advisory(routes(spark, sf), USER, ORDER).select("user_id", "code", "step_index", "step")


@query("edge_support", f"""WITH {ROUTES}, {exact_violations()},
f AS (SELECT rule, count(*) AS violated FROM v GROUP BY 1)
SELECT rule, CAST(violated AS BIGINT) AS violated, CAST(CASE rule WHEN 'RULE_METAL_ETCH_NO_LITHO' THEN 2
  WHEN 'RULE_PAD_OPEN_BEFORE_DEP' THEN 2 ELSE 1 END AS BIGINT) AS edges FROM f WHERE rule <> 'RULE_LITHO_LEVEL_SKIP'""")
def edge_support(spark, sf):
    """The dependency graph of the rules with how often each rule is broken."""
    from waymark.operators.rules import causal_edges
    edges = causal_edges(fab.EXACT, spark).groupBy("rule").agg(F.count(F.lit(1)).alias("edges"))
    broken = fab_violations(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("violated"))
    return broken.join(edges, "rule").select("rule", "violated", "edges")


# -- small ordered measures ---------------------------------------------------------------------

@query("block_signature", f"""WITH {JOURNEYS}, p AS (SELECT *, lag(step) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS prior FROM j),
s AS (SELECT user_id, string_agg(step, '|' ORDER BY step_index) AS signature FROM p
  WHERE prior IS NULL OR prior <> step OR step_index % {MAX_LEN} = 0 GROUP BY user_id, step_index // {MAX_LEN})
SELECT user_id, signature FROM s""")
def block_signature(spark, sf):
    from waymark.functions.arrays import collapse
    return journey_segments(spark, sf).select("user_id", F.array_join(collapse(F.col("steps")), "|").alias("signature"))


@query("transitions_heuristic", f"""WITH {JOURNEYS}, p AS (SELECT *, lag(step) OVER (PARTITION BY user_id
  ORDER BY ts, event_id) AS prior FROM j),
t AS (SELECT user_id, count(*) AS n, sum(CASE WHEN prior <> step THEN 1 ELSE 0 END) AS changes FROM p GROUP BY 1),
s AS (SELECT user_id, CASE WHEN n > 1 THEN 1.0 - CAST(changes AS DOUBLE) / (n - 1) ELSE 1.0 END AS score FROM t)
SELECT user_id, round(0.55::DOUBLE + score * 0.40::DOUBLE, 3) AS predicted_yield,
  round(0.65::DOUBLE + score * 0.25::DOUBLE, 3) AS confidence FROM s""")
def transitions_heuristic(spark, sf):
    return advisory.ordering_heuristic(journeys(spark, sf), USER, ORDER, "step")


@query("first_last_index", f"""WITH {JOURNEYS} SELECT user_id, CAST(min(CASE WHEN step = 'purchase' THEN step_index END)
  AS BIGINT) AS first_purchase, CAST(max(CASE WHEN step = 'purchase' THEN step_index END) AS BIGINT) AS last_purchase,
  CAST(coalesce(min(CASE WHEN step = 'signup' THEN step_index END), count(*)) AS BIGINT) AS first_signup
FROM j GROUP BY 1""")
def first_last_index(spark, sf):
    rows = running_state(journeys(spark, sf), USER, ORDER)
    at = lambda kind: F.when(F.col("step") == kind, F.col("step_index"))
    return rows.groupBy("user_id").agg(
        F.min(at("purchase")).alias("first_purchase"), F.max(at("purchase")).alias("last_purchase"),
        F.coalesce(F.min(at("signup")), F.count(F.lit(1))).alias("first_signup"))


# -- classification --------------------------------------------------------------------------------

@query("step_category", f"""WITH {ROUTES} SELECT step, {category_case('step')} AS category,
  CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2""")
def step_category(spark, sf):
    counted = routes(spark, sf).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("step", S.category(F.col("step")).alias("category"), "n")


@query("category_histogram", f"""WITH {ROUTES} SELECT {category_case('step')} AS category,
  CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1""")
def category_histogram(spark, sf):
    return step_category(spark, sf).groupBy("category").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "category")


@query("step_event_members", f"""WITH {ROUTES}, {CLASS_FLAGS}
SELECT step, {', '.join(f'CAST(max(is_{e.lower()}) AS INT) AS {e.lower()}' for e in fab.BY_CLASS.events)} FROM c GROUP BY 1""")
def step_event_members(spark, sf):
    distinct = routes(spark, sf).select(S.canonical(F.col("step")).alias("step")).distinct()
    classed = S.with_classes(distinct)
    return classed.select("step", *[fab.BY_CLASS.has(F.col("class_mask"), e).cast("int").alias(e.lower())
                                    for e in fab.BY_CLASS.events])
