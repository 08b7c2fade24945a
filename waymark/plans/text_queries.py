"""Quantities in texts, descriptions, coverage, matches, names, nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import quantities as Q
from waymark.functions import steps as S
from waymark.operators import semantics as D
from waymark.operators import serving
from waymark.plans.inputs import ROUTES, routes, table
from waymark.plans.registry import query
from waymark.plans.sql_text import category_case
from waymark.rulesets import fabrication as fab
from waymark.session import spread


# -- parameter texts built from the line items -------------------------------------------------

def parameter_texts(spark, sf):
    i = lambda c: F.col(c).cast("bigint").cast("string")
    n = F.col("l_linenumber")
    text = (F.when(n % 4 == 0, F.concat(i("l_quantity"), F.lit(" nm; "), i("l_extendedprice"), F.lit(" °C; "),
                                        i("l_suppkey"), F.lit(" min")))
            .when(n % 4 == 1, F.concat(F.lit("Boron; "), i("l_partkey"), F.lit(" keV; dose "), i("l_quantity"),
                                       F.lit("×10¹³ cm⁻²; tilt 7°")))
            .when(n % 4 == 2, F.concat(F.lit("LPCVD "), i("l_suppkey"), F.lit(" sccm; "), i("l_quantity"),
                                       F.lit(" Torr; "), i("l_partkey"), F.lit(" µm, 30s")))
            .otherwise(F.concat(i("l_partkey"), F.lit(" rpm; -"), i("l_quantity"), F.lit(" keV; "), i("l_suppkey"),
                                F.lit(" W; 5 slm, 300 mm"))))
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_suppkey", "l_partkey"]
    return spread(table(spark, sf, "lineitem").select(*columns)).select("l_orderkey", "l_linenumber", text.alias("text"))


_I = "CAST(floor({}) AS BIGINT)"
_TEXT = f"""CASE l_linenumber % 4
  WHEN 0 THEN {_I.format('l_quantity')} || ' nm; ' || {_I.format('l_extendedprice')} || ' °C; ' || l_suppkey || ' min'
  WHEN 1 THEN 'Boron; ' || l_partkey || ' keV; dose ' || {_I.format('l_quantity')} || '×10¹³ cm⁻²; tilt 7°'
  WHEN 2 THEN 'LPCVD ' || l_suppkey || ' sccm; ' || {_I.format('l_quantity')} || ' Torr; ' || l_partkey || ' µm, 30s'
  ELSE l_partkey || ' rpm; -' || {_I.format('l_quantity')} || ' keV; ' || l_suppkey || ' W; 5 slm, 300 mm' END"""
_NORMAL = f"replace(replace(replace(translate(text, '{fab.SUPERSCRIPTS[0]}', '{fab.SUPERSCRIPTS[1]}'), '×10', 'e'), 'µ', 'u'), 'μ', 'u')"


def _found(pattern: str, quantity: str, factor: float, lo: float, hi: float, unit: str) -> str:
    regex = (fab.NUMBER + r"\s*(?:" + pattern + ")").replace("'", "''")
    return (f"SELECT l_orderkey, l_linenumber, '{quantity}' AS quantity, '{unit}' AS unit, {lo!r}::DOUBLE AS lo, "
            f"{hi!r}::DOUBLE AS hi, CAST(unnest(regexp_extract_all(t, '{regex}', 1)) AS DOUBLE) * {factor!r}::DOUBLE AS cv "
            "FROM n")


QUANTITIES = f"""n AS (SELECT l_orderkey, l_linenumber, {_NORMAL} AS t FROM
  (SELECT l_orderkey, l_linenumber, {_TEXT} AS text FROM lineitem)),
q AS ({' UNION ALL '.join(_found(*r) for r in fab.QUANTITIES)})"""


@query("quantities", f"""WITH {QUANTITIES} SELECT quantity, unit, CAST(count(*) AS BIGINT) AS n,
  round(min(cv), 6) AS lowest, round(max(cv), 6) AS highest FROM q GROUP BY 1, 2""")
def quantities(spark, sf):
    found = Q.extract(parameter_texts(spark, sf), "text")
    return found.groupBy("quantity", "unit").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("canonical_value"), 6).alias("lowest"),
        F.round(F.max("canonical_value"), 6).alias("highest"))


@query("implausible_quantities", f"""WITH {QUANTITIES} SELECT l_orderkey, l_linenumber, quantity, unit,
  round(cv, 6) AS canonical_value FROM q WHERE cv < lo OR cv > hi""")
def implausible_quantities(spark, sf):
    found = Q.implausible(Q.extract(parameter_texts(spark, sf), "text"))
    return found.select("l_orderkey", "l_linenumber", "quantity", "unit",
                        F.round("canonical_value", 6).alias("canonical_value"))


@query("document_quantities", f"""WITH n AS (SELECT doc_id AS l_orderkey, 0 AS l_linenumber,
  {_NORMAL.replace("translate(text", "translate(replace(replace(text, 'x10', 'e'), '·', ' ')")} AS t FROM documents),
q AS ({' UNION ALL '.join(_found(*r) for r in fab.QUANTITIES)})
SELECT quantity, unit, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1, 2""")
def document_quantities(spark, sf):
    """Quantities in the whole texts of the documents."""
    found = Q.extract(spread(table(spark, sf, "documents").select("doc_id", "text")), "text")
    return found.groupBy("quantity", "unit").agg(F.count(F.lit(1)).alias("n"))


# -- descriptions ------------------------------------------------------------------------------

def description_rows(spark, sf):
    """Part rows read as descriptions: step, description, parameters, family, in key order."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_type").alias("step"), F.col("p_name").alias("description"),
                    F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise("").alias("parameters"),
                    F.concat(F.lit("F"), (F.col("p_size") % 3).cast("string")).alias("family"))


@query("semantics_union", """WITH r AS (SELECT p_partkey AS ord, p_type AS step, p_name AS d,
  CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS p, 'F' || (p_size % 3) AS f FROM part),
d AS (SELECT step, d, min(ord) AS ord FROM r WHERE d <> '' GROUP BY 1, 2),
p AS (SELECT step, p, min(ord) AS ord FROM r WHERE p <> '' GROUP BY 1, 2)
SELECT step, (SELECT string_agg(d, '|' ORDER BY ord) FROM d WHERE d.step = s.step) AS descriptions,
  coalesce((SELECT string_agg(p, '|' ORDER BY ord) FROM p WHERE p.step = s.step), '') AS parameters,
  (SELECT string_agg(DISTINCT f, '|' ORDER BY f) FROM r WHERE r.step = s.step) AS families
FROM (SELECT DISTINCT step FROM r) s""")
def semantics_union(spark, sf):
    merged = D.merge_semantics(description_rows(spark, sf))
    return merged.select("step", *[F.array_join(c, "|").alias(c) for c in ("descriptions", "parameters", "families")])


@query("coverage", """WITH v AS (SELECT DISTINCT p_name || ' ' || p_type AS step FROM part),
r AS (SELECT CASE WHEN p_size > 25 THEN p_name || ' ' || p_type ELSE p_name END AS step,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS p FROM part),
k AS (SELECT step, bool_or(p <> '') AS with_p FROM r GROUP BY 1)
SELECT CAST(count(v.step) AS BIGINT) AS vocab_size, CAST(count(k.step) AS BIGINT) AS steps_with_semantics,
  CAST(count(*) FILTER (v.step IS NOT NULL AND k.step IS NOT NULL) AS BIGINT) AS vocab_covered,
  CAST(count(*) FILTER (v.step IS NOT NULL AND k.step IS NULL) AS BIGINT) AS vocab_missing,
  CAST(count(*) FILTER (with_p) AS BIGINT) AS steps_with_parameters FROM v FULL JOIN k ON v.step = k.step""")
def coverage(spark, sf):
    p = table(spark, sf, "part")
    full = F.concat_ws(" ", "p_name", "p_type")
    rows = p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") > 25, full).otherwise(F.col("p_name")).alias("step"),
                    F.col("p_name").alias("description"),
                    F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("parameters"),
                    F.lit("F").alias("family"))
    return D.coverage(p.select(full.alias("step")), D.merge_semantics(rows))


@query("jaccard_best_match", """WITH a AS (SELECT DISTINCT p_brand, p_name || ' ' || p_type AS name FROM part),
b AS (SELECT DISTINCT p_brand, p_type || ' ' || p_name || ' ' || p_size AS name FROM part),
ta AS (SELECT *, list_distinct(string_split(name, ' ')) AS t FROM a),
tb AS (SELECT *, list_distinct(string_split(name, ' ')) AS t FROM b),
p AS (SELECT ta.p_brand, ta.name, tb.name AS match, CAST(len(list_intersect(ta.t, tb.t)) AS DOUBLE) /
  len(list_distinct(list_concat(ta.t, tb.t))) AS score FROM ta JOIN tb ON ta.p_brand = tb.p_brand),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY score DESC, match) AS n FROM p WHERE score >= 0.5)
SELECT p_brand, name, match, round(score, 6) AS score FROM r WHERE n = 1""")
def jaccard_best_match(spark, sf):
    p = table(spark, sf, "part")
    left = p.select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    right = p.select("p_brand", F.concat_ws(" ", "p_type", "p_name", F.col("p_size").cast("string")).alias("name"))
    return D.best_match(left, right, "p_brand", "name").withColumn("score", F.round("score", 6))


_TOKENS = "list_distinct(list_filter(string_split_regex(trim({}), '\\s+'), lambda x: x <> ''))"


@query("step_descriptions", f"""WITH {ROUTES},
k AS (SELECT step, min(event_id) AS ord, {category_case('step')} AS kind FROM j WHERE family <> 'MOSFET' GROUP BY 1),
t AS (SELECT step, 'does ' || lower(step) AS text, kind, {_TOKENS.format('step')} AS tokens FROM k),
w AS (SELECT DISTINCT step, {category_case('step')} AS kind, {_TOKENS.format('step')} AS tokens FROM j),
tw AS (FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in fab.DOCUMENTED_TWINS.items())}) v(step, twin)),
p AS (SELECT w.step, t.step AS match, t.text, CAST(len(list_intersect(w.tokens, t.tokens)) AS DOUBLE) / len(list_distinct(list_concat(w.tokens, t.tokens))) AS score
  FROM w JOIN t USING (kind)),
b AS (SELECT step, text FROM p WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY step ORDER BY score DESC, match) = 1)
SELECT w.step, w.step || ': ' || coalesce(own.text, of_twin.text, b.text, '(' || lower(w.kind) || ' operation)')
  || coalesce('  [params: ' || k.ord || ' nm]', '') AS line
FROM w LEFT JOIN t own ON own.step = w.step LEFT JOIN tw ON tw.step = w.step LEFT JOIN t of_twin ON of_twin.step = tw.twin
LEFT JOIN b ON b.step = w.step LEFT JOIN k ON k.step = w.step""")
def step_descriptions(spark, sf):
    """Best description of each route step, from texts recorded for the steps of one family."""
    rows = routes(spark, sf)
    texts = (rows.filter(F.col("family") != "MOSFET").groupBy("step").agg(F.min("event_id").alias("ord"))
             .select("ord", "step", F.concat(F.lit("does "), F.lower("step")).alias("description"),
                     F.concat(F.col("ord").cast("string"), F.lit(" nm")).alias("parameters"), F.lit("IC").alias("family")))
    known = D.merge_semantics(texts)
    described = D.describe(rows, known).join(known.select("step", "parameters"), "step", "left")
    return described.select("step", D.render(F.col("step"), F.col("description"), F.col("parameters")).alias("line"))


_RAW = ["etch_rate_std", "cd_nm", "user_click_rate", "queueTime_ms", "overlay_nm", "wait-time_p95"]


@query("humanized_names", f"""WITH r AS (SELECT [{', '.join(repr(n) for n in _RAW)}][CAST(event_id % {len(_RAW)} AS INT) + 1]
  AS raw FROM events)
SELECT raw, CASE raw WHEN 'etch_rate_std' THEN 'Etch Rate Std Dev' WHEN 'cd_nm' THEN 'Critical Dimension (nm)'
  WHEN 'overlay_nm' THEN 'Overlay Error (nm)' WHEN 'user_click_rate' THEN 'User Click Rate'
  WHEN 'queueTime_ms' THEN 'QueueTime Ms' ELSE 'Wait-Time P95' END AS label, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2""")
def humanized_names(spark, sf):
    raw = F.element_at(F.array(*map(F.lit, _RAW)), (F.col("event_id") % len(_RAW) + 1).cast("int"))
    counted = table(spark, sf, "events").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("raw", S.humanize(F.col("raw")).alias("label"), "n")


# -- nested documents -------------------------------------------------------------------------------

@query("props_json", """SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""")
def props_json(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def batch_documents(spark, sf):
    """One nested batch document per event, as JSON text and back."""
    from waymark.sources.readers import BATCH_TYPE
    shap = F.array(F.struct(F.lit("value").alias("feature"), F.col("value"), (F.col("value") - 50).alias("contribution")),
                   F.struct(F.lit("hour").alias("feature"), F.hour("ts").cast("double").alias("value"),
                            (F.hour("ts") - 12.0).alias("contribution")))
    step = lambda n, risk, s: F.struct(F.lit(n).alias("step_id"), F.col("event_type").alias("step_name"),
                                       risk.alias("risk_score"), s.alias("shap"))
    risk = F.least(F.col("value") / 199.7, F.lit(1.0))
    document = F.struct(F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("batch_id"),
                        (1 - risk).alias("predicted_yield"),
                        F.array(step("s0", risk, shap), step("s1", F.lit(0.1), F.slice(shap, 1, 0))).alias("per_step"))
    texts = table(spark, sf, "events").select(F.to_json(document).alias("json"))
    return texts.select(F.from_json("json", BATCH_TYPE).alias("d")).select("d.*")


@query("batch_contributions", """WITH e AS (SELECT 'b' || event_id AS batch_id, event_type, value, ts,
  least(value / 199.7::DOUBLE, 1.0::DOUBLE) AS risk FROM events)
SELECT batch_id, 0 AS step_index, 's0' AS step_id, event_type AS step_name, round(risk, 6) AS risk_score, 'value' AS feature,
  round(value, 6) AS value, round(value - 50, 6) AS contribution FROM e
UNION ALL SELECT batch_id, 0, 's0', event_type, round(risk, 6), 'hour', CAST(hour(ts) AS DOUBLE), hour(ts) - 12.0::DOUBLE FROM e
UNION ALL SELECT batch_id, 1, 's1', event_type, 0.1::DOUBLE, NULL, NULL, NULL FROM e""")
def batch_contributions(spark, sf):
    flat = serving.flatten_batches(batch_documents(spark, sf))
    return flat.withColumns({c: F.round(c, 6) for c in ("risk_score", "value", "contribution")})


@query("batch_summaries", """SELECT 'b' || event_id AS batch_id, TIMESTAMP '2026-05-30 10:00:00' AS timestamp, 'IC' AS material,
  round(1 - least(value / 199.7::DOUBLE, 1.0::DOUBLE), 6) AS predicted_yield,
  round(1 - (1 - least(value / 199.7::DOUBLE, 1.0::DOUBLE)), 4) AS defect_probability, 0.7::DOUBLE AS confidence,
  0 AS risk_steps_detected FROM events""")
def batch_summaries(spark, sf):
    out = serving.batch_summaries(batch_documents(spark, sf), F.lit("2026-05-30 10:00:00").cast("timestamp"))
    return out.withColumn("predicted_yield", F.round("predicted_yield", 6))
