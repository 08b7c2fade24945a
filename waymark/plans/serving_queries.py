"""Result pages, details, risk spans and contributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import arrays as A
from waymark.operators import serving
from waymark.operators.ordered import running_state
from waymark.plans.inputs import JOURNEYS, ORDER, SEGMENTS, journeys, table
from waymark.plans.registry import query
from waymark.plans.score_queries import CUTS, EXAMPLES, FRACTIONS, NGRAMS, family_column, predicted
from waymark.session import cut_lineage


def whole_cuts(spark, sf):
    """Every whole sequence cut at every fraction, with the lengths of both parts; segments don't matter."""
    lengths = journeys(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    fractions = F.explode(F.array(*[F.lit(f) for f in FRACTIONS])).alias("fraction")
    rows = lengths.select("*", fractions).withColumn("cut", A.cut_point(F.col("n"), F.col("fraction")))
    family = family_column()
    sid = F.format_string("seq_%d_0", "user_id")
    return rows.select(
        "user_id", "fraction", family.alias("family"), F.col("cut").alias("partial_step_count"),
        F.concat_ws("_", family, sid, F.floor(F.col("fraction") * 100).cast("string")).alias("example_id"),
        (F.col("n") - F.col("cut")).cast("int").alias("suffix_step_count"))


def results(spark, sf):
    """Cut rows with their ranked next steps and a completion; all three must be present."""
    cuts = whole_cuts(spark, sf)
    inputs = cuts.select("example_id", "user_id", "family", F.col("fraction").alias("completion_fraction"), "partial_step_count")
    ranks = predicted(journeys(spark, sf), ["user_id"])
    ids = cuts.select("user_id", "fraction", "example_id")
    named = ranks.join(ids, ["user_id", "fraction"]).select(
        "example_id", *[F.coalesce(F.try_element_at("ranks", F.lit(i)), F.lit("")).alias(f"rank{i}") for i in range(1, 6)])
    other = cuts.select((F.col("user_id") - 1).alias("user_id"), "fraction", F.col("suffix_step_count").alias("predicted_step_count"))
    completions = ids.join(other, ["user_id", "fraction"]).select("example_id", "predicted_step_count")
    return serving.joined_results(inputs, named, completions, "example_id")


RESULTS = f"""{JOURNEYS}, {SEGMENTS}, {EXAMPLES}, {NGRAMS}, {CUTS},
y AS (SELECT x.example_id, len(o.suffix) AS m FROM x JOIN x o ON o.user_id = x.user_id + 1 AND o.segment = x.segment
  AND o.fraction = x.fraction),
res AS (SELECT x.example_id, x.user_id, fam AS family, x.fraction AS completion_fraction,
  CAST(len(part) AS INT) AS partial_step_count, coalesce(ranks[1], '') AS rank1, coalesce(ranks[2], '') AS rank2,
  coalesce(ranks[3], '') AS rank3, coalesce(ranks[4], '') AS rank4, coalesce(ranks[5], '') AS rank5,
  CAST(m AS INT) AS predicted_step_count FROM x JOIN p ON p.user_id = x.user_id AND p.fraction = x.fraction
  JOIN y USING (example_id) WHERE segment = 0)"""
SORTABLE = ["example_id", "family", "completion_fraction", "partial_step_count", "predicted_step_count"]


@query("three_way_result_join", f"WITH {RESULTS} SELECT * FROM res")
def three_way_result_join(spark, sf):
    return results(spark, sf)


@query("paged_results", f"""WITH {RESULTS} SELECT *, CAST((SELECT count(*) FROM res WHERE family = 'IGBT') AS BIGINT) AS total
FROM res WHERE family = 'IGBT' ORDER BY partial_step_count DESC, example_id LIMIT 20 OFFSET 20""")
def paged_results(spark, sf):
    # written once: the page and the total both read it, as further pages would
    rows = cut_lineage(serving.choose(results(spark, sf), family="IGBT"))
    return serving.page(rows, SORTABLE, "partial_step_count", True, 2, 20, "example_id", "completion_fraction")


@query("detail_lookup", f"WITH {RESULTS} SELECT * FROM res WHERE example_id = 'IGBT_seq_7_0_60'")
def detail_lookup(spark, sf):
    return serving.detail(results(spark, sf), "example_id", "IGBT_seq_7_0_60")


@query("risk_span", f"""WITH {JOURNEYS} SELECT user_id, CAST(min(step_index) AS BIGINT) AS first_risky,
  CAST(max(step_index) AS BIGINT) AS last_risky, CAST(count(*) AS BIGINT) AS n_risky FROM j
WHERE least(value / 199.7::DOUBLE, 1.0::DOUBLE) >= 0.70 GROUP BY 1""")
def risk_span(spark, sf):
    rows = running_state(journeys(spark, sf), ["user_id"], ORDER).withColumn(
        "risk", F.least(F.col("value") / 199.7, F.lit(1.0)))
    return serving.risk_spans(rows, ["user_id"], "risk", "step_index")


@query("risk_bands", """WITH r AS (SELECT event_id, least(value / 199.7::DOUBLE, 1.0::DOUBLE) AS risk FROM events)
SELECT event_id, round(risk, 4) AS risk_score, round(greatest(0, risk - 0.08::DOUBLE), 4) AS confidence_lo,
  round(least(1, risk + 0.08::DOUBLE), 4) AS confidence_hi,
  CASE WHEN risk >= 0.85 THEN 'high' WHEN risk >= 0.70 THEN 'raised' ELSE 'normal' END AS level FROM r""")
def risk_bands(spark, sf):
    risk = F.least(F.col("value") / 199.7, F.lit(1.0))
    return table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in serving.risk_band(risk).items()], serving.risk_level(risk).alias("level"))


@query("top_contributions", """WITH r AS (SELECT user_id, event_id, round(value - 50, 6) AS contribution, row_number() OVER (
  PARTITION BY user_id ORDER BY abs(value - 50) DESC, event_id) AS place FROM events)
SELECT user_id, event_id, contribution, CAST(place AS INT) AS place FROM r WHERE place <= 10""")
def top_contributions(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") - 50).alias("contribution"))
    return serving.top_contributions(rows, ["user_id"], "contribution", "event_id").withColumn(
        "contribution", F.round("contribution", 6))


@query("distinct_values", """SELECT DISTINCT event_type AS kind, CAST(event_id % 2 AS BIGINT) AS part FROM events""")
def distinct_values(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("event_id") % 2).alias("part")).distinct()


@query("vocabulary_sets", """WITH a AS (SELECT DISTINCT o_orderpriority AS step FROM orders WHERE o_orderstatus = 'F'
  UNION SELECT DISTINCT event_type FROM events),
b AS (SELECT DISTINCT event_type AS step FROM events WHERE value > 300)
SELECT step, CAST(step IN (SELECT step FROM b) AS INT) AS in_both FROM a""")
def vocabulary_sets(spark, sf):
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")
    a = (orders.filter("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("step"))
         .union(events.select("event_type")).distinct())
    b = events.filter("value > 300").select(F.col("event_type").alias("step")).distinct()
    both = a.intersect(b).withColumn("in_both", F.lit(1))
    return both.unionByName(a.join(b, "step", "left_anti").withColumn("in_both", F.lit(0)))
