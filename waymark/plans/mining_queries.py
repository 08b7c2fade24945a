"""Grammar, vocabulary, encoding, buckets, splits, likelihood."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Window, functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.functions.scorers import score_prefixes
from waymark.operators import mining as M
from waymark.operators.ordered import running_state, segments
from waymark.plans.inputs import (JOURNEYS, MAX_LEN, ORDER, ROUTES, SEGMENTS, journey_segments, journeys, names, routes,
                                  table)
from waymark.plans.registry import query
from waymark.plans.score_queries import LAGGED, NGRAMS, lagged_journeys, journey_ngrams, rounded
from waymark.plans.sql_text import category_case
from waymark.rulesets import fabrication as fab
from waymark.session import cut_lineage, small


@query("category_grammar", f"""WITH {ROUTES}, {LAGGED} SELECT DISTINCT {category_case('lag1')} AS from_kind,
  {category_case('step')} AS to_kind FROM l WHERE lag1 IS NOT NULL""")
def category_grammar(spark, sf):
    """Categories seen next to each other; step pairs are made distinct before they are classified."""
    lagged = M.with_lags(routes(spark, sf), ["user_id"], ORDER, n=2)
    pairs = M.transitions(lagged)
    return pairs.select(S.category(F.col("from_kind")).alias("from_kind"),
                        S.category(F.col("to_kind")).alias("to_kind")).distinct()


@query("step_canonical", f"""WITH {ROUTES} SELECT upper(trim(regexp_replace(step, '\\s+', ' ', 'g'))) AS canonical,
  replace(trim(step), ' ', '_') AS token, split_part(trim(step), ' ', 1) AS block, CAST(count(*) AS BIGINT) AS n
FROM j GROUP BY 1, 2, 3""")
def step_canonical(spark, sf):
    s = F.col("step")
    return (routes(spark, sf).groupBy(s).agg(F.count(F.lit(1)).alias("n"))
            .select(S.canonical(s).alias("canonical"), S.to_token(s).alias("token"),
                    S.first_word(s).alias("block"), "n"))


_SYN = "CASE " + " ".join(f"WHEN step = '{k}' THEN '{v}'" for k, v in fab.SYNONYMS.items()) + " ELSE step END"


@query("synonym_map", f"WITH {ROUTES} SELECT {_SYN} AS step, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1")
def synonym_map(spark, sf):
    return (routes(spark, sf).groupBy(S.canonical_synonym(F.col("step")).alias("step"))
            .agg(F.count(F.lit(1)).alias("n")))


def _flag_sql(flag: str) -> str:
    base = f"category IN ({names([c for c, v in fab.CATEGORY_FLAGS.items() if flag in v] or ['-'])})"
    litho = ("(category = 'LITHO' AND NOT contains(up, 'SPIN COAT') AND NOT contains(up, 'COAT PHOTORESIST'))")
    expose = f"({litho} AND contains(up, 'EXPOSE'))"
    develop = f"({litho} AND NOT contains(up, 'EXPOSE') AND contains(up, 'DEVELOP'))"
    bake = f"({litho} AND NOT contains(up, 'EXPOSE') AND NOT contains(up, 'DEVELOP') AND contains(up, 'BAKE'))"
    return {
        "coats_resist": "category = 'LITHO' AND (contains(up, 'SPIN COAT') OR contains(up, 'COAT PHOTORESIST'))",
        "needs_resist_present": f"{expose} OR {bake}", "exposes_resist": expose,
        "advances_litho_level": f"{expose} AND (contains(up, 'ALIGN MASK LEVEL') OR contains(up, 'EXPOSE LITHO LEVEL'))",
        "needs_resist_exposed": develop, "develops_resist": develop, "opens_implant_window": f"{base} OR {develop}",
        "marks_passivation_exist": "category = 'DEPOSIT' AND contains(up, 'PASSIVATION')",
        "needs_passivation_cured": f"{base} OR (category = 'DEPOSIT' AND contains(up, 'BACKSIDE METAL'))",
        "needs_passivation_exist": "up = 'CURE PASSIVATION'", "marks_passivation_cured": "up = 'CURE PASSIVATION'",
        "activates_dopants": f"{base} AND up <> 'CURE PASSIVATION'",
        "marks_sort_done": "contains(up, 'WAFER SORT TEST')", "needs_sort_done": "contains(up, 'SHIP LOT')",
        "is_logistics_only": f"{base} OR contains(up, 'SHIP LOT')",
        "makes_surface_dirty": f"{base} AND up <> 'THERMAL OXIDATION'",
        "makes_surface_clean": f"{base} OR up = 'THERMAL OXIDATION'",
    }.get(flag, base)


@query("feature_flags", f"""WITH {ROUTES}, d AS (SELECT DISTINCT step, upper(step) AS up, {category_case('step')} AS category
  FROM j) SELECT step, {', '.join(f'CAST(({_flag_sql(f)}) AS INT) AS {f}' for f in fab.FLAGS)} FROM d""")
def feature_flags(spark, sf):
    distinct = routes(spark, sf).select("step").distinct().withColumn("category", S.category(F.col("step")))
    flags = S.feature_flags(F.col("step"), F.col("category"))
    return distinct.select("step", *[c.cast("int").alias(n) for n, c in flags.items()])


# -- vocabulary and encoding ----------------------------------------------------------------

_SPECIAL = " UNION ALL ".join(f"SELECT '{t}' AS token, {i} AS id" for i, t in enumerate(fab.SPECIAL_TOKENS))
VOCAB = f"""vs AS (SELECT DISTINCT replace(trim(step), ' ', '_') AS token FROM j),
voc AS ({_SPECIAL} UNION ALL SELECT token, {len(fab.SPECIAL_TOKENS)} + row_number() OVER (ORDER BY token) - 1 FROM vs)"""


@query("vocabulary_ids", f"WITH {ROUTES}, {VOCAB} SELECT token, CAST(id AS BIGINT) AS id FROM voc")
def vocabulary_ids(spark, sf):
    return M.vocabulary(routes(spark, sf))


def encoded(spark, sf, limit=MAX_LEN + 3):
    """[BOS] [FAM] steps [EOS] as ids per segment; ids come from a join on the rows."""
    rows = running_state(routes(spark, sf), ["user_id", "family"], ORDER)
    vocab = M.vocabulary(routes(spark, sf)).select("token", F.col("id").cast("int").alias("id"))
    coded = rows.withColumn("token", S.to_token(F.col("step"))).join(small(vocab), "token", "left")
    parts = segments(coded, ["user_id", "family"], {"id": F.coalesce("id", F.lit(1))}, steps="ids", max_len=MAX_LEN)
    family = F.element_at(F.array(*[F.lit(7 + i) for i in range(3)]),
                          (F.col("user_id") % 3 + 1).cast("int"))
    ids = F.concat(F.array(F.lit(2), family), F.col("ids"), F.array(F.lit(3)))
    return parts.withColumn("ids", F.slice(ids, 1, limit))


ENCODED = f"""{VOCAB}, ej AS (SELECT j.*, voc.id FROM j JOIN voc ON voc.token = replace(trim(step), ' ', '_')),
es AS (SELECT user_id, family, CAST(step_index // {MAX_LEN} AS BIGINT) AS segment, list(id ORDER BY step_index) AS ids
  FROM ej GROUP BY 1, 2, 3),
enc AS (SELECT user_id, family, segment, list_concat([2, 7 + user_id % 3], ids, [3])[1:{MAX_LEN + 3}] AS ids FROM es)"""


@query("encoded_sequences", f"""WITH {ROUTES}, {ENCODED}
SELECT user_id, segment, array_to_string(ids, ' ') AS ids FROM enc""")
def encoded_sequences(spark, sf):
    return encoded(spark, sf).select("user_id", "segment",
                                     F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("padded_batches", f"""WITH {ROUTES}, {ENCODED}, b AS (SELECT *, user_id // 8 AS batch FROM enc),
m AS (SELECT batch, segment, max(len(ids)) AS width FROM b GROUP BY 1, 2)
SELECT user_id, segment, batch, CAST(width AS INT) AS width,
  array_to_string(list_concat(ids, list_transform(range(0, CAST(width - len(ids) AS BIGINT)), lambda i: 0)), ' ') AS input_ids,
  array_to_string(list_concat(ids, list_transform(range(0, CAST(width - len(ids) AS BIGINT)), lambda i: -100)), ' ') AS labels,
  CAST(len(ids) AS INT) AS attention FROM b JOIN m USING (batch, segment)""")
def padded_batches(spark, sf):
    """Batches of eight neighbouring users padded to the longest of each batch."""
    rows = encoded(spark, sf).withColumn("batch", F.floor(F.col("user_id") / 8).cast("bigint"))
    width = F.max(F.size("ids")).over(Window.partitionBy("batch", "segment"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), " ")
    rows = rows.withColumn("width", width)
    mask = A.mask_of(F.col("ids"), F.col("width"))
    return rows.select("user_id", "segment", "batch", "width",
                       text(A.pad(F.col("ids"), F.col("width"), F.lit(0))).alias("input_ids"),
                       text(A.pad(F.col("ids"), F.col("width"), F.lit(-100))).alias("labels"),
                       F.aggregate(mask, F.lit(0), lambda a, b: a + b).alias("attention"))


@query("decoded_sequences", f"""WITH {ROUTES}, {ENCODED}, n AS (SELECT user_id, segment, ids FROM enc),
u AS (SELECT user_id, segment, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM n)
SELECT user_id, segment, string_agg(replace(token, '_', ' '), '|' ORDER BY i) AS steps
FROM u JOIN voc USING (id) WHERE id >= {len(fab.SPECIAL_TOKENS)} GROUP BY 1, 2""")
def decoded_sequences(spark, sf):
    """Ids back to steps, without the special tokens."""
    rows = encoded(spark, sf).select("user_id", "segment", F.posexplode("ids").alias("i", "id"))
    vocab = M.vocabulary(routes(spark, sf)).select(F.col("id").cast("int").alias("id"), "token")
    named = (rows.filter(F.col("id") >= len(fab.SPECIAL_TOKENS)).join(vocab, "id")
             .groupBy("user_id", "segment")  # at most MAX_LEN + 3 rows per group
             .agg(F.array_sort(F.collect_list(F.struct("i", S.from_token(F.col("token")).alias("s")))).alias("x")))
    return named.select("user_id", "segment", F.array_join(F.transform("x", lambda x: x["s"]), "|").alias("steps"))


@query("multi_hot_rules", """SELECT event_id, CASE WHEN event_type = 'error' THEN '1.0 0.0 0.0'
  WHEN event_type = 'click' THEN '0.0 1.0 0.0' WHEN event_type = 'view' THEN '0.0 0.0 1.0' ELSE '0.0 0.0 0.0' END AS rules
FROM events""")
def multi_hot_rules(spark, sf):
    vector = A.multi_hot(["error", "click", "view"], F.col("event_type"))
    return table(spark, sf, "events").select("event_id", F.array_join(vector.cast("array<string>"), " ").alias("rules"))


@query("content_keys", """SELECT event_id, md5('{"event_id":' || event_id || ',"step":"' || event_type || '"}') AS key
FROM events""")
def content_keys(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", A.content_key(step=F.col("event_type"), event_id=F.col("event_id")).alias("key"))


# -- weights, splits, quantiles ------------------------------------------------------------------

@query("distinct_sequences", f"""WITH j AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
  AS i FROM conversations),
s AS (SELECT conv_id, i // {MAX_LEN} AS segment, string_agg(role, '|' ORDER BY i) AS steps FROM j GROUP BY 1, 2)
SELECT CAST(min(conv_id) AS BIGINT) AS conv_id, steps, CAST(count(*) AS BIGINT) AS copies FROM s GROUP BY steps""")
def distinct_sequences(spark, sf):
    rows = running_state(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    arrays = segments(rows, ["conv_id"], {"role": F.col("role")}).withColumn("ord", F.struct("conv_id", "segment"))
    return M.distinct_sequences(arrays, "steps", "ord").select(
        "conv_id", F.array_join("steps", "|").alias("steps"), "copies")


LENGTHS = "n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


def lengths(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("length_bucket_weights", f"""WITH {LENGTHS}, b AS (SELECT *, least(7, (n - (SELECT min(n) FROM n)) * 8 //
  greatest(1, (SELECT max(n) - min(n) FROM n))) AS bucket FROM n),
c AS (SELECT bucket, count(*) AS in_bucket FROM b GROUP BY 1)
SELECT user_id, CAST(bucket AS BIGINT) AS bucket, round(1.0::DOUBLE / (in_bucket * (SELECT count(*) FROM c)), 9) AS weight
FROM b JOIN c USING (bucket)""")
def length_bucket_weights(spark, sf):
    return M.bucket_weights(lengths(spark, sf), "n").select("user_id", "bucket", F.round("weight", 9).alias("weight"))


@query("split_parts", """WITH h AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n
  FROM orders)
SELECT o_orderkey, CASE WHEN k < round_even(n * 0.1::DOUBLE, 0) THEN 'test'
  WHEN k < round_even(n * 0.1::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS part FROM h""")
def split_parts(spark, sf):
    """Exact train, val and test shares per group in the order of a hash."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority",
                                             F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    return M.split(rows, "o_orderpriority", ["h", "o_orderkey"]).select("o_orderkey", "part")


@query("quantile_threshold", """WITH s AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i,
  count(*) OVER () AS n FROM orders)
SELECT o_totalprice AS threshold FROM s WHERE i = least(n - 1, CAST(floor(0.95::DOUBLE * n) AS BIGINT))""")
def quantile_threshold(spark, sf):
    return M.order_statistic(table(spark, sf, "orders"), "o_totalprice", 0.95)


NLL = f"""{NGRAMS}, tot AS (SELECT context, sum(cnt) AS total FROM g WHERE len = 1 GROUP BY 1),
sc AS (SELECT user_id, -ln((coalesce(cnt, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + (SELECT count(*) FROM g WHERE len = 0)))
  AS nlp FROM l LEFT JOIN (SELECT * FROM g WHERE len = 1) g ON g.context = lag1 AND g.next = l.step
  LEFT JOIN tot ON tot.context = lag1 WHERE lag1 IS NOT NULL),
nll AS (SELECT user_id, avg(nlp) AS nll FROM sc GROUP BY 1)"""


@query("sequence_nll", f"WITH {JOURNEYS}, {NLL} SELECT user_id, round(nll, 6) AS nll FROM nll")
def sequence_nll(spark, sf):
    return rounded(M.sequence_nll(lagged_journeys(spark, sf), journey_ngrams(spark, sf), ["user_id"]), ["nll"])


@query("nll_verdicts", f"""WITH {JOURNEYS}, {NLL}, o AS (SELECT *, row_number() OVER (ORDER BY nll) - 1 AS i,
  count(*) OVER () AS n FROM nll),
th AS (SELECT nll AS t FROM o WHERE i = least(n - 1, CAST(floor(0.9::DOUBLE * n) AS BIGINT)))
SELECT user_id, CAST(nll <= t AS INT) AS is_valid, round(1 / (1 + exp(nll - t)), 6) AS p_valid FROM nll, th""")
def nll_verdicts(spark, sf):
    scored = M.sequence_nll(lagged_journeys(spark, sf), journey_ngrams(spark, sf), ["user_id"])
    scored = cut_lineage(scored.withColumn("nll", F.round("nll", 12)))  # for the threshold and for the rows
    limit = M.order_statistic(scored, "nll", 0.9).scalar()
    return scored.select("user_id", (F.col("nll") <= limit).cast("int").alias("is_valid"),
                         F.round(M.p_valid(F.col("nll"), limit), 6).alias("p_valid"))


@query("weighted_draws", f"""WITH {LENGTHS}, b AS (SELECT *, least(7, (n - (SELECT min(n) FROM n)) * 8 //
  greatest(1, (SELECT max(n) - min(n) FROM n))) AS bucket FROM n),
c AS (SELECT bucket, count(*) AS in_bucket FROM b GROUP BY 1),
w AS (SELECT user_id, 1.0::DOUBLE / (in_bucket * (SELECT count(*) FROM c)) AS w FROM b JOIN c USING (bucket)),
line AS (SELECT user_id, coalesce(sum(w) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
d AS (SELECT draw, CAST('0x' || substr(md5('7|' || draw), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (SELECT sum(w) FROM w) AS place
  FROM (SELECT unnest(range((SELECT count(*) FROM w))) AS draw))
SELECT draw, arg_max(user_id, start) AS user_id FROM d JOIN line ON start <= place GROUP BY 1""")
def weighted_draws(spark, sf):
    """As many draws with replacement as there are journeys, by length-bucket weight."""
    weights = M.bucket_weights(lengths(spark, sf), "n")
    return M.weighted_sample(weights, "user_id", "weight", weights.count(), seed=7)


@query("strided_sample", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i FROM r WHERE i % greatest(1, n // 64) = 0 AND i < 64 * greatest(1, n // 64)""")
def strided_sample(spark, sf):
    """64 orders at equal distances."""
    rows = table(spark, sf, "orders").select(F.lit(0).alias("g"), "o_orderkey")
    return M.strided(rows, ["g"], ["o_orderkey"], 64).select("o_orderkey", "i")


# -- custom scorers and small list functions -------------------------------------------------------------

def frequent_so_far(prefixes):
    """A scorer that rates a step by how often the prefix has it; a map, in order of first occurrence."""
    return [dict(Counter(steps)) for steps in prefixes]


@query("scored_candidates", f"""WITH {JOURNEYS}, {SEGMENTS},
e AS (SELECT user_id, i, steps[i] AS step FROM (SELECT user_id, steps, unnest(range(1, CAST(len(steps) AS BIGINT) + 1)) AS i FROM s)),
c AS (SELECT user_id, step, count(*) AS n, min(i) AS first FROM e WHERE step <> 'error' GROUP BY 1, 2)
SELECT user_id, string_agg(step || ' ' || n, '|' ORDER BY n DESC, first) AS ranked FROM c GROUP BY 1""")
def scored_candidates(spark, sf):
    """Candidates of a scorer that gives score maps, best first, without a name that mustn't rank."""
    rows = score_prefixes(journey_segments(spark, sf), "steps", frequent_so_far, drop=("error",))
    named = F.transform("candidates", lambda c: F.concat_ws(" ", c["next"], c["p"].cast("int").cast("string")))
    return rows.select("user_id", F.array_join(named, "|").alias("ranked"))


@query("cycling_journeys", f"""WITH {JOURNEYS}, t AS (SELECT user_id, step_index, list(step) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS l FROM j)
SELECT user_id, CAST(step_index AS INT) AS pos FROM t WHERE len(l) = 8 AND (
  {' OR '.join('(' + ' AND '.join(f'l[{i + 1}] = l[{i % p + 1}]' for i in range(p, 8)) + ')' for p in (1, 2, 3, 4))})""")
def cycling_journeys(spark, sf):
    """Positions at which the last eight steps repeat with period 1 to 4."""
    heads = journey_segments(spark, sf).select("user_id", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("n"))
    return heads.filter(A.is_cycling(A.head(F.col("steps"), F.col("n")))).select("user_id", (F.col("n") - 1).alias("pos"))


@query("merged_rankings", f"""WITH {JOURNEYS}, {SEGMENTS},
m AS (SELECT user_id, list_concat(steps[1:3], list_concat(list_reverse(steps[len(steps) - 2:]), ['view', 'click', 'signup'])) AS l FROM s),
e AS (SELECT user_id, l[i] AS step, min(i) AS first FROM (SELECT user_id, l, unnest(range(1, CAST(len(l) AS BIGINT) + 1)) AS i FROM m) GROUP BY 1, 2)
SELECT user_id, string_agg(step, '|' ORDER BY first) AS ranks FROM e GROUP BY 1""")
def merged_rankings(spark, sf):
    """Several lists as one, each step where it first occurs."""
    default = F.array(*map(F.lit, ("view", "click", "signup")))
    ranks = A.merged(F.slice("steps", 1, 3), F.reverse(A.tail(F.col("steps"), 3)), default)
    return journey_segments(spark, sf).select("user_id", F.array_join(ranks, "|").alias("ranks"))


@query("other_categories", f"""WITH {JOURNEYS} SELECT step, CASE WHEN step IN ('purchase') THEN 'SALE' WHEN starts_with(upper(step), 'SIGN') THEN 'ACCOUNT'
  WHEN contains(upper(step), 'I') THEN 'BROWSE' ELSE 'UNKNOWN' END AS category, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY 1, 2""")
def other_categories(spark, sf):
    """Categories of another domain: names, then prefixes, then words."""
    kind = S.category(F.col("step"), {"SALE": ["purchase"]}, [("SIGN", "ACCOUNT")], [("I", "BROWSE")])
    return journeys(spark, sf).groupBy("step", kind.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("scaling_curve", """SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS INT) AS x,
  round(avg(o_totalprice), 2) AS y FROM orders GROUP BY 1, 2""")
def scaling_curve(spark, sf):
    from waymark.operators.evaluate import curve
    points = table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("x")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("y"))
    return curve(points, "series", "x", "y")
