"""Tables written in the file formats and read back: every reader and writer over the supplied rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.operators import semantics as D
from waymark.plans.inputs import FAMILIES, JOURNEYS, SEGMENTS, journey_segments, table
from waymark.plans.registry import query
from waymark.plans.score_queries import EXAMPLES, FAMILY_SQL, examples, family_column
from waymark.plans.text_queries import batch_documents, description_rows
from waymark.session import shared_folder
from waymark.sources import readers as R, writers as W


def csv(df: DataFrame, path: str) -> str:
    df.write.csv(path, header=True, escape='"', emptyValue="")
    return path


# -- step tables ----------------------------------------------------------------------------

@query("long_csv_round_trip", f"""WITH {JOURNEYS}, {SEGMENTS},
f AS (SELECT *, {FAMILY_SQL} AS family FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY user_id) AS n FROM f)
SELECT family, format('seq_{{:04d}}', n) AS sequence_id, CAST(i - 1 AS BIGINT) AS step_index, steps[i] AS step
FROM (SELECT *, unnest(range(1, CAST(len(steps) AS BIGINT) + 1)) AS i FROM n)""")
def long_csv_round_trip(spark, sf):
    """A long step table for each family, written and read as one; a file that isn't there is passed over."""
    base = shared_folder(spark, "steps")
    rows = journey_segments(spark, sf).withColumn("family", family_column())
    for family in FAMILIES:
        W.write_steps(rows.filter(F.col("family") == family), f"{base}/{family}", "user_id")
    back = R.read_existing_steps(spark, [f"{base}/NONE", *[f"{base}/{f}" for f in FAMILIES]])
    family = F.regexp_extract("source_file", "/([A-Z]+)/[^/]*$", 1)
    return back.select(family.alias("family"), "sequence_id", "step_index", "step")


@query("upload_layouts", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}, u AS (SELECT min(user_id) AS first FROM events)
SELECT 'pipe' AS layout, example_id, fam AS family, array_to_string(part, '|') AS steps FROM x
UNION ALL SELECT 'long', format('seq_{{:04d}}', row_number() OVER (ORDER BY user_id)), 'MOSFET', array_to_string(steps, '|') FROM s
UNION ALL SELECT 'single', 'sequence_1', 'MOSFET', array_to_string(steps, '|') FROM s, u WHERE user_id = first""")
def upload_layouts(spark, sf):
    """The three layouts in which sequences are handed in, told apart by their columns."""
    base, arrays = shared_folder(spark, "uploads"), journey_segments(spark, sf)
    rows = examples(arrays)
    csv(rows.select(F.col("example_id").alias("EXAMPLE_ID"), F.col("family").alias("FAMILY"),
                    F.concat(F.lit(" "), F.array_join("partial", " | ")).alias("PARTIAL_SEQUENCE")), f"{base}/pipe")
    W.write_steps(arrays, f"{base}/long", "user_id")
    first = arrays.filter(F.col("user_id") == table(spark, sf, "events").agg(F.min("user_id")).scalar())
    csv(first.select(F.posexplode("steps").alias("i", "STEP")).coalesce(1).sortWithinPartitions("i").select("STEP"), f"{base}/single")
    out = None
    for layout in ("pipe", "long", "single"):
        part = R.read_upload(spark, f"{base}/{layout}").select(
            F.lit(layout).alias("layout"), "example_id", "family", F.array_join("steps", "|").alias("steps"))
        out = part if out is None else out.unionByName(part)
    return out


# -- other tables -----------------------------------------------------------------------------

@query("padded_csv", "SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment FROM customer")
def padded_csv(spark, sf):
    """Cells and headers with blanks, quotes and a hyphen of another kind come back clean."""
    padded = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" key "), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias('"name"'),
        F.concat(F.lit('"'), "c_mktsegment", F.lit('"')).alias("mkt\u2011segment"))
    back = R.read_table(spark, csv(padded, shared_folder(spark, "padded")))
    return back.select("key", "name", F.col("`mkt-segment`").alias("segment"))


@query("description_files", """SELECT 'F' || (p_size % 3) AS family, p_type AS step, p_name AS description,
  CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS parameters, CAST(p_size % 3 AS INT) AS file FROM part""")
def description_files(spark, sf):
    """A file of descriptions for each family, with the columns found by their prefix."""
    base, rows = shared_folder(spark, "descriptions"), description_rows(spark, sf)
    for family in ("F0", "F1", "F2"):
        csv(rows.filter(F.col("family") == family).select(
            F.col("step").alias("STEP"), F.col("description").alias("DESCRIPTION"),
            F.col("parameters").alias("REALISTIC FAB\u2011LEVEL PARAMETERS")), f"{base}/{family}")
    back = R.read_descriptions(spark, [(f, f"{base}/{f}") for f in ("F0", "F1", "F2", "F3")])
    return back.select("family", "step", "description", "parameters", F.col("ord.file").alias("file"))


@query("description_look_up", """WITH t AS (SELECT n_name AS step, 'nation ' || n_nationkey AS d FROM nation
  UNION ALL SELECT lower(r_name), 'region ' || r_regionkey FROM region),
w AS (SELECT lower(n_name) AS step FROM nation UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT r_name FROM region)
SELECT w.step, coalesce(a.d, b.d) AS description FROM w LEFT JOIN t a ON a.step = upper(w.step) LEFT JOIN t b ON b.step = w.step""")
def description_look_up(spark, sf):
    """Texts recorded for the upper-case name, else for the name as it is."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    texts = nation.select(F.col("n_name").alias("step"), F.concat(F.lit("nation "), "n_nationkey").alias("description")).unionByName(
        region.select(F.lower("r_name").alias("step"), F.concat(F.lit("region "), "r_regionkey").alias("description")))
    wanted = nation.select(F.lower("n_name").alias("step")).unionByName(region.select(F.lower("r_name").alias("step"))).unionByName(
        region.select(F.col("r_name").alias("step")))
    return D.look_up(wanted, texts)


@query("batch_files", """SELECT 'b' || event_id AS batch_id, event_type AS step_name,
  round(least(value / 199.7::DOUBLE, 1.0::DOUBLE), 6) AS risk_score, 2 AS n_steps, 2 AS n_shap FROM events""")
def batch_files(spark, sf):
    """Nested documents as JSON files of one array each, read with their schema."""
    path = shared_folder(spark, "batches")
    part = F.floor(F.substring("batch_id", 2, 20).cast("bigint") / 5000)  # documents of one file
    documents = batch_documents(spark, sf).withColumn("part", part)
    document = F.struct("batch_id", "predicted_yield", "per_step")
    documents.groupBy("part").agg(F.to_json(F.collect_list(document)).alias("value")).write.partitionBy("part").text(path)
    first = F.get("per_step", F.lit(0))
    return R.read_batches(spark, f"{path}/*").select(
        "batch_id", first["step_name"].alias("step_name"), F.round(first["risk_score"], 6).alias("risk_score"),
        F.size("per_step").alias("n_steps"), F.size(first["shap"]).alias("n_shap"))


# -- metrics and logs ----------------------------------------------------------------------------

@query("metrics_files", """SELECT '{"n":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS task1_nextstep,
  '{"kinds":' || count(DISTINCT event_type) || '}' AS task2_completion, '{}' AS task3_encoder, 0.25::DOUBLE AS task2_logic_validity,
  '{"late":' || count(*) FILTER (hour(ts) >= 12) || '}' AS task1_hybrid, '{}' AS task3_hybrid FROM events""")
def metrics_files(spark, sf):
    """Metric documents written and read, absent parts with their defaults."""
    base, events = shared_folder(spark, "metrics"), table(spark, sf, "events")
    main = events.agg(F.struct(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).alias("task1_nextstep"),
                      F.struct(F.countDistinct("event_type").alias("kinds")).alias("task2_completion"), F.lit(0.25).alias("task2_logic_validity"))
    hybrid = events.agg(F.struct(F.count_if(F.hour("ts") >= 12).alias("late")).alias("task1_nextstep"))
    W.write_metrics(main.coalesce(1), f"{base}/main")
    W.write_metrics(hybrid.coalesce(1), f"{base}/hybrid")
    return R.read_metrics(spark, f"{base}/main", f"{base}/hybrid")


@query("experiment_log", """SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1
UNION ALL SELECT 'user ' || user_id, CAST(count(*) AS BIGINT), round(avg(value), 6) FROM events GROUP BY user_id""")
def experiment_log(spark, sf):
    """JSON lines added in two goes."""
    path, events = shared_folder(spark, "log"), table(spark, sf, "events")
    for kind in (F.col("event_type"), F.concat(F.lit("user "), "user_id")):
        W.append_log(events.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")), path)
    return R.read_log(spark, path, "kind string, n long, mean double")


# -- submissions -------------------------------------------------------------------------------------

def submitted(spark, df, name):
    W.write_submission(df, path := shared_folder(spark, name))
    return R.read_table(spark, path)


@query("next_step_file", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT example_id AS "EXAMPLE_ID", {', '.join(f"coalesce(suffix[{i}], '') AS " + chr(34) + f"RANK_{i}" + chr(34) for i in range(1, 6))} FROM x""")
def next_step_file(spark, sf):
    rows = examples(journey_segments(spark, sf)).withColumn("ranks", F.slice("suffix", 1, 7))
    return submitted(spark, W.next_step_submission(rows, "ranks"), "next")


@query("completion_file", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT example_id AS "EXAMPLE_ID", array_to_string(suffix, '|') AS "PREDICTED_SEQUENCE" FROM x""")
def completion_file(spark, sf):
    return submitted(spark, W.completion_submission(examples(journey_segments(spark, sf)), "suffix"), "completion")


_SCORED = "(CAST(floor(value * 1000) AS BIGINT) % 1000) / 1000.0::DOUBLE"


def scored_events(spark, sf):
    score = F.floor(F.col("value") * 1000).cast("bigint") % 1000 / 1000.0
    return table(spark, sf, "events").select(
        F.concat(F.lit("IC_"), "event_id").alias("example_id"), score.alias("score"), (score < 0.5).cast("int").alias("is_valid"),
        F.when(score >= 0.5, F.upper("event_type")).alias("rule"), F.col("user_id"))


@query("anomaly_file", f"""SELECT 'IC_' || event_id AS "EXAMPLE_ID", CAST(CAST({_SCORED} < 0.5 AS INT) AS VARCHAR) AS "IS_VALID",
  format('{{:.4f}}', {_SCORED}) AS "SCORE", CASE WHEN {_SCORED} >= 0.5 THEN upper(event_type) ELSE '' END AS "PREDICTED_RULE" FROM events""")
def anomaly_file(spark, sf):
    return submitted(spark, W.anomaly_submission(scored_events(spark, sf)), "anomaly")


@query("blind_files", f"""SELECT 'IC_' || event_id AS example_id, format('{{:.3f}}', {_SCORED})::DOUBLE AS score,
  CAST({_SCORED} < 0.5 AS INT) AS is_valid, 'example_id,score' AS input_columns, 'example_id,is_valid' AS label_columns FROM events""")
def blind_files(spark, sf):
    """Inputs without labels and labels without inputs, joined again by id."""
    base = shared_folder(spark, "blind")
    W.write_blind_split(scored_events(spark, sf), f"{base}/input", f"{base}/labels", ["score"], ["is_valid"])
    inputs, labels = (R.read_table(spark, f"{base}/{n}") for n in ("input", "labels"))
    return inputs.join(labels, "example_id").select(
        "example_id", F.col("score").cast("double").alias("score"), F.col("is_valid").cast("int").alias("is_valid"),
        F.lit(",".join(inputs.columns)).alias("input_columns"), F.lit(",".join(labels.columns)).alias("label_columns"))


@query("source_fallback", """SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 THEN 'main' ELSE 'other' END AS source FROM customer""")
def source_fallback(spark, sf):
    """The first file there is, and rows of a second source for keys that the first lacks."""
    base, keys = shared_folder(spark, "fallback"), table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    csv(keys.filter("key % 3 = 0").withColumn("source", F.lit("main")), f"{base}/main")
    csv(keys.withColumn("source", F.lit("other")), f"{base}/other")
    main = R.read_first(spark, f"{base}/newest", f"{base}/main", f"{base}/other")
    return R.prefer(main, R.read_first(spark, f"{base}/other"), "key")


@query("exported_results", f"""WITH e AS (SELECT 'IC_' || event_id AS id, {_SCORED} AS s, upper(event_type) AS r, event_id FROM events)
SELECT 'anomaly' AS task, id AS example_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(CAST(s < 0.5 AS INT) AS VARCHAR) END AS is_valid,
  CASE WHEN event_id % 4 <> 0 AND s >= 0.5 THEN r ELSE '' END AS detail FROM e
UNION ALL SELECT 'complete', id, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(s < 0.5 AS VARCHAR) END,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id % 3 AS VARCHAR) END FROM e""")
def exported_results(spark, sf):
    """Result tables over all inputs, blank where a task gave none."""
    events = scored_events(spark, sf).withColumn("number", F.substring("example_id", 4, 20).cast("bigint"))
    inputs = events.select("example_id", F.lit("IC").alias("family"))
    some = events.filter("number % 4 <> 0")
    anomaly = W.export(inputs, some.select("example_id", "is_valid", "score", F.col("rule").alias("predicted_rule")), "anomaly")
    steps = F.slice(F.array(F.lit("A"), F.lit("B")), 1, (F.col("number") % 3).cast("int"))
    complete = W.export(inputs, some.select("example_id", (F.col("is_valid") == 1).alias("is_valid"), steps.alias("completion")), "complete")
    return anomaly.select(F.lit("anomaly").alias("task"), F.col("EXAMPLE_ID").alias("example_id"), F.col("IS_VALID").alias("is_valid"), F.col("PREDICTED_RULE").alias("detail")).unionByName(
        complete.select(F.lit("complete").alias("task"), F.col("EXAMPLE_ID").alias("example_id"), F.col("IS_VALID").alias("is_valid"), F.col("PREDICTED_STEPS").alias("detail")))


@query("families_from_ids", f"""WITH {JOURNEYS}, {SEGMENTS}, {EXAMPLES}
SELECT lower(example_id) AS example_id, fam AS family FROM x""")
def families_from_ids(spark, sf):
    ids = examples(journey_segments(spark, sf)).select(F.lower("example_id").alias("example_id"))
    return ids.withColumn("family", S.family_of(F.col("example_id")))


@query("pipe_texts", f"""WITH {JOURNEYS}, {SEGMENTS}
SELECT user_id, array_to_string(steps, '|') AS text, CAST(len(steps) AS INT) AS n, steps[len(steps)] AS last FROM s""")
def pipe_texts(spark, sf):
    """Sequences as one text and back."""
    text = journey_segments(spark, sf).select("user_id", A.encode_pipe(F.col("steps")).alias("text"))
    steps = A.decode_pipe(F.col("text"))
    return text.select("user_id", "text", F.size(steps).alias("n"), F.element_at(steps, -1).alias("last"))
