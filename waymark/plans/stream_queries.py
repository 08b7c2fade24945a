"""The events table read as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import mining as M
from waymark.plans.inputs import GRADED, JOURNEY_BOOK, JOURNEYS, journeys
from waymark.plans.registry import query
from waymark.plans.rule_queries import JOURNEY_RULES
from waymark.plans.score_queries import NGRAMS, journey_ngrams
from waymark.session import shared_folder
from waymark.sources.readers import read_event_stream
from waymark.streaming.monitor import live_contexts, live_next_steps, run_available, run_monitor


def event_stream(spark, sf):
    """The events table as a stream, be it one file or a folder of part files."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    if all(f.endswith("/events.parquet") for f in events.inputFiles()):
        return read_event_stream(spark, sf, events.schema, "events.parquet")
    return read_event_stream(spark, f"{sf}/events.parquet", events.schema)


@query("stream_rule_monitor", f"WITH {JOURNEY_RULES} SELECT user_id, rule, step_index, step FROM v")
def stream_rule_monitor(spark, sf):
    step = F.concat_ws(" ", "event_type", F.floor(F.col("value") / 50).cast("bigint").cast("string"))
    stream = event_stream(spark, sf).select("user_id", "ts", "event_id", step.alias("step"))
    found, _ = run_monitor(stream, "monitor", JOURNEY_BOOK, "user_id", "ts", "event_id", cell="100 days")
    return found.select("user_id", "rule", "step_index", "step")


# Rows of a part of a delayed file, at least.
PART_ROWS = 500_000

# -- steps out of order ---------------------------------------------------------------------------

# the file in which an event comes: eight days each, every tenth event one file later
_FILE = "least(3, day(ts) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END)"
_LATE = f"""filed AS (SELECT *, {_FILE} AS file FROM events), m AS (SELECT file, max(ts) AS newest FROM filed GROUP BY 1),
late AS (SELECT * FROM filed WHERE ts < (SELECT date_trunc('milliseconds', max(newest)) FROM m WHERE m.file < filed.file) - INTERVAL 2 DAY)"""


def delayed_files(spark, sf):
    """The graded journeys in four files, one after the other, as a stream of one file at a time.

    Large files are written in parts, as many in each file, none of them empty.
    """
    folder, rows = shared_folder(spark, "delayed"), journeys(spark, sf, graded=True)
    number = F.least(F.lit(3), F.floor(F.dayofmonth("ts") / 8) + (F.col("event_id") % 10 == 0).cast("int"))
    counts = [r["n"] for r in rows.groupBy(number.alias("file")).agg(F.count(F.lit(1)).alias("n")).filter("file IN (0, 1, 2, 3)").collect()]
    parts = max(1, min(counts) // PART_ROWS) if len(counts) == 4 else 1
    for file in range(4):
        rows.filter(number == file).repartition(parts).write.mode("append").parquet(folder)
    return read_event_stream(spark, folder, rows.schema, files_per_trigger=parts)


@query("stream_late_steps", f"""WITH {_LATE} SELECT user_id, event_id,
  event_type || ' ' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS step FROM late""")
def stream_late_steps(spark, sf):
    """Steps older than the watermark, two days behind the newest one of the files before."""
    _, late = run_monitor(delayed_files(spark, sf), "late", JOURNEY_BOOK, "user_id", "ts", "event_id", delay="2 days", cell="4 days")
    return late.select("user_id", F.col("tie").alias("event_id"), "step")


@query("stream_in_order", f"""WITH {_LATE}, kept AS (SELECT * FROM events WHERE event_id NOT IN (SELECT event_id FROM late)),
{JOURNEY_RULES.replace('FROM events', 'FROM kept')} SELECT user_id, rule, step_index, step FROM v""")
def stream_in_order(spark, sf):
    """The violations of all other steps, as if they had come in order."""
    found, _ = run_monitor(delayed_files(spark, sf), "ordered", JOURNEY_BOOK, "user_id", "ts", "event_id", delay="2 days", cell="4 days")
    return found.select("user_id", "rule", "step_index", "step")


_VISITS = JOURNEY_RULES[len(GRADED) + 2:].replace("FROM j)", "FROM visits)")


@query("stream_visits", f"""WITH {GRADED}, ends AS (SELECT *, coalesce(sum(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
    ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS visit FROM j),
visits AS (SELECT * REPLACE (user_id * 100000 + visit AS user_id,
  row_number() OVER (PARTITION BY user_id, visit ORDER BY ts, event_id) - 1 AS step_index) FROM ends), {_VISITS}
SELECT CAST(user_id // 100000 AS BIGINT) AS user_id, rule, step_index, step FROM v""")
def stream_visits(spark, sf):
    """A purchase ends the sequence of a user; the next step begins another one."""
    step = F.concat_ws(" ", "event_type", F.floor(F.col("value") / 50).cast("bigint").cast("string"))
    stream = event_stream(spark, sf).select("user_id", "ts", "event_id", step.alias("step"))
    found, _ = run_monitor(stream, "visits", JOURNEY_BOOK, "user_id", "ts", "event_id", cell="100 days", terminal="PURCHASE")
    return found.select("user_id", "rule", "step_index", "step")


@query("stream_next_steps", f"""WITH {JOURNEYS}, {NGRAMS},
t AS (SELECT len, context, list(next ORDER BY rank) AS ranks FROM r WHERE rank <= 3 GROUP BY 1, 2),
e AS (SELECT user_id, step AS lag1, lag1 AS lag2, row_number() OVER (PARTITION BY user_id ORDER BY step_index DESC) AS k FROM l)
SELECT user_id, array_to_string(coalesce(a.ranks, b.ranks), '|') AS next_steps FROM e
LEFT JOIN t a ON a.len = 2 AND a.context = lag2 || '|' || lag1 LEFT JOIN t b ON b.len = 1 AND b.context = lag1
WHERE k = 1""")
def stream_next_steps(spark, sf):
    """Candidates after the latest steps of each user, from the stream and the mined n-grams."""
    stream = event_stream(spark, sf).select("user_id", "ts", "event_id", F.col("event_type").alias("step"))
    lists = M.candidate_lists(journey_ngrams(spark, sf), 3)
    out = live_next_steps(live_contexts(stream, "user_id", "ts", "event_id"), lists)
    named = out.select("user_id", "seen", F.array_join(F.transform("candidates", lambda c: c["next"]), "|").alias("next_steps"))
    return run_available(named, "next_steps").groupBy("user_id").agg(F.max_by("next_steps", "seen").alias("next_steps"))
