"""The supplied tables read as ordered sequences, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.functions import steps
from waymark.operators.ordered import MAX_LEN, running_state, segments
from waymark.operators.rules import FirstOf, Level, Milestone, RuleBook, Windowed
from waymark.rulesets import fabrication as fab
from waymark.session import by_distinct

ORDER = ["ts", "event_id"]
FAMILIES = ["MOSFET", "IGBT", "IC"]

# Journeys graded by value: 'view 1', 'click 0', ...
JOURNEY_BOOK = RuleBook(
    events={"PURCHASE": ["purchase*"], "CLICK": ["click*"], "ERROR": ["error*"], "VIEW": ["view*"],
            "SIGNUP": ["signup*"]},
    rules=[
        Windowed("PURCHASE_NO_CLICK", "PURCHASE", [("CLICK", 3)], severity=3, reason="nothing was chosen"),
        Windowed("ERROR_NO_TRACE", "ERROR", [("VIEW", 4), ("CLICK", 4)], severity=2, reason="no cause seen"),
        Level("VIEW_LEVEL_SKIP", prefix="view ", pattern="^view ([0-9]+)$", severity=1, reason="a level is left out"),
        Milestone("PURCHASE_BEFORE_SIGNUP", "PURCHASE", ["SIGNUP", "VIEW"], severity=4, reason="unknown buyer"),
        FirstOf("FIRST_CLICK_BEFORE_VIEW", "CLICK", ["VIEW"], severity=1, reason="nothing to click on"),
    ])
JOURNEY_BOOK_BY_STEP = RuleBook(events=JOURNEY_BOOK.events, rules=JOURNEY_BOOK.rules, step_major=True)

# Names that routes over the events table are made of; the second list is for one
# family in three and has names outside the vocabulary.
ROUTE_STEPS = [
    "RECEIVE WAFER LOT", "RCA CLEAN 1", "HF DIP", "THERMAL OXIDATION", "SPIN COAT PHOTORESIST",
    "ALIGN MASK LEVEL 1", "EXPOSE LITHO LEVEL 1", "DEVELOP PHOTORESIST", "OXIDE ETCH", "STRIP RESIST",
    "CLEAN AFTER ETCH", "IMPLANT WELL", "RAPID THERMAL ANNEAL", "DEPOSIT POLYSILICON",
    "ALIGN MASK LEVEL 2", "EXPOSE LITHO LEVEL 2", "DEVELOP PHOTORESIST", "POLYSILICON ETCH DRY",
    "CLEAN AFTER POLY ETCH", "DEPOSIT INTERLEVEL DIELECTRIC", "CMP DIELECTRIC", "ALIGN MASK LEVEL 3",
    "VIA ETCH", "FILL VIA TUNGSTEN", "CMP VIA FILL", "DEPOSIT METAL 1", "EXPOSE LITHO LEVEL 3",
    "DEVELOP PAD WINDOW", "METAL ETCH", "CLEAN AFTER METAL ETCH", "DEPOSIT PASSIVATION",
    "CURE PASSIVATION", "OPEN PAD WINDOW", "DEPOSIT BACKSIDE METAL", "PARAMETRIC TEST",
    "WAFER SORT TEST", "YIELD ANALYSIS", "LOT RELEASE", "SHIP LOT", "MEASURE THICKNESS",
]
NOVEL_STEPS = [
    "RECEIVE WAFER LOT", "WASH SUBSTRATE", "GROW GAN BUFFER", "MOCVD SIC LAYER", "ALIGN MASK LEVEL 0",
    "ALIGN MASK LEVEL 1", "EXPOSE STEPPER FIELD", "DEVELOP RESIST IMAGE", "PLASMA MESA ETCH",
    "STRIP PHOTORESIST", "DOPE P WELL", "SINTER CONTACTS", "POLISH WAFER FACE", "DEPOSIT PASSIVATION CAP",
    "ANNEAL PASSIVATION FILM", "BOND PAD OPEN ETCH", "REAR CONTACT SPUTTER", "PROBE STATION RUN",
    "FINAL SORT TEST", "DISPATCH CRATES", "QUANTUM TUNING", "align mask  level 2 ", "CHECK PADDLE",
]
# Names that break no rule in any order: routes of one user in seven; another seventh mixes in unknown names.
QUIET_STEPS = [
    "RECEIVE WAFER LOT", "RCA CLEAN 1", "HF DIP", "SPIN COAT PHOTORESIST", "ALIGN MASK LEVEL 1",
    "EXPOSE LITHO LEVEL 1", "DEVELOP PHOTORESIST", "STRIP RESIST", "CLEAN AFTER ETCH",
    "RAPID THERMAL ANNEAL", "MEASURE THICKNESS",
]
UNSURE_STEPS = [*QUIET_STEPS, "QUANTUM TUNING", "QUANTUM SETTLING"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def journeys(spark: SparkSession, sf: str, graded: bool = False) -> DataFrame:
    """user_id, ts, event_id, step and value of every event."""
    step = F.col("event_type")
    if graded:
        step = F.concat_ws(" ", step, F.floor(F.col("value") / 50).cast("bigint").cast("string"))
    return table(spark, sf, "events").select("user_id", "ts", "event_id", step.alias("step"), "value")


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """Fabrication routes: each event stands for a step chosen by its id and value."""
    number = F.col("event_id") * 7919 + F.floor("value")

    def pick(steps: list[str]):
        return F.element_at(F.array(*map(F.lit, steps)), (number % len(steps) + 1).cast("int"))

    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("user_id") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_id", family.alias("family"),
        F.when(F.col("user_id") % 7 == 0, pick(QUIET_STEPS)).when(F.col("user_id") % 7 == 1, pick(UNSURE_STEPS))
        .when(F.col("user_id") % 3 == 2, pick(NOVEL_STEPS)).otherwise(pick(ROUTE_STEPS)).alias("step"))


def journey_segments(spark: SparkSession, sf: str, graded: bool = False) -> DataFrame:
    """Array form: user_id, segment, steps (at most MAX_LEN each)."""
    rows = running_state(journeys(spark, sf, graded), ["user_id"], ORDER)
    return segments(rows, ["user_id"], {"step": F.col("step")}, max_len=MAX_LEN)


def route_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = running_state(routes(spark, sf), ["user_id", "family"], ORDER)
    return segments(rows, ["user_id", "family"], {"step": F.col("step")}, max_len=MAX_LEN)


def classed_segments(spark: SparkSession, sf: str, book: RuleBook) -> DataFrame:
    """Routes with canonical names as array<struct<step, mask, level>> for one of the fabrication books."""
    rows = running_state(routes(spark, sf), ["user_id", "family"], ORDER)
    rows = rows.withColumn("step", steps.canonical(F.col("step")))
    if book is fab.BY_CLASS:
        rows = steps.with_classes(rows).withColumnRenamed("class_mask", "mask")
    else:
        rows = by_distinct(rows, "step", lambda names: names.withColumn("mask", book.mask(F.col("step"))))
    fields = {"step": F.col("step"), "mask": F.col("mask"), "level": book.level_of(F.col("step"))}
    return segments(rows, ["user_id", "family"], fields, max_len=MAX_LEN)


# -- the same in SQL -------------------------------------------------------------------

def names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def isin(column: str, values) -> str:
    """Membership in a list in which a trailing * makes a prefix."""
    plain = [v for v in values if not v.endswith("*")]
    tests = [f"{column} IN ({names(plain)})"] if plain else []
    tests += [f"starts_with({column}, '{v[:-1]}')" for v in values if v.endswith("*")]
    return "(" + " OR ".join(tests) + ")"


POSITION = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
JOURNEYS = f"""j AS (SELECT user_id, ts, event_id, event_type AS step, value, {POSITION} AS step_index FROM events)"""
GRADED = f"""j AS (SELECT user_id, ts, event_id,
  event_type || ' ' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS step,
  event_type AS kind, value, CAST(floor(value / 50) AS BIGINT) AS grade, {POSITION} AS step_index FROM events)"""
_NUMBER = "(event_id * 7919 + CAST(floor(value) AS BIGINT))"
ROUTES = f"""j AS (SELECT user_id, ts, event_id, [{names(FAMILIES)}][CAST(user_id % 3 AS INT) + 1] AS family,
  CASE WHEN user_id % 7 = 0 THEN [{names(QUIET_STEPS)}][CAST({_NUMBER} % {len(QUIET_STEPS)} AS INT) + 1]
       WHEN user_id % 7 = 1 THEN [{names(UNSURE_STEPS)}][CAST({_NUMBER} % {len(UNSURE_STEPS)} AS INT) + 1]
       WHEN user_id % 3 = 2 THEN [{names(NOVEL_STEPS)}][CAST({_NUMBER} % {len(NOVEL_STEPS)} AS INT) + 1]
       ELSE [{names(ROUTE_STEPS)}][CAST({_NUMBER} % {len(ROUTE_STEPS)} AS INT) + 1] END AS step,
  {POSITION} AS step_index FROM events)"""
SEGMENTS = f"""s AS (SELECT user_id, CAST(step_index // {MAX_LEN} AS BIGINT) AS segment,
  list(step ORDER BY step_index) AS steps FROM j GROUP BY 1, 2)"""
ROUTE_SEGMENTS = f"""s AS (SELECT user_id, family, CAST(step_index // {MAX_LEN} AS BIGINT) AS segment,
  list(step ORDER BY step_index) AS steps FROM j GROUP BY 1, 2, 3)"""
