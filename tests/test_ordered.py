"""Running state: the chunked scan of long sequences equals the plain window scan."""

import pytest
from pyspark.sql import functions as F

from waymark.operators import ordered
from waymark.operators.ordered import running_state, segments


def state(df, order, hot_rows, reverse=False):
    purchase = F.col("event_type") == "purchase"
    out = running_state(
        df, ["user_id"], order, hot_rows=hot_rows, reverse=reverse, total="n",
        last={"last_purchase": purchase},
        values={"last_value": (purchase, F.col("value"))},
        sums={"purchases": purchase.cast("bigint")},
        lags={"one": (F.col("event_type"), 1), "three": (F.col("event_type"), 3)})
    names = ["event_id", "step_index", "n", "last_purchase", "last_value", "purchases", "one", "three"]
    return sorted(tuple(r) for r in out.select(*names).collect())


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("hot_rows", [10, 40, 60])
def test_chunks_equal_plain_scan(spark, sf, hot_rows, reverse):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plain = state(events, ["ts", "event_id"], 10 ** 9, reverse)
    assert state(events, ["ts", "event_id"], hot_rows, reverse) == plain


def test_one_key_holding_a_third(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    skewed = events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 7).otherwise(F.col("user_id")))
    plain = state(skewed, ["ts", "event_id"], 10 ** 9)
    assert state(skewed, ["ts", "event_id"], 100) == plain


def test_equal_order_values_and_nulls(spark):
    rows = [(1, None if i % 5 == 0 else i % 7, i, "purchase" if i % 4 == 0 else "view", float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, event_type string, value double")
    plain = state(df, ["ts", "event_id"], 10 ** 9)
    assert state(df, ["ts", "event_id"], 12) == plain


def test_string_order(spark):
    rows = [(1, f"k{i:03d}é", i, "purchase" if i % 4 == 0 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_id long, event_type string, value double")
    assert state(df, ["ts", "event_id"], 9) == state(df, ["ts", "event_id"], 10 ** 9)


def test_one_exchange_for_all_state(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    out = running_state(events, ["user_id"], ["ts", "event_id"], total="n",
                        last={"a": F.col("event_type") == "view", "b": F.col("event_type") == "click"},
                        lags={"l": (F.col("event_type"), 1)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_segments_are_bounded_and_whole(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = running_state(events, ["user_id"], ["ts", "event_id"])
    cut = segments(rows, ["user_id"], {"step": F.col("event_type")}, max_len=16)
    sizes = cut.select(F.max(F.size("steps")), F.sum(F.size("steps"))).first()
    assert sizes[0] <= 16 and sizes[1] == events.count()


@pytest.mark.parametrize("name, ts", [("outlier", "CASE WHEN id = 0 THEN -1e15 WHEN id = 19999 THEN 1e15 ELSE id / 1e3 END"),
                                      ("prefix", "concat('a long common prefix of all ', lpad(id, 9, '0'))"), ("ties", "id % 3")])
def test_chunks_stay_below_twice_the_limit(spark, name, ts):
    """Cuts follow the ranks of the whole order, whatever the values of its first column."""
    df = spark.range(20_000).selectExpr("1L AS user_id", f"{ts} AS ts", "id AS event_id")
    hot = ordered._hot_sequences(df, ["user_id"], 2_000)
    chunks = ordered._assign_chunks(df, hot, ["user_id"], ["ts", "event_id"], False).groupBy(ordered.CHUNK).agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("lo"), F.max(F.struct("ts", "event_id")).alias("hi")).orderBy(ordered.CHUNK).collect()
    assert len(chunks) == 20 and sum(r.n for r in chunks) == 20_000 and max(r.n for r in chunks) < 4_000
    assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(chunks, chunks[1:]))
    plain = running_state(df, ["user_id"], ["ts", "event_id"], lags={"before": (F.col("event_id"), 1)})
    cut = running_state(df, ["user_id"], ["ts", "event_id"], lags={"before": (F.col("event_id"), 1)}, hot_rows=2_000)
    assert plain.exceptAll(cut).count() == cut.exceptAll(plain).count() == 0
