"""Readers and writers on small files, and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from waymark.functions import quantities as Q
from waymark.operators import mining as M, semantics as D
from waymark.operators.rules import check
from waymark.plans import inputs
from waymark.rulesets import fabrication as fab
from waymark.sources import readers as R, writers as W
from waymark.streaming.monitor import live_contexts, run_available, run_monitor


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_long_steps(spark, tmp_path):
    path = put(tmp_path, "a.csv", '﻿"SEQUENCE_ID", "STEP"\ns1,"HF DIP"\ns2,A\ns1,\ns1, B \n')
    assert rows(R.read_steps(spark, path), "sequence_id", "step_index", "step") == [
        ("s1", 0, "HF DIP"), ("s1", 1, "B"), ("s2", 0, "A")]


def test_single_column_and_missing_column(spark, tmp_path):
    path = put(tmp_path, "b.csv", '﻿"STEP"\n"X"\n"Y"\n')
    assert rows(R.read_steps(spark, path), "sequence_id", "step_index", "step") == [("seq_0001", 0, "X"), ("seq_0001", 1, "Y")]
    with pytest.raises(ValueError):
        R.read_steps(spark, put(tmp_path, "c.csv", "OTHER\n1\n"))


def test_order_holds_over_many_splits(spark, tmp_path):
    path = put(tmp_path, "big.csv", "SEQUENCE_ID,STEP\n" + "".join(f"s{i % 3},step {i:05d}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = R.read_steps(spark, path)
        assert df.select("step_index").count() == 5000
        bad = df.filter(F.substring("step", 6, 5).cast("int") != F.col("step_index") * 3 + F.substring("sequence_id", 2, 1).cast("int"))
        assert bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_uploads(spark, tmp_path):
    pipe = put(tmp_path, "p.csv", "EXAMPLE_ID,FAMILY,SEQUENCE\ne1,IGBT,A| B ||C\ne2,IC,\n")
    assert rows(R.read_upload(spark, pipe), "example_id", "family", "steps") == [("e1", "IGBT", ["A", "B", "C"])]
    bare = put(tmp_path, "q.csv", "PREDICTED_SEQUENCE\nA|B\n\nC\n")
    assert rows(R.read_upload(spark, bare), "example_id", "family", "steps") == [
        ("row_1", "MOSFET", ["A", "B"]), ("row_2", "MOSFET", ["C"])]
    long = put(tmp_path, "r.csv", "SEQUENCE_ID,STEP\ns1,A\ns1,B\n")
    assert rows(R.read_upload(spark, long), "example_id", "steps") == [("s1", ["A", "B"])]
    single = put(tmp_path, "s.csv", "STEP\nA\nB\n")
    assert rows(R.read_upload(spark, single), "example_id", "steps") == [("sequence_1", ["A", "B"])]
    with pytest.raises(ValueError):
        R.read_upload(spark, put(tmp_path, "t.csv", "X,Y\n1,2\n"))


def test_steps_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, ["C"]), (1, ["A", "B, c"])], "ord int, steps array<string>")
    W.write_steps(df, str(tmp_path / "out"), "ord")
    back = R.read_steps(spark, str(tmp_path / "out"))
    assert rows(back, "sequence_id", "step_index", "step") == [("seq_0001", 0, "A"), ("seq_0001", 1, "B, c"), ("seq_0002", 0, "C")]


def test_existing_and_first(spark, tmp_path):
    a, b = put(tmp_path, "a.csv", "STEP\nA\n"), put(tmp_path, "b.csv", "STEP\nB\n")
    none = str(tmp_path / "none.csv")
    assert R.read_existing_steps(spark, [none, a, b]).count() == 2
    assert R.read_existing_steps(spark, [none]).count() == 0
    assert R.read_first(spark, none, b).first().STEP == "B"
    with pytest.raises(FileNotFoundError):
        R.read_first(spark, none)


def test_descriptions(spark, tmp_path):
    a = put(tmp_path, "d.csv", '﻿"STEP","DESCRIPTION"\n"HF DIP","strips oxide"\n"METAL ETCH","cuts metal"\n')
    b = put(tmp_path, "p.csv", '﻿"STEP","DESCRIPTION","REALISTIC FAB‑LEVEL PARAMETERS"\n"HF DIP","strips oxide","30 s; 25 °C"\n"HF DIP","dips","5000 °C"\n')
    merged = D.merge_semantics(R.read_descriptions(spark, [("IC", a), ("IGBT", b), ("X", str(tmp_path / "none.csv"))]))
    got = {r.step: r for r in merged.collect()}
    assert got["HF DIP"].descriptions == ["strips oxide", "dips"] and got["HF DIP"].families == ["IC", "IGBT"]
    assert got["HF DIP"].parameters == ["30 s; 25 °C", "5000 °C"] and got["METAL ETCH"].parameters == []
    wanted = spark.createDataFrame([("METAL ETCH DRY",), ("HF DIP",), ("METAL ETCH SLOW",), ("SHIP LOT",)], "step string")
    text = {r.step: r.description for r in D.describe(wanted, merged).collect()}
    assert text == {"METAL ETCH DRY": "cuts metal", "HF DIP": "strips oxide", "METAL ETCH SLOW": "cuts metal",
                    "SHIP LOT": "(logistics operation)"}
    flagged = Q.implausible(Q.extract(merged.select("step", F.explode("parameters").alias("p")), "p")).collect()
    assert [r.reason for r in flagged] == ["temperature 5000 C is outside the plausible range [0, 2000] C"]


@pytest.mark.parametrize("text,found", [
    ("Boron; 150 keV; dose 2×10¹³ cm⁻²; tilt 7°", [("implant_energy", 150.0), ("dose", 2e13)]),
    ("Dry O₂ furnace; 1000 °C; O₂ 5 slm; thickness 50 nm", [("temperature", 1000.0), ("thickness", 50.0), ("gas_flow", 5000.0)]),
    ("LPCVD SiH₄ 200 sccm; 620 °C; 300 mTorr", [("temperature", 620.0), ("pressure", 300.0), ("gas_flow", 200.0)]),
    ("hold 30s then 30 s; 300 mm; 2 µm", [("time", 30.0), ("thickness", 2000.0)]), ("-40 keV", [("implant_energy", -40.0)])])
def test_quantities(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert sorted((r.quantity, r.canonical_value) for r in Q.extract(df, "t").collect()) == sorted(found)


def test_batches_and_metrics(spark, tmp_path):
    put(tmp_path, "b.json", json.dumps({"batch_id": "b1", "predicted_yield": 0.6, "per_step": [
        {"step_id": "s0", "step_name": "A", "risk_score": 0.8, "shap": [{"feature": "t", "value": 1.0, "contribution": -0.4}]},
        {"step_id": "s1", "step_name": "B", "risk_score": 0.1, "shap": []}], "anomalies": []}, indent=1))
    from waymark.operators.serving import batch_summaries, flatten_batches
    batches = R.read_batches(spark, str(tmp_path / "b.json"))
    assert rows(flatten_batches(batches), "step_id", "feature", "contribution")[0] == ("s0", "t", -0.4)
    assert flatten_batches(batches).count() == 2
    summary = batch_summaries(batches, F.lit("2026-05-30").cast("timestamp")).first()
    assert (summary.defect_probability, summary.confidence, summary.material) == (0.4, 0.7, "IC")
    main = put(tmp_path, "m.json", json.dumps({"task1_nextstep": {"top1": 0.9}, "task3_anomaly": {"f1": 0.0}}, indent=1))
    got = R.read_metrics(spark, main, str(tmp_path / "none.json")).first()
    assert json.loads(got.task1_nextstep) == {"top1": 0.9} and json.loads(got.task3_encoder) == {"f1": 0.0}
    assert got.task2_logic_validity == 1.0 and got.task1_hybrid == "{}"


def test_submissions_and_export(spark, tmp_path):
    df = spark.createDataFrame([("e1", ["A", "B"], 1, 0.95, None)], "example_id string, ranks array<string>, is_valid int, score double, rule string")
    assert tuple(W.next_step_submission(df, "ranks").first()) == ("e1", "A", "B", "", "", "")
    assert tuple(W.completion_submission(df, "ranks").first()) == ("e1", "A|B")
    assert tuple(W.anomaly_submission(df).first()) == ("e1", 1, "0.9500", "")
    W.write_submission(W.anomaly_submission(df), str(tmp_path / "s"))
    assert R.read_table(spark, str(tmp_path / "s")).first().PREDICTED_RULE == ""
    ins = spark.createDataFrame([("e1", "IC"), ("e2", "IC")], "example_id string, family string")
    done = spark.createDataFrame([("e1", ["A"], True)], "example_id string, completion array<string>, is_valid boolean")
    assert rows(W.export(ins, done, "complete"), "EXAMPLE_ID", "IS_VALID", "PREDICTED_STEPS") == [("e1", "true", "1"), ("e2", "", "")]
    W.append_log(df.select("example_id"), str(tmp_path / "log"))
    W.append_log(df.select("example_id"), str(tmp_path / "log"))
    assert R.read_log(spark, str(tmp_path / "log"), "example_id string").count() == 2
    W.write_blind_split(df, str(tmp_path / "in"), str(tmp_path / "lab"), ["score"], ["is_valid"])
    assert R.read_table(spark, str(tmp_path / "in")).columns == ["example_id", "score"]


# -- streams ------------------------------------------------------------------------------------

def parts(spark, sf, folder, n):
    """The events in n files by time, written one after the other."""
    df = inputs.journeys(spark, sf, graded=True)
    for i in range(n):
        day = F.dayofmonth("ts")
        df.filter((day > i * 30 / n) & (day <= (i + 1) * 30 / n)).coalesce(1).write.mode("append").parquet(str(folder))
    return R.read_event_stream(spark, str(folder), df.schema, files_per_trigger=1)


STREAMED = ["user_id", "rule", "step_index", "step"]


def in_files(spark, folder, parts):
    """(user_id, ts, event_id, step) rows in one file after the other, as a stream of one file at a time."""
    for part in parts:
        df = spark.createDataFrame(part, "user_id long, ts string, event_id long, step string")
        df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(folder))
    return R.read_event_stream(spark, str(folder), "user_id long, ts timestamp, event_id long, step string", files_per_trigger=1)


def test_stream_equals_batch_over_several_micro_batches(spark, sf, tmp_path):
    found, late = run_monitor(parts(spark, sf, tmp_path / "e", 3), "t", inputs.JOURNEY_BOOK, "user_id", "ts", "event_id", cell="3 days")
    want = rows(check(inputs.journeys(spark, sf, graded=True), inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER), *STREAMED)
    assert rows(found, *STREAMED) == want and want and late.count() == 0


def test_steps_out_of_order_wait_for_the_watermark(spark, tmp_path):
    """The second file brings steps older than the first one's; within the delay they are put in order, late ones go to the side."""
    shuffled = [[(1, "2024-01-01 00:10:00", 1, "purchase 0"), (2, "2024-01-01 00:10:00", 7, "view 3")],
                [(1, "2024-01-01 00:05:00", 2, "signup 0"), (2, "2024-01-01 00:04:00", 8, "view 1")],
                [(1, "2024-01-01 00:30:00", 3, "purchase 0"), (1, "2024-01-01 00:31:00", 4, "purchase 0")]]
    batch = spark.createDataFrame([r for part in shuffled for r in part], "user_id long, ts string, event_id long, step string")
    batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = in_files(spark, tmp_path / "e", shuffled)
    found, late = run_monitor(stream, "wait", inputs.JOURNEY_BOOK, "user_id", "ts", "event_id", delay="10 minutes", cell="1 minute")
    assert late.count() == 0
    assert rows(found, *STREAMED) == rows(check(batch, inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER), *STREAMED)
    found, late = run_monitor(stream, "late", inputs.JOURNEY_BOOK, "user_id", "ts", "event_id", cell="1 minute")
    assert rows(late, "user_id", "step", "tie") == [(1, "signup 0", 2), (2, "view 1", 8)] and "rule" not in late.columns
    kept = batch.filter("event_id NOT IN (2, 8)")
    assert rows(found, *STREAMED) == rows(check(kept, inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER), *STREAMED)


def test_state_goes_at_the_terminal_step_or_when_idle(spark, tmp_path):
    """A sequence that begins anew has its first step at position 0 again."""
    stream = in_files(spark, tmp_path / "e", [[(1, "2024-01-01 00:00:00", 0, "SHIP LOT")], [(2, "2024-01-01 01:00:00", 1, "HF DIP")], [(1, "2024-01-01 02:00:00", 2, "SHIP LOT")]])
    for options, places in (({"terminal": "SHIP"}, [0, 0]), ({"idle": "20 minutes"}, [0, 0]), ({}, [0])):
        found, _ = run_monitor(stream, "end", fab.EXACT, "user_id", "ts", "event_id", cell="1 minute", **options)
        assert [r[1] for r in rows(found.filter("rule = 'RULE_SHIP_BEFORE_TEST'"), "ts", "step_index")] == places


def test_keys_of_one_bucket_are_judged_by_themselves(spark, sf, tmp_path):
    """All keys share the calls to the state store; a key that waits or is idle leaves the others as they are."""
    stream = parts(spark, sf, tmp_path / "e", 3)
    found, _ = run_monitor(stream, "bucket", inputs.JOURNEY_BOOK, "user_id", "ts", "event_id", cell="3 days", buckets=1)
    want = rows(check(inputs.journeys(spark, sf, graded=True), inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER), *STREAMED)
    assert rows(found, *STREAMED) == want and want
    at = lambda key, minute, n: (key, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", n, "SHIP LOT")
    stream = in_files(spark, tmp_path / "i", [[at(1, 0, 0), at(2, 0, 1), at(None, 0, 2)], [at(2, 15, 3), at(3, 50, 4)], [at(1, 70, 5), at(2, 72, 6), at(None, 75, 7)]])
    found, late = run_monitor(stream, "idle", fab.EXACT, "user_id", "ts", "event_id", cell="7 minutes", delay="60 minutes", idle="20 minutes", buckets=1)
    got = {(r.tie, r.step_index) for r in found.filter("rule = 'RULE_SHIP_BEFORE_TEST'").collect()}
    # the second SHIP LOT of key 2, within its idle time, is not its first one
    assert got == {(0, 0), (1, 0), (2, 0), (4, 0), (5, 0), (6, 0), (7, 0)} and late.count() == 0


def test_delayed_files_in_parts(spark, sf, monkeypatch):
    from waymark.plans import stream_queries
    read = lambda: sorted(map(tuple, stream_queries.stream_late_steps(spark, sf).collect()))
    whole = read()
    monkeypatch.setattr(stream_queries, "PART_ROWS", 50)
    assert read() == whole and whole


def test_one_long_key_in_cells(spark, tmp_path):
    steps = [(1, f"2024-01-01 {n // 60 % 24:02d}:{n % 60:02d}:00", n, "purchase 0" if n % 7 == 0 else "click 0") for n in range(1200)]
    stream = in_files(spark, tmp_path / "e", [steps[::-1][:700], steps[:500]][::-1])
    found, late = run_monitor(stream, "long", inputs.JOURNEY_BOOK, "user_id", "ts", "event_id", cell="10 minutes", delay="1 hour")
    batch = spark.createDataFrame(steps, "user_id long, ts string, event_id long, step string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert rows(found, *STREAMED) == rows(check(batch, inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER), *STREAMED) and late.count() == 0


def test_contexts_follow_the_latest_steps(spark, sf, tmp_path):
    out = run_available(live_contexts(parts(spark, sf, tmp_path / "e", 2), "user_id", "ts", "event_id"), "ctx")
    lagged = M.with_lags(inputs.journeys(spark, sf, graded=True), ["user_id"], inputs.ORDER)
    want = {r.user_id: (r.n, r.a, r.b) for r in lagged.groupBy("user_id").agg(
        F.count("*").alias("n"), F.max_by("step", "step_index").alias("a"), F.max_by("lag1", "step_index").alias("b")).collect()}
    latest = out.groupBy("user_id").agg(F.max("seen").alias("n"), F.max_by("lag1", "seen").alias("a"), F.max_by("lag2", "seen").alias("b"))
    assert set(rows(latest, "user_id", "n", "a", "b")) == {(u, *v) for u, v in want.items()}


def test_contexts_of_one_long_key_in_reversed_order(spark, tmp_path):
    """Several micro-batches of several Arrow batches each, latest steps first."""
    schema = "user_id long, ts timestamp, event_id long, step string"
    for part in range(3):
        ids = spark.range(36_000 - 12_000 * part, 24_000 - 12_000 * part, -1, 1)
        ids.select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"),
                   F.concat(F.lit("s"), "id").alias("step")).write.mode("append").parquet(str(tmp_path / "e"))
    stream = R.read_event_stream(spark, str(tmp_path / "e"), schema, files_per_trigger=1)
    out = run_available(live_contexts(stream, "user_id", "ts", "event_id"), "long")
    last = max(rows(out, "seen", "lag1", "lag2"))
    assert last == (36_000, "s36000", "s35999") and out.count() == 3
