"""Rule semantics on hand-made routes, and agreement of the two evaluation forms."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from waymark.functions import steps as S
from waymark.operators.advisory import strict_advisory
from waymark.operators.rules import array_violations, check, findings_function, first_violation, report, with_state, violations
from waymark.plans import inputs
from waymark.rulesets import fabrication as fab


def long(spark, routes):
    rows = [(k, i, s) for k, steps in routes.items() for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "id string, pos int, step string")


def exact(spark, routes, **options):
    found = check(long(spark, routes), fab.EXACT, ["id"], ["pos"], **options)
    return sorted((r.id, r.rule, r.step_index) for r in found.collect())


def by_class(spark, routes, hot_rows=None):
    rows = S.with_classes(long(spark, routes).withColumn("step", S.canonical(F.col("step"))))
    state = with_state(rows, fab.BY_CLASS, ["id"], ["pos"], mask=F.col("class_mask"), hot_rows=hot_rows)
    return sorted((r.id, r.rule, r.step_index) for r in violations(state, fab.BY_CLASS, ["id"]).collect())


FILLER = ["MEASURE THICKNESS"]


@pytest.mark.parametrize("gap,bad", [(11, False), (12, True)])
def test_window_edge(spark, gap, bad):
    route = ["HF DIP"] + FILLER * gap + ["DEPOSIT METAL 1"]
    assert bool(exact(spark, {"a": route})) is bad


def test_step_does_not_enable_itself(spark):
    assert exact(spark, {"a": ["THERMAL OXIDATION"], "b": ["THERMAL OXIDATION", "DEPOSIT POLYSILICON"]}) == [
        ("a", "RULE_DEP_NO_CLEAN", 0), ("b", "RULE_DEP_NO_CLEAN", 0)]


def test_metal_etch_needs_both(spark):
    found = exact(spark, {"a": ["DEVELOP PHOTORESIST", "METAL ETCH"], "b": ["EXPOSE LITHO LEVEL 2", "METAL ETCH"],
                          "c": ["EXPOSE LITHO LEVEL 2", "DEVELOP PAD WINDOW", "METAL ETCH"]})
    assert ("a", "RULE_METAL_ETCH_NO_LITHO", 1) in found and ("b", "RULE_METAL_ETCH_NO_LITHO", 1) in found
    assert not [f for f in found if f[0] == "c"]


def test_levels(spark):
    align = lambda *n: [f"ALIGN MASK LEVEL {i}" for i in n]
    assert exact(spark, {"a": align(1, 2, 2, 3), "b": align(1, 3), "c": align(2, 1), "d": align(0, 2),
                         "e": ["ALIGN MASK LEVEL 1", "ALIGN MASK LEVEL X", "ALIGN MASK LEVEL 2"]}) == [
        ("b", "RULE_LITHO_LEVEL_SKIP", 1), ("c", "RULE_LITHO_LEVEL_SKIP", 1), ("d", "RULE_LITHO_LEVEL_SKIP", 1)]
    # the class form does not compare with level 0
    assert by_class(spark, {"d": align(0, 2)}) == []


def test_first_ship_only(spark):
    route = {"a": ["SHIP LOT", "SHIP LOT", "WAFER SORT TEST"]}
    assert exact(spark, route) == [("a", "RULE_SHIP_BEFORE_TEST", 0)]
    assert [f[2] for f in by_class(spark, route)] == [0, 1]


def test_ship_without_test_is_invalid(spark):
    found = check(long(spark, {"a": ["RECEIVE WAFER LOT", "SHIP LOT", "WAFER SORT TEST"]}), fab.EXACT, ["id"], ["pos"])
    assert first_violation(found, fab.EXACT, ["id"]).first().rule == "RULE_SHIP_BEFORE_TEST"


def test_attribution_orders_differ(spark):
    route = {"a": ["SHIP LOT", "DEPOSIT METAL 1"]}
    found = check(long(spark, route), fab.EXACT, ["id"], ["pos"])
    assert first_violation(found, fab.EXACT, ["id"]).first().rule == "RULE_DEP_NO_CLEAN"
    assert first_violation(found, fab.BY_CLASS, ["id"]).first().rule == "RULE_SHIP_BEFORE_TEST"


def test_pad_needs_deposit_and_cure(spark):
    found = exact(spark, {"a": ["HF DIP", "DEPOSIT PASSIVATION", "OPEN PAD WINDOW"],
                          "b": ["HF DIP", "DEPOSIT PASSIVATION", "CURE PASSIVATION", "OPEN PAD WINDOW"]})
    assert found == [("a", "RULE_PAD_OPEN_BEFORE_DEP", 2)]


def test_unknown_names_are_judged_by_class(spark):
    ok = ["wash  substrate", "GROW GAN BUFFER", "DEVELOP RESIST IMAGE", "PLASMA MESA ETCH", "DOPE P WELL",
          "CLEAN AFTER IMPLANT", "DEPOSIT PASSIVATION CAP", "ANNEAL PASSIVATION FILM", "PROBE STATION RUN",
          "FINAL SORT TEST", "DISPATCH CRATES"]
    assert by_class(spark, {"a": ok}) == []
    assert ("a", "RULE_DEP_NO_CLEAN", 0) in by_class(spark, {"a": ok[1:]})


def test_report_counts_sequences_without_violations(spark):
    df = long(spark, {"a": ["HF DIP"], "b": ["METAL ETCH"]})
    rows = {r.id: r for r in report(check(df, fab.EXACT, ["id"], ["pos"]), df, ["id"]).collect()}
    assert rows["a"].is_valid and rows["a"].n_violations == 0
    assert rows["b"].rules == ["RULE_ETCH_NO_MASK", "RULE_METAL_ETCH_NO_LITHO"]


@pytest.mark.parametrize("book", [fab.EXACT, fab.BY_CLASS], ids=["exact", "by_class"])
def test_array_form_equals_long_form(spark, sf, book):
    arrays = inputs.classed_segments(spark, sf, book).select("user_id", F.explode(
        array_violations(book, F.col("steps"))).alias("v"))
    names = [r.rule for r in book.rules]
    got = sorted((r.user_id, names[r.v.rule_no - 1], r.v.pos) for r in arrays.collect())
    rows = inputs.routes(spark, sf).withColumn("step", S.canonical(F.col("step")))
    mask = None
    if book is fab.BY_CLASS:
        rows, mask = S.with_classes(rows), F.col("class_mask")
    state = with_state(rows, book, ["user_id"], inputs.ORDER, mask=mask)
    want = sorted((r.user_id, r.rule, r.step_index) for r in violations(state, book, ["user_id"]).collect())
    assert got == want and want


def test_cut_sequences_give_the_same_violations(spark, sf):
    rows = inputs.journeys(spark, sf, graded=True)
    run = lambda hot: sorted((r.user_id, r.rule, r.step_index) for r in check(
        rows, inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER, hot_rows=hot).collect())
    assert run(15) == run(None)


def test_advice_with_cut_sequences(spark, sf):
    run = lambda hot: sorted((r.user_id, r.code, r.step_index) for r in strict_advisory(
        inputs.routes(spark, sf), ["user_id"], inputs.ORDER, hot_rows=hot).collect())
    assert run(25) == run(None)


def test_rules_share_one_exchange(spark, sf):
    plan = check(inputs.journeys(spark, sf, graded=True), inputs.JOURNEY_BOOK, ["user_id"], inputs.ORDER)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "BatchEvalPython" not in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_findings_by_a_table_function(spark, sf):
    """One SQL call over a table that the caller partitions and orders gives the findings of the batch check."""
    spark.udtf.register("findings", findings_function(inputs.JOURNEY_BOOK))
    steps = inputs.journeys(spark, sf, graded=True)
    book = inputs.JOURNEY_BOOK
    marked = steps.withColumns({"mask": book.mask(F.col("step")), "level": book.level_of(F.col("step"))})
    got = spark.sql("SELECT * FROM findings(TABLE({t}) PARTITION BY user_id ORDER BY (ts, event_id), 'user_id')", t=marked)
    names = ["user_id", "rule", "rule_ord", "step_index", "step", "severity"]
    want = check(steps, book, ["user_id"], inputs.ORDER)
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want.select(names).collect())) != []
    with pytest.raises(AnalysisException, match="level, mask"):
        spark.sql("SELECT * FROM findings(TABLE({t}) PARTITION BY user_id ORDER BY (ts), 'user_id')", t=steps)
