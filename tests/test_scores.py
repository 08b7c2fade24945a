"""Scores on hand-made predictions."""

import math

import pytest
from pyspark.sql import functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.operators import evaluate as E
from waymark.operators.rules import Milestone, RuleBook, check


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def arr(*names):
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def test_rank_scores(spark):
    df = spark.createDataFrame([("a", list("XYZPQ"), "X"), ("b", list("YXZPQ"), "X")],
                               "id string, ranks array<string>, gold string")
    scores = E.next_step_scores(F.col("ranks"), F.col("gold"))
    got = df.select(*[F.avg(c).alias(n) for n, c in scores.items()]).first()
    assert (got.top1, got.top3, got.top5, got.mrr) == (0.5, 1.0, 1.0, 0.75)


def test_blanks_only_count_in_the_internal_scores(spark):
    ranks, gold = arr("", "X"), F.lit("X")
    assert one(spark, **E.next_step_scores(ranks, gold)).top1 == 1.0
    assert one(spark, **E.next_step_scores(ranks, gold, internal=True)).top1 == 0.0


def test_category_scores(spark):
    got = one(spark, **E.next_step_scores(arr("HF DIP", "METAL ETCH"), F.lit("RCA CLEAN 1"), internal=True))
    assert (got.top1, got.top1_category, got.mrr_category) == (0.0, 1.0, 1.0)


@pytest.mark.parametrize("a,b,distance", [("ab", "ab", 0), ("ab", "ac", 1), ("", "", 0), ("abc", "", 3),
                                          ("kitten", "sitting", 3)])
def test_edit_distance(spark, a, b, distance):
    got = one(spark, d=A.edit_distance(arr(*a), arr(*b)), r=A.edit_rate(arr(*a), arr(*b)))
    assert got.d == distance
    assert got.r == pytest.approx(distance / max(len(a), len(b)) if a or b else 0.0)


def test_edit_distance_is_per_token(spark):
    assert one(spark, d=A.edit_distance(arr("METAL ETCH", "HF DIP"), arr("METAL ETCH DRY", "HF DIP"))).d == 1


def test_edit_distance_with_many_tokens(spark):
    a, b = F.sequence(F.lit(1), F.lit(600)), F.sequence(F.lit(301), F.lit(900))
    text = lambda c: F.transform(c, lambda x: x.cast("string"))
    assert one(spark, d=A.edit_distance(text(a), text(b))).d == 600
    # more tokens than the basic plane has characters: a few in common, all others of one side alone
    far = lambda n, at: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.when(x % 20_000 == 0, F.concat(F.lit("c"), x.cast("string"))).otherwise(F.concat(F.lit(at), x.cast("string"))))
    short = F.array(F.lit("c20000"), F.lit("b"), F.lit("c40000"))
    assert one(spark, d=A.edit_distance(far(70_000, "a"), short)).d == 70_000 - 2


def test_completion_scores(spark):
    df = spark.createDataFrame([(list("cd"), list("cd")), (list("cx"), list("cd"))],
                               "p array<string>, g array<string>")
    for internal in (False, True):
        scores = E.completion_scores(F.col("p"), F.col("g"), internal=internal)
        got = df.select(*[F.avg(c).alias(n) for n, c in scores.items()]).first()
        assert got.exact == 0.5 and got.token_accuracy == 0.75
    assert df.select(F.avg(E.completion_scores(F.col("p"), F.col("g"))["ned"])).first()[0] == 0.25


def test_denominators_of_token_accuracy(spark):
    p, g = arr("a", "b"), arr("a", "b", "c", "d")
    assert one(spark, **E.completion_scores(p, g)).token_accuracy == 1.0
    assert one(spark, **E.completion_scores(p, g, internal=True)).token_accuracy == 0.5
    assert one(spark, **E.completion_scores(arr(), arr())).token_accuracy == 0.0


def test_empty_pairs(spark):
    assert one(spark, **E.completion_scores(arr(), arr())).ned == 0.0
    assert one(spark, **E.completion_scores(arr(), arr(), internal=True)).ned_similarity == 1.0


def test_anomaly_scores(spark):
    df = spark.createDataFrame([(1, "", 1, ""), (1, "", 1, ""), (0, "R1", 0, "R1"), (0, "R2", 0, "R1"), (0, "R3", -1, "")],
                               "t int, rule string, p int, guess string")
    counts = E.with_rates(df.agg(*[c.alias(n) for n, c in E.confusion(F.col("t"), F.col("p")).items()])).first()
    assert (counts.tp, counts.fp, counts.tn, counts.fn) == (2, 0, 2, 1)
    assert counts.accuracy == 0.8 and counts.f1 == pytest.approx(0.8)
    got = df.agg(*[c.alias(n) for n, c in E.rule_attribution(F.col("t"), F.col("p"), F.col("rule"), F.col("guess")).items()]).first()
    assert got.attribution_detected == 0.5 and got.attribution_all == pytest.approx(1 / 3)


@pytest.mark.parametrize("hot_rows", [None, 4])
def test_auc(spark, hot_rows):
    rows = [(i % 2, round((i * 37 % 11) / 10, 2), i) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, score double, ord int")
    pos, neg = [s for l, s, _ in rows if l], [s for l, s, _ in rows if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert E.roc_auc(df, "label", "score", hot_rows).first()[0] == pytest.approx(want)
    ranked = sorted(rows, key=lambda r: (-r[1], r[2]))
    ranks = sum(i for i, r in enumerate(ranked, 1) if r[0] == 0)
    want = (ranks - len(neg) * (len(neg) + 1) / 2) / (len(pos) * len(neg))
    assert E.roc_auc_by_rank(df, "label", "score", "ord", hot_rows).first()[0] == pytest.approx(want)


def test_auc_of_one_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "label int, score double, ord int")
    assert E.roc_auc(df, "label", "score").first()[0] is None
    assert E.roc_auc_by_rank(df, "label", "score", "ord").first()[0] == 0.5


def test_last_row_and_supplement(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "id string, ord int, v string")
    assert {r.id: r.v for r in E.last_row(df, "id", "ord").collect()} == {"a": "y", "b": "z"}
    both = E.supplement(df.select("id").distinct(), spark.createDataFrame([("b",), ("c",)], "id string"), "id")
    assert sorted(r.id for r in both.collect()) == ["a", "b", "c"]


def test_family_means_add_up_to_the_total(spark, sf):
    from waymark.plans.catalogue import PLANS
    rows = {(r.family, r.fraction): r for r in PLANS["nextstep_metrics_grouping_sets"](spark, sf).collect()}
    parts = [r for (f, c), r in rows.items() if f != "ALL"]
    total = rows[("ALL", "ALL")]
    assert sum(r.n for r in parts) == total.n
    assert sum(r.n * r.top3 for r in parts) / total.n == pytest.approx(total.top3, abs=1e-5)


def test_step_functions(spark):
    got = one(spark, canon=S.canonical(F.lit("  metal   etch ")), token=S.to_token(F.lit(" HF DIP ")),
              back=S.from_token(F.lit("HF_DIP")), syn=S.canonical_synonym(F.lit("VIA ETCH THROUGH DIELECTRIC")),
              block=S.block(F.lit("CMP METAL")), other=S.block(F.lit("SOFT BAKE")), family=S.family_of(F.lit("igbt_7_60")),
              human=S.humanize(F.lit("overlay_nm")), human2=S.humanize(F.lit("queueTime_ms")))
    assert tuple(got) == ("METAL ETCH", "HF_DIP", "HF DIP", "VIA ETCH", "PLANARIZATION", "OTHER", "IGBT",
                          "Overlay Error (nm)", "QueueTime Ms")


@pytest.mark.parametrize("name,kind", [
    ("GROW GAN BUFFER LAYER", "DEPOSIT"), ("ETCH GAN MESA", "ETCH"), ("IMPLANT N-GAN REGION", "IMPLANT"),
    ("ANNEAL OHMIC CONTACTS", "ANNEAL"), ("CLEAN AFTER PLASMA ETCH", "CLEAN"), ("PLASMA DRY ETCH", "ETCH"),
    ("ALIGN MASK LEVEL 9", "LITHO"), ("QUANTUM TUNING", "UNKNOWN"), ("YIELD ANALYSIS", "INSPECT")])
def test_category(spark, name, kind):
    assert one(spark, c=S.category(F.lit(name))).c == kind


def test_flags(spark):
    up = "DEVELOP PHOTORESIST"
    got = one(spark, **S.feature_flags(F.lit(up), S.category(F.lit(up))))
    assert got.develops_resist and got.opens_implant_window and not got.exposes_resist and len(got) == 25


def test_p_valid(spark):
    from waymark.operators.mining import p_valid
    assert one(spark, p=p_valid(F.lit(2.0), F.lit(1.0))).p == pytest.approx(1 / (1 + math.e))


def test_validity_of_prefix_and_prediction(spark):
    """Judged together: a prediction can break a rule that neither part breaks alone."""
    book = RuleBook(events={"SHIP": ["ship"], "TEST": ["test"]}, rules=[Milestone("SHIP_BEFORE_TEST", "SHIP", ["TEST"])])
    rows = spark.createDataFrame([(1, ["a", "test"], ["ship"]), (2, ["a"], ["ship"]), (3, None, ["a"]), (4, ["a"], None)],
                                 "k int, prefix array<string>, prediction array<string>")
    whole = E.reconstructed(rows, ["k"])
    assert sorted((r.k, r.step_index, r.step) for r in whole.collect()) == [
        (1, 0, "a"), (1, 1, "test"), (1, 2, "ship"), (2, 0, "a"), (2, 1, "ship"), (3, 0, "a"), (4, 0, "a")]
    found = check(whole.withColumnRenamed("step_index", "pos"), book, keys=["k"], order=["pos"])
    assert tuple(E.logic_validity(found, whole, ["k"]).first()) == (4, 0.75)


def test_results_of_sequences_longer_than_a_segment(spark, tmp_path):
    from waymark.plans.inputs import MAX_LEN
    from waymark.plans.serving_queries import three_way_result_join

    lengths = {0: MAX_LEN + 7232, 1: MAX_LEN + 232, 2: 10}
    number = F.when(F.col("id") < lengths[0], 0).when(F.col("id") < lengths[0] + lengths[1], 1).otherwise(2)
    spark.range(sum(lengths.values())).select(
        F.col("id").alias("event_id"), number.cast("long").alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"),
        F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("error")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"),
        F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.completion_fraction): (r.partial_step_count, r.predicted_step_count) for r in three_way_result_join(spark, str(tmp_path)).collect()}
    cut = lambda u, f: max(1, int(lengths[u] * f))
    assert got == {(u, f): (cut(u, f), lengths[u + 1] - cut(u + 1, f)) for u in (0, 1) for f in (0.6, 0.8)}
