"""n-grams, vocabulary, buckets, splits, sampling, likelihood."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from waymark.functions.scorers import ranked, score_prefixes
from waymark.operators import mining as M
from waymark.operators.components import component_of, merge_groups
from waymark.session import cut_lineage
from waymark.operators.semantics import best_match
from waymark.rulesets.fabrication import NOT_SYNONYMS, SPECIAL_TOKENS, SYNONYM_SEEDS


def long(spark, *routes):
    rows = [(k, i, s) for k, steps in enumerate(routes) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "id int, pos int, step string")


def test_ngram_prefers_frequent_then_first_seen(spark):
    lagged = M.with_lags(long(spark, "ABC", "ABD", "ABC"), ["id"], ["pos"])
    counts = M.ngram_counts(lagged, ["id"])
    top = {(r.context, r.rank): r.next for r in M.ranked_next(counts, 2).collect()}
    assert top[("A|B", 1)] == "C" and top[("A|B", 2)] == "D"
    # A occurs as often as B: the one seen first wins
    assert top[("", 1)] == "A"


def test_back_off_to_shorter_contexts(spark):
    counts = M.ngram_counts(M.with_lags(long(spark, "ABC", "ABD", "ABC"), ["id"], ["pos"]), ["id"])
    lists = M.candidate_lists(counts, 5)
    prefixes = spark.createDataFrame([("seen", "B", "A"), ("one", "B", "Z"), ("none", "Q", "Z"), ("short", "A", None),
                                      ("empty", None, None)], "name string, lag1 string, lag2 string")
    got = {r.name: [c.next for c in r.candidates] for r in M.back_off(prefixes, lists, ["lag1", "lag2"]).collect()}
    assert got["seen"] == ["C", "D"] and got["one"] == ["C", "D"] and got["short"] == ["B"]
    assert got["none"] == got["empty"] == ["A", "B", "C", "D"]


def test_ngrams_of_cut_sequences(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", F.col("event_type").alias("step"))
    run = lambda hot: sorted(map(tuple, M.ngram_counts(M.with_lags(
        events, ["user_id"], ["ts", "event_id"], hot_rows=hot), ["user_id"]).collect()))
    assert run(20) == run(None)


def test_vocabulary(spark):
    df = spark.createDataFrame([("HF DIP",), ("RINSE WET WAFER_EDGE",), ("HF DIP",), ("ALIGN MASK LEVEL 1",)], "step string")
    got = {r.token: r.id for r in M.vocabulary(df).collect()}
    assert [got[t] for t in SPECIAL_TOKENS] == list(range(10))
    assert (got["ALIGN_MASK_LEVEL_1"], got["HF_DIP"], got["RINSE_WET_WAFER_EDGE"]) == (10, 11, 12)


def test_bucket_weights_give_equal_mass(spark):
    df = spark.createDataFrame([(i, 10 if i < 8 else 100) for i in range(10)], "id int, n int")
    mass = M.bucket_weights(df, "n", 2).groupBy("bucket").agg(F.sum("weight").alias("w")).collect()
    assert [pytest.approx(0.5)] * 2 == [r.w for r in mass]


@pytest.mark.parametrize("hot_rows", [None, 30])
def test_split_counts(spark, hot_rows):
    df = spark.createDataFrame([(i, "f") for i in range(105)], "id int, family string").withColumn(
        "h", M.hash_order(13, "id"))
    parts = [{r.id: r.part for r in M.split(df, "family", ["h", "id"], hot_rows=hot_rows).collect()} for _ in range(2)]
    assert parts[0] == parts[1]
    assert Counter(parts[0].values()) == {"train": 85, "val": 10, "test": 10}  # 10.5 rounds to even


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_order_statistic(spark, q):
    values = [float(i * 7 % 23) for i in range(37)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(values)[min(36, int(q * 37))]
    assert M.order_statistic(df, "v", q).first()[0] == want
    assert M.order_statistic(df, "v", q, hot_rows=5).first()[0] == want


def test_weighted_sample_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0)], "id int, w double")
    drawn = Counter(r.id for r in M.weighted_sample(df, "id", "w", 2000, seed=1).collect())
    assert sum(drawn.values()) == 2000 and drawn[1] == 0
    assert 2.3 < drawn[3] / drawn[2] < 3.9


def test_nll(spark):
    rows = long(spark, "AB", "AB", "AC")
    lagged = M.with_lags(rows, ["id"], ["pos"])
    got = {r.id: r.nll for r in M.sequence_nll(lagged, M.ngram_counts(lagged, ["id"]), ["id"]).collect()}
    assert got[0] == pytest.approx(-math.log(3 / 6)) and got[2] == pytest.approx(-math.log(2 / 6))


def test_distinct_sequences_keep_the_first(spark):
    df = spark.createDataFrame([(3, ["A", "B"]), (1, ["A", "B"]), (2, ["A|B"]), (4, ["C"])], "id int, steps array<string>")
    got = {r.id: r.copies for r in M.distinct_sequences(df.withColumn("ord", F.col("id")), "steps", "ord").collect()}
    assert 1 in got and 4 in got and 3 not in got


def test_groups_merge(spark):
    groups = [*SYNONYM_SEEDS, ("STRIP RESIST", "STRIP RESIST LEVEL 2"), ("LEAKAGE TEST", "SWITCHING TEST"),
              ("MEASURE OXIDE THICKNESS", "MEASURE FILM THICKNESS")]
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(25)]
    rows = [(i, m) for i, g in enumerate([*groups, *chain]) for m in g]
    df = spark.createDataFrame(rows, "group_id int, member string")
    stop = spark.createDataFrame([(s,) for s in NOT_SYNONYMS], "member string")
    merged = merge_groups(df, stop=stop)
    got = {r.member: r.component for r in component_of(df.select("member").distinct(), merged).collect()}
    assert got["STRIP RESIST LEVEL 2"] == got["STRIP PHOTORESIST"] == "STRIP PHOTORESIST"
    assert got["LEAKAGE TEST"] == "LEAKAGE TEST" and got["MEASURE FILM THICKNESS"] == "MEASURE FILM THICKNESS"
    assert {got[f"c{i:02d}"] for i in range(26)} == {"c00"}


def test_custom_scorer(spark):
    df = spark.createDataFrame([(1, ["A", "B"]), (2, ["C"])], "id int, steps array<string>")
    out = score_prefixes(df, "steps", lambda ps: [{p[-1]: 0.9, "[PAD]": 0.95, "X": 0.1} for p in ps], drop=("[PAD]",))
    got = {r.id: [(c.rank, c.next) for c in r.candidates] for r in out.collect()}
    assert got == {1: [(1, "B"), (2, "X")], 2: [(1, "C"), (2, "X")]}
    assert ranked(["a", "b"]) == [("a", 0.0), ("b", 0.0)]


def test_components_of_large_groups(spark):
    """Groups far above the size that meets under one key: split into trees, joined with small ones and each other."""
    big = spark.range(5000).selectExpr("'big' AS group_id", "id AS member").union(spark.range(9000, 12000).selectExpr("'other'", "id"))
    chain = spark.range(20_000, 20_040).selectExpr("concat('c', id) AS group_id", "explode(array(id, id + 1)) AS member")
    bridge = spark.createDataFrame([("x", 4999), ("x", 9001), ("y", 20_040), ("y", 20_100), ("alone", 77_777)], "group_id string, member long")
    got = {r.member: r.component for r in merge_groups(big.union(chain).union(bridge), group_size=50).collect()}
    want = {m: 0 for m in [*range(5000), *range(9000, 12000)]} | {m: 20_000 for m in [*range(20_000, 20_041), 20_100]}
    assert got == want


def shuffled(spark):
    """Bytes written for shuffles by all stages so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_rounds_do_not_move_the_names_of_groups(spark):
    """A chain that takes several rounds, in groups of long names: the names are shuffled to find the groups only."""
    name = F.concat(*[F.sha2(F.concat(F.lit(f"{i} "), "id"), 512) for i in range(4)])
    chain = cut_lineage(spark.range(3000).select(name.alias("group_id"), F.explode(F.array("id", F.col("id") + 1)).alias("member")))
    held, before = chain.agg(F.sum(F.length("group_id"))).first()[0], shuffled(spark)
    got = merge_groups(chain).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (3001, 0) and shuffled(spark) - before < 2 * held


def test_best_match_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(14)]
    names = lambda n: [(rng.choice("ab"), " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for _ in range(n)]
    left, right = names(150) + [("a", ""), ("a", "w1 w2"), ("a", "w2  w1"), ("a", "w2 w1 w2")], names(150) + [("a", "w1 w2 w3"), ("b", " ")]
    got = {(r.kind, r.step): (r.match, r.score) for r in best_match(*[spark.createDataFrame(x, "kind string, step string") for x in (left, right)], "kind", "step", 0.4).collect()}
    want = {}
    for kind, step in set(left):
        a = set(step.split())
        scored = [(-len(a & set(m.split())) / len(a | set(m.split())), m) for k, m in set(right) if k == kind and a & set(m.split())]
        if scored and -min(scored)[0] >= 0.4:
            want[kind, step] = (min(scored)[1], -min(scored)[0])
    assert got == want and len({s for _, s in got.values()}) > 4
