"""Injection, repair, legality and completion: properties on the routes of the events table."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import arrays as A
from waymark.functions import steps as S
from waymark.operators import decode, inject, mining as M, repair
from waymark.operators.rules import array_violations, with_state
from waymark.plans import inputs, transform_queries as T
from waymark.rulesets import fabrication as fab

def items(names, book=fab.EXACT):
    return F.transform(names, lambda s: F.struct(s.alias("step"), book.mask(s).alias("mask"), book.level_of(s).alias("level")))


@pytest.fixture(scope="module")
def fixed(spark, sf):
    return T.repaired(spark, sf)


def test_array_helpers(spark):
    a = F.array(*map(F.lit, "abcde"))
    row = spark.range(1).select(
        A.move_before(a, F.lit(3), F.lit(1)).alias("moved"), A.move_before(a, F.lit(0), F.lit(2)).alias("kept"),
        A.swap(a, F.lit(0), F.lit(4)).alias("swapped"), A.insert_at(a, F.lit(5), F.array(F.lit("z"))).alias("end"),
        A.remove_before(a, F.lit(4), lambda s: s.isin("a", "c"), 2).alias("removed"), A.tail(a, 2).alias("tail"),
        A.collapse(F.array(*map(F.lit, "aabba"))).alias("runs"), A.cut_point(F.lit(1), F.lit(0.6)).alias("cut"),
        A.is_cycling(F.array(*map(F.lit, "xabababab"))).alias("cycle"), A.is_cycling(a).alias("short"),
        A.is_cycling(F.array(*map(F.lit, "abcdefgh"))).alias("no")).first()
    assert ["".join(row[n]) for n in ("moved", "swapped", "end", "removed", "tail", "runs")] == [
        "adbce", "ebcda", "abcdez", "abde", "de", "aba"]
    assert row.kept is None and row.cut == 1 and row.cycle and not row.short and not row.no


def test_injected_rows_break_the_rule_they_are_labelled_with(spark, sf):
    rows = inject.inject(inputs.classed_segments(spark, sf, fab.EXACT), "steps", ["user_id"], seed=4)
    broken = array_violations(fab.EXACT, F.col("injected_steps"))
    names = F.array(*[F.lit(r.rule) for r in fab.EXACT.rules])
    fired = F.transform(broken, lambda v: F.element_at(names, v["rule_no"]))
    got = rows.filter("injected_rule IS NOT NULL").select("injected_rule", fired.alias("fired")).collect()
    assert got and all(r.injected_rule in r.fired for r in got)


def test_repair_makes_routes_valid_or_says_what_is_left(spark, sf):
    out = repair.repair(inputs.classed_segments(spark, sf, fab.BY_CLASS), "steps", max_rounds=60)
    rows = out.select("family", "now_valid", "remaining", "fixes").collect()
    known = [r for r in rows if r.family != "IC"]
    assert known and all(r.now_valid and not r.remaining for r in known) and any(r.fixes for r in known)
    # a shipping step of another name is not moved, so such routes stay open at it
    for r in rows:
        assert r.now_valid or (r.remaining and r.fixes[-1] == "unresolved RULE_SHIP_BEFORE_TEST")


def test_repaired_routes_pass_the_long_form(spark, fixed):
    rows = fixed.select("user_id", F.posexplode("steps").alias("pos", "step"))
    state = with_state(S.with_classes(rows), fab.BY_CLASS, ["user_id"], ["pos"], mask=F.col("class_mask"))
    from waymark.operators.rules import violations
    assert violations(state, fab.BY_CLASS, ["user_id"]).count() == 0 and rows.count() > 0


@pytest.mark.parametrize("route,rule", [
    ("SHIP LOT", "RULE_SHIP_BEFORE_TEST"), ("HF DIP|OPEN PAD WINDOW", "RULE_PAD_OPEN_BEFORE_DEP"),
    ("HF DIP|CURE PASSIVATION|DEPOSIT PASSIVATION|PARAMETRIC TEST|OPEN PAD WINDOW", None),
    ("OPEN PAD WINDOW|HF DIP|CURE PASSIVATION|DEPOSIT PASSIVATION", "RULE_PAD_OPEN_BEFORE_DEP"),
    ("ALIGN MASK LEVEL 3|ALIGN MASK LEVEL 1", "RULE_LITHO_LEVEL_SKIP"), ("METAL ETCH", "RULE_METAL_ETCH_NO_LITHO")])
def test_single_repairs(spark, route, rule):
    steps = S.with_classes(spark.createDataFrame([(1, i, s) for i, s in enumerate(route.split("|"))],
                                                 "id int, pos int, step string"))
    out = repair.repair(inject.collect_steps(steps, ["id"], fab.BY_CLASS), "steps").first()
    assert out.now_valid
    assert not rule or any(f.startswith(rule) for f in out.fixes)


def test_novel_variants_are_valid_and_new(spark, fixed):
    out = inject.novel_variants(fixed, ["user_id", "segment"], "steps", "SICFET", [0.25, 1.0])
    rows = out.select("rename_fraction", F.size(F.filter("steps", lambda x: x["step"].contains("SICFET"))).alias("new"),
                      F.size(array_violations(fab.BY_CLASS, F.col("steps"))).alias("bad")).collect()
    assert rows and all(r.bad == 0 and r.new > 0 for r in rows)
    mean = lambda f: sum(r.new for r in rows if r.rename_fraction == f) / len([r for r in rows if r.rename_fraction == f])
    assert mean(1.0) > mean(0.25)


def test_class_injection_labels_the_first_violation(spark, fixed):
    variants = inject.novel_variants(fixed, ["user_id", "segment"], "steps", "OOD", [1.0], structural=False)
    rows = variants.withColumn("b", inject.inject_by_class(F.col("steps"))).filter("b IS NOT NULL").select(
        "b.rule", F.size(array_violations(fab.BY_CLASS, F.col("b.steps"))).alias("n")).collect()
    assert rows and all(r.n > 0 and r.rule.startswith("RULE_") for r in rows)


def test_anomaly_rows_reuse_a_small_pool(spark, fixed):
    arrays = fixed.select("user_id", "family", items(F.col("steps")).alias("steps")).filter("family = 'IC'")
    n = arrays.count()
    out = inject.anomaly_rows(arrays, "family", ["user_id"], "steps", n - 1, 7, seed=2).collect()
    assert len([r for r in out if r.is_valid]) == n - 1
    bad = [r for r in out if not r.is_valid]
    assert len({r.example_id for r in bad}) == len(bad) == 7 and all(r.rule for r in bad)


def test_quiet_sequences_are_broken_too(spark):
    """Sequences in which nothing needs another step, one of them empty: each gets a violation that fires."""
    quiet = [["RECEIVE WAFER LOT", "MEASURE THICKNESS"], ["QUANTUM TUNING"] * 3, []]
    df = spark.createDataFrame(list(enumerate(quiet)), "id int, names array<string>").withColumn("family", F.lit("IC"))
    arrays = df.select("id", "family", items(F.col("names")).alias("steps"))
    out = inject.anomaly_rows(arrays, "family", ["id"], "steps", 0, 40, seed=9)
    broken = F.transform(array_violations(fab.EXACT, F.col("steps")), lambda v: F.element_at(F.array(*[F.lit(r.rule) for r in fab.EXACT.rules]), v["rule_no"]))
    got = out.select("example_id", "rule", broken.alias("fired"), F.size("steps").alias("n")).collect()
    assert len({r.example_id for r in got}) == 40 and all(r.rule in r.fired for r in got)
    assert len({r.rule for r in got}) > 5 and {r.n for r in got} == {1, 3, 4}


def test_completion_in_rounds_gives_the_same(spark, sf, monkeypatch):
    """The fold over a broadcast model and the join of a model too large for it."""
    lists, profile, _, prefixes = T.model_and_prefixes(spark, sf)
    prefixes = T.cut_lineage(prefixes.filter("user_id < 6"))
    keys = ["user_id", "family", "fraction"]
    runs = [lambda: decode.complete(prefixes, lists, fab.BY_CLASS, profile, max_steps=7), lambda: decode.complete(prefixes, lists, fab.BY_CLASS, profile, max_steps=7, top=3, fallback=True, finish=False),
            lambda: decode.beam_complete(prefixes, keys, lists, fab.BY_CLASS, profile, beam=3, branch=4, max_steps=4)]
    read = lambda df: sorted((*[r[k] for k in keys], r.completion, r.cut_short, round(r.logp, 9) if "logp" in df.columns else 0) for r in df.collect())
    folded = [read(run()) for run in runs]
    monkeypatch.setattr(decode, "MODEL_LISTS", 0)
    assert [read(run()) for run in runs] == folded and any(r[4] for f in folded for r in f)


def test_equal_states_share_one_beam_search(spark, sf, monkeypatch):
    """Prefixes moved along, and with an enabler beyond its window moved further away, are searched once; the rounds search each."""
    lists, profile, _, prefixes = T.model_and_prefixes(spark, sf)
    one = prefixes.filter("prefix_valid AND last_CLEAN_SURFACE IS NOT NULL").orderBy("user_id", "fraction").limit(1)
    move, far = F.col("id") * 100, F.when(F.col("id") > 2, 50 + F.col("id")).otherwise(0)
    places = {c: F.col(c) + move for c in decode.state_columns(fab.BY_CLASS) if c != "previous_level"}
    moved = one.crossJoin(spark.range(6)).withColumns({**places, "user_id": F.col("id"), "cut": F.lit(7)})
    moved = T.cut_lineage(moved.withColumn("step_index", F.col("step_index") + 200).withColumn("last_CLEAN_SURFACE", F.col("last_CLEAN_SURFACE") - far)
                          .withColumn("last_EXPOSE", F.when(F.col("id") == 5, F.col("step_index") - 1)).drop("id"))
    searched, fold = [], decode._beam_fold
    monkeypatch.setattr(decode, "_beam_fold", lambda states, *args: searched.append(states.count()) or fold(states, *args))
    keys = ["user_id", "family", "fraction"]
    run = lambda: decode.beam_complete(moved, keys, lists, fab.BY_CLASS, profile, beam=3, branch=4, max_steps=10)
    read = lambda df: sorted([*[r[c] for c in (*keys, *decode.state_columns(fab.BY_CLASS), "lag1", "lag2", "has_test", "completion", "cut_short")], round(r.logp, 9)] for r in df.collect())
    shared = read(run())
    assert searched == [2] and len(shared) == 6 and any(r[-3] for r in shared)
    monkeypatch.setattr(decode, "MODEL_LISTS", 0)
    assert read(run()) == shared


def test_cycles_with_the_next_step(spark):
    rng = random.Random(4)
    rows = sorted({"".join(rng.choice("ab") for _ in range(7)) for _ in range(60)} | {"abcabca", "abcdabc", "aaaaaaa", "ab", ""})
    df = spark.createDataFrame([(list(t), x) for t in rows for x in "abcd"], "recent array<string>, x string")
    both = df.select(F.array_contains(A.cycle_ends(F.col("recent")), F.col("x")).alias("ends"), F.concat("recent", F.array("x")).alias("all"),
                     A.is_cycling(F.concat("recent", F.array("x"))).alias("cycles")).collect()
    want = lambda s: len(s) >= 8 and any(all(s[i] == s[i % p] for i in range(8)) for p in (1, 2, 3, 4))
    assert all(r.ends == r.cycles == want(r["all"]) for r in both) and any(r.ends for r in both)


def test_prefix_state_agrees_with_full_validation(spark, sf):
    """Legality from the state columns equals validating prefix plus candidate."""
    lists, profile, _, prefixes = T.model_and_prefixes(spark, sf, 40)
    listed = M.back_off(prefixes, lists, ["lag1", "lag2"])
    fast = listed.select("user_id", "cut", F.explode(F.transform("candidates", lambda c: F.struct(
        c["next"].alias("next"), decode.is_legal(fab.BY_CLASS, c["mask"], c["level"]).alias("legal")))).alias("c"))
    arrays = inputs.classed_segments(spark, sf, fab.BY_CLASS).select("user_id", "steps")
    joined = fast.select("user_id", "cut", "c.*").join(profile, "next").join(arrays, "user_id")
    tried = F.concat(A.head(F.col("steps"), F.col("cut")),
                     F.array(F.struct(F.col("next").alias("step"), "mask", "level")))
    slow = F.size(F.filter(array_violations(fab.BY_CLASS, F.col("tried")), lambda v: v["pos"] == F.col("cut"))) == 0
    rows = joined.withColumn("tried", tried).select("legal", slow.alias("slow")).collect()
    assert len(rows) > 30 and all(r.legal == r.slow for r in rows)
    assert {r.legal for r in rows} == {True, False}


def test_completions_of_valid_prefixes_stay_valid(spark, fixed):
    rows = fixed.select("user_id", F.posexplode("steps").alias("pos", "step"))
    keys, order = ["user_id"], ["pos"]
    state = with_state(S.with_classes(rows), fab.BY_CLASS, keys, order, mask=F.col("class_mask"), total="n",
                       lags={"lag1": (F.col("step"), 1), "lag2": (F.col("step"), 2)},
                       sums={"tests": (F.col("step") == decode.LAST_TEST).cast("bigint")})
    counts = M.ngram_counts(state, keys)
    closing = spark.createDataFrame([(decode.LAST_TEST,), (decode.TERMINAL,)], "step string")
    profile = S.with_classes(rows.select("step").union(closing).distinct()).select(
        F.col("step").alias("next"), F.col("class_mask").alias("mask"),
        fab.BY_CLASS.level_of(F.col("step")).alias("level"), "category")
    lists = decode.candidates(counts, profile, 20)
    prefixes = state.filter(F.col("step_index") == F.floor(F.col("n") * 0.5)).select(
        "user_id", "lag1", "lag2", F.lit(True).alias("prefix_valid"), (F.col("tests") > 0).alias("has_test"),
        F.col("step_index").alias("cut"), *decode.state_columns(fab.BY_CLASS))
    greedy = decode.complete(prefixes, lists, fab.BY_CLASS, profile, max_steps=6)
    beam = decode.beam_complete(prefixes, keys, lists, fab.BY_CLASS, profile, beam=2, branch=3, max_steps=3)
    for out in (greedy, beam):
        whole = out.select("user_id", "cut", "completion").join(fixed, "user_id").select(
            "user_id", F.posexplode(F.concat(A.head(F.col("steps"), F.col("cut")), F.col("completion"))).alias("pos", "step"))
        arrays = inject.collect_steps(S.with_classes(whole), keys, fab.BY_CLASS)
        sizes = arrays.select(F.size(array_violations(fab.BY_CLASS, F.col("steps")))).collect()
        assert len(sizes) == prefixes.count() and all(r[0] == 0 for r in sizes)
        assert out.filter(F.size("completion") > 0).count() > 0


def test_rerank_modes(spark):
    row = spark.range(1).withColumns({f"last_{e}": F.lit(None).cast("bigint") for e in fab.BY_CLASS.enablers}).withColumns({
        "step_index": F.lit(3).cast("bigint"), "previous_level": F.lit(None).cast("int"), "previous_category": F.lit("CLEAN")})
    listed = row.withColumn("candidates", F.array(*[F.struct(
        F.lit(i).alias("rank"), F.lit(n).alias("next"), F.lit(0.1).alias("p"), F.lit(m).alias("mask"),
        F.lit(None).cast("int").alias("level"), F.lit(c).alias("category")) for i, (n, m, c) in enumerate([
            ("SHIP LOT", fab.BY_CLASS.bits["SHIP"], "LOGISTICS"), ("SOFT BAKE", 0, "LITHO"), ("MEASURE VIA CD", 0, "MEASURE")], 1)]))
    pairs = spark.createDataFrame([("CLEAN", "MEASURE")], "from_kind string, to_kind string")
    run = lambda mode, k=5: decode.rerank(listed, fab.BY_CLASS, k, mode, pairs).first().reranked
    assert run("off") == ["SOFT BAKE", "MEASURE VIA CD", "SHIP LOT"]
    assert run("soft") == ["MEASURE VIA CD", "SOFT BAKE", "SHIP LOT"]
    assert run("hard") == ["MEASURE VIA CD", "SHIP LOT", "SOFT BAKE"]
    assert run("off", 1) == ["SOFT BAKE"]
