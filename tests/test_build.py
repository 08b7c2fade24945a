"""The data build job and small helpers around it."""

from pyspark.sql import functions as F

from waymark.operators import mining as M, semantics as D
from waymark.plans import inputs
from waymark.plans.build_data import build
from waymark.rulesets import fabrication as fab
from waymark.sources.readers import read_steps, read_table


def test_build(spark, tmp_path):
    rows = inputs.classed_segments(spark, "/root/testdata/sf0.01", fab.EXACT).withColumnRenamed("user_id", "id")
    copies = rows.unionByName(rows.withColumn("id", F.col("id") + 1000))
    build(copies, str(tmp_path), n_valid=2, n_invalid=4)
    ids = {p: read_steps(spark, str(tmp_path / p)).select("source_file", "sequence_id").distinct().count()
           for p in ("train", "val", "test")}
    assert ids == {"train": 120, "val": 15, "test": 15}
    inputs_, truth = (read_table(spark, str(tmp_path / n)) for n in ("eval_input_valid", "eval_valid_groundtruth"))
    assert inputs_.count() == truth.count() == 30 and "FULL_SEQUENCE" not in inputs_.columns
    joined = inputs_.join(truth, "example_id")
    assert joined.filter(~F.col("FULL_SEQUENCE").startswith(F.col("PARTIAL_SEQUENCE"))).count() == 0
    labels = read_table(spark, str(tmp_path / "eval_anomaly_labels")).collect()
    assert sum(r.IS_VALID == "1" for r in labels) == 6
    bad = [r for r in labels if r.IS_VALID == "0"]
    assert len(bad) == 12 and all(r.PREDICTED_RULE for r in bad)
    assert "IS_VALID" not in read_table(spark, str(tmp_path / "eval_input_anomaly")).columns


def test_holdout_examples(spark):
    df = spark.createDataFrame([(1, "IC", ["A", "B"]), (2, "IC", ["A"]), (3, "IGBT", list("ABCDE"))],
                               "id int, family string, steps array<string>")
    assert [r.id for r in M.holdout_examples(df, "IGBT", 0.8).collect()] == [1]
    assert [r.cut for r in M.holdout_examples(df, "IGBT", 0.8, held_out=True, first=5, order="id").collect()] == [4]


def test_description_look_up(spark):
    texts = spark.createDataFrame([("HF DIP", "a"), ("soft", "b")], "step string, description string")
    got = {r.step: r.description for r in D.look_up(spark.createDataFrame([("hf dip",), ("soft",), ("x",)], "step string"), texts).collect()}
    assert got == {"hf dip": "a", "soft": "b", "x": None}
