"""End-to-end job: from sequences to split step tables and evaluation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.functions import arrays as A
from waymark.operators import inject, mining as M
from waymark.session import cut_lineage
from waymark.sources import writers as W

FRACTIONS = (0.6, 0.8)


def build(sequences: DataFrame, out: str, *, seed: int = 13, val: float = 0.1, test: float = 0.1,
          n_valid: int, n_invalid: int) -> None:
    """Write train, val and test step tables per family and the blind evaluation files.

    sequences: id, family, steps (array<struct<step, mask, level>> with exact masks).
    Copies of a sequence are dropped first, so that none is in two parts.
    """
    keyed = sequences.withColumns({"names": F.transform("steps", lambda x: x["step"]), "ord": F.col("id")})
    unique = M.distinct_sequences(keyed, "names", "ord").withColumn("h", M.hash_order(seed, "id"))
    parts = cut_lineage(M.split(unique, "family", ["h", "id"], val, test))  # read once per file below
    for part in ("train", "val", "test"):
        W.write_steps(parts.filter(F.col("part") == part), f"{out}/{part}", "id", "names")

    held = parts.filter("part = 'test'")
    rows = held.select("id", "family", "names", F.explode(F.array(*map(F.lit, FRACTIONS))).alias("fraction"))
    cut = A.cut_point(F.size("names"), F.col("fraction"))
    valid = rows.select(
        F.concat_ws("_", "family", F.col("id").cast("string"), F.floor(F.col("fraction") * 100).cast("string")).alias("example_id"),
        F.col("family").alias("FAMILY"), F.col("fraction").alias("COMPLETION_FRACTION"),
        A.encode_pipe(A.head(F.col("names"), cut)).alias("PARTIAL_SEQUENCE"),
        A.encode_pipe(F.col("names")).alias("FULL_SEQUENCE"))
    W.write_blind_split(valid, f"{out}/eval_input_valid", f"{out}/eval_valid_groundtruth",
                        ["FAMILY", "COMPLETION_FRACTION", "PARTIAL_SEQUENCE"], ["FULL_SEQUENCE"])

    labelled = cut_lineage(inject.anomaly_rows(held, "family", ["id"], "steps", n_valid, n_invalid, seed))
    anomaly = labelled.select("example_id", F.col("family").alias("FAMILY"),
                              A.encode_pipe(F.transform("steps", lambda x: x["step"])).alias("SEQUENCE"),
                              F.col("is_valid").alias("IS_VALID"), F.col("rule").alias("PREDICTED_RULE"))
    W.write_blind_split(anomaly, f"{out}/eval_input_anomaly", f"{out}/eval_anomaly_labels", ["FAMILY", "SEQUENCE"],
                        ["IS_VALID", "PREDICTED_RULE"])
