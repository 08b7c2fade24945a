"""Readers of step tables, pipe tables, descriptions, batch documents and metrics.

CSV rows keep their place: the position of a row is (file, start of its split,
running number within the split), which holds for files of any size that Spark
reads in many splits. Blank cells are empty strings, never NULL.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from waymark.functions.arrays import decode_pipe
from waymark.operators.ordered import running_state, segments

PIPE_COLUMNS = ["PARTIAL_SEQUENCE", "SEQUENCE", "PREDICTED_SEQUENCE"]  # in order of preference
SINGLE_ID, UPLOAD_ID, UPLOAD_FAMILY = "seq_0001", "sequence_1", "MOSFET"
BATCH_TYPE = """batch_id string, family string, predicted_yield double, confidence double,
  risk_steps_detected int, anomalous_batches int,
  per_step array<struct<step_id:string,step_name:string,risk_score:double,confidence_lo:double,
    confidence_hi:double,shap:array<struct<feature:string,value:double,contribution:double>>>>,
  anomalies array<struct<step_id:string,anomaly_score:double,type:string>>,
  sensors map<string,double>"""


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def clean_header(name: str) -> str:
    return re.sub(r'^[﻿\s"]+|[\s"]+$', "", name).replace("‑", "-")


def read_table(spark: SparkSession, path: str, *, places: bool = False) -> DataFrame:
    """A CSV table with clean column names and cells without outer blanks and quotes.

    With places, the columns source_file, split and row tell where a row stood.
    """
    raw = spark.read.csv(path, header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=True)
    names = [clean_header(c) for c in raw.columns]
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{old}`"), r'^[\s"]+|[\s"]+$', ""), F.lit("")).alias(new)
             for old, new in zip(raw.columns, names)]
    if not places:
        return raw.select(*cells)
    return raw.select(*cells, F.col("_metadata.file_path").alias("source_file"),
                      F.col("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("row"))


def read_steps(spark: SparkSession, path: str, *, step: str = "STEP", sequence: str = "SEQUENCE_ID") -> DataFrame:
    """Long step table: source_file, sequence_id, step_index, step. Blank steps are dropped.

    Without a sequence column a file is one sequence. A missing step column is an error.
    """
    rows = read_table(spark, path, places=True)
    if step not in rows.columns:
        raise ValueError(f"no {step} column in {path}; found {', '.join(rows.columns)}")
    sid = F.col(sequence) if sequence in rows.columns else F.lit(SINGLE_ID)
    kept = rows.filter(F.col(step) != "").select("source_file", "split", "row", sid.alias("sequence_id"),
                                                 F.col(step).alias("step"))
    return running_state(kept, ["source_file", "sequence_id"], ["split", "row"]).drop("split", "row")


def read_existing_steps(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of the step tables that exist."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], "source_file string, sequence_id string, step string, step_index long")
    out = read_steps(spark, found[0])
    for path in found[1:]:
        out = out.unionByName(read_steps(spark, path))
    return out


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of the given tables that exists."""
    for path in paths:
        if exists(spark, path):
            return read_table(spark, path)
    raise FileNotFoundError(", ".join(paths))


def prefer(main: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of main, and the rows of other whose key main does not have."""
    return main.unionByName(other.join(main.select(key), key, "left_anti"), allowMissingColumns=True)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """example_id, family, segment, steps from any of the three upload layouts.

    Pipe columns win over SEQUENCE_ID + STEP, which wins over STEP alone.
    """
    rows = read_table(spark, path, places=True)
    pipe = next((c for c in PIPE_COLUMNS if c in rows.columns), None)
    if pipe:
        numbered = running_state(rows, ["source_file"], ["split", "row"], index="line")
        line = F.concat(F.lit("row_"), (F.col("line") + 1).cast("string"))
        steps = F.filter(F.transform(decode_pipe(F.col(pipe)), lambda s: F.trim(s)), lambda s: s != "")
        given = lambda name, default: F.col(name) if name in rows.columns else default
        return numbered.filter(F.col(pipe) != "").select(
            given("EXAMPLE_ID", line).alias("example_id"), given("FAMILY", F.lit(UPLOAD_FAMILY)).alias("family"),
            F.lit(0).cast("bigint").alias("segment"), steps.alias("steps"))
    if "STEP" not in rows.columns:
        raise ValueError(f"need one of {', '.join(PIPE_COLUMNS)}, SEQUENCE_ID and STEP, or STEP; "
                         f"found {', '.join(rows.columns[:6])}")
    long = read_steps(spark, path)
    sid = F.col("sequence_id") if "SEQUENCE_ID" in rows.columns else F.lit(UPLOAD_ID)
    named = long.filter(F.col("sequence_id") != "").withColumn("example_id", sid)
    return segments(named, ["source_file", "example_id"], {"step": F.col("step")}).select(
        "example_id", F.lit(UPLOAD_FAMILY).alias("family"), "segment", "steps")


def read_descriptions(spark: SparkSession, paths: Sequence[tuple[str, str]]) -> DataFrame:
    """ord, step, description, parameters, family from (family, path) pairs in order.

    Columns are found by their prefix, missing files give no rows.
    """
    out = None
    for number, (family, path) in enumerate(paths):
        if not exists(spark, path):
            continue
        rows = read_table(spark, path, places=True)
        upper = {c.upper(): c for c in rows.columns}
        if "STEP" not in upper:
            continue
        named = lambda prefix: next((F.col(f"`{c}`") for u, c in upper.items() if u.startswith(prefix)), F.lit(""))
        part = rows.filter(F.col(upper["STEP"]) != "").select(
            F.struct(F.lit(number).alias("file"), "split", "row").alias("ord"), F.col(upper["STEP"]).alias("step"),
            named("DESCRIPTION").alias("description"), named("REALISTIC").alias("parameters"),
            F.lit(family).alias("family"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "ord struct<file:int,split:bigint,row:bigint>, step string, "
                                         "description string, parameters string, family string")
    return out


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Nested batch documents, one JSON document (or array of them) per file."""
    return spark.read.schema(BATCH_TYPE).option("multiLine", True).json(path)


def read_metrics(spark: SparkSession, path: str, hybrid: str, renames: Mapping[str, str] | None = None) -> DataFrame:
    """One row of metrics as JSON texts, the hybrid metrics beside them; missing ones get defaults."""
    wanted = {"task1_nextstep": "task1_nextstep", "task2_completion": "task2_completion",
              "task3_anomaly": "task3_encoder", **(renames or {})}
    extra = {"task1_nextstep": "task1_hybrid", "task3_anomaly": "task3_hybrid"}

    def load(source: str) -> DataFrame | None:
        return spark.read.option("multiLine", True).json(source) if exists(spark, source) else None

    def pick(df: DataFrame | None, names: Mapping[str, str]) -> list:
        have = df.columns if df is not None else []
        return [(F.to_json(old) if old in have else F.lit("{}")).alias(new) for old, new in names.items()]

    one = spark.range(1).drop("id")
    main, other = load(path), load(hybrid)
    base = (main if main is not None else one)
    validity = F.col("task2_logic_validity") if main is not None and "task2_logic_validity" in main.columns else F.lit(1.0)
    left = base.select(*pick(main, wanted), validity.cast("double").alias("task2_logic_validity"), F.lit(1).alias("k"))
    right = (other if other is not None else one).select(*pick(other, extra), F.lit(1).alias("k"))
    return left.join(F.broadcast(right), "k").drop("k")  # one row on either side


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema."""
    return spark.read.schema(schema).json(path)


def read_event_stream(spark: SparkSession, folder: str, schema: str | StructType, names: str = "*.parquet",
                      files_per_trigger: int = 100) -> DataFrame:
    """Parquet files arriving in a folder (those whose name matches), as a stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", names)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
