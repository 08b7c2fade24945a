"""From raw documents to shards: quality, near copies, benchmark passages, source mix, placement.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read
again as the next one's docs. All but the last keep the columns of documents:

* quality: documents that the classifier scores below 0.3 go;
* near_copies: of each linked group (5-word shingles, similarity 0.8) the smallest id stays;
* decontamination: documents that hold a benchmark item, verbatim or nearly so, go;
* mixing: documents are taken as often as the source targets ask for, a row for each copy;
* sharding: every row gets the number of its shard, in the column `shard`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontamination, mixing, quality, sharding, similar_sets
from waymark.llm.queries import QUALITY_THRESHOLD, SHARDS, read
from waymark.llm.tables import written

# The rounding of the mix, the fitted classifier and the latent search have no SQL form.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar_sets.first_of_each(docs, similarity=0.8, width=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def place_on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs, SHARDS)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", place_on_shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
