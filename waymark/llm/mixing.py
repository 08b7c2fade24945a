"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is r times its size wants each of its documents r times: whole
copies first, then a fraction that is rounded dependently. Two documents of a source
at a time move mass, in words, from one to the other until one of them wants a whole
copy or none; the direction is random, with odds that keep each document's expected
copies. So a source's words are kept to within one document, whatever was drawn.

Documents are folded in chunks of a bounded number; each chunk leaves one fractional
document, and these residuals are folded again, level by level: a reduction tree that
never puts a large source into one task. All of it is DataFrame functions.

Null text has size 0, as has a text without words; such documents are taken 0 times,
as they hold no words. Null is a source of its own. Rows that agree in id, source and
size are rounded as one unit and share its copies evenly, so repeated rows give the
same result in any order. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.tables import WORD, fresh, lookup, uniform, written

CHUNK = 64
UNIT = "struct<doc_id:{id},size:bigint,n:bigint,whole:bigint,p:double,done:boolean>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets of a table (source, source_size, ...) of one row per source.

    Sources by code point, null last, weigh as the list says, repeating. A source that
    would go above `most` times its size stops there; the excess is shared by weight
    among the rest, until none is above. In order of size over weight the stopped
    sources come first, so running sums find them without a loop.
    """
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    rank = F.row_number().over(by_name)
    cap = F.lit(float(most)) * F.col("source_size")
    ranked = sizes.withColumn("rank", rank).withColumn("cap", cap).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    stopped = ranked.withColumn("stops", F.col("cap") / F.col("weight") * left_weight <= left)
    rest = F.sum("source_size").over(everything) - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    rest_weight = F.sum(F.when(F.col("stops"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * rest / F.nullif(rest_weight, F.lit(0.0)))
    return stopped.withColumn("target", share).drop("rank", "cap", "weight", "stops")


def _pair(state: Column, b: Column, seed: int, level: int) -> Column:
    """Fold b into the state: one of the open unit and b becomes whole and is put away, the other stays open."""
    a = state["open"]
    mass_a, mass_b = a["size"] * a["p"], b["size"] * b["p"]
    room_a, room_b = a["size"] - mass_a, b["size"] - mass_b
    up, down = F.least(room_a, mass_b), F.least(mass_a, room_b)
    raised = uniform(F.lit(seed), F.lit(level), a["doc_id"], a["size"], b["doc_id"], b["size"]) * (up + down) < down

    def whole(unit: Column, copies: int) -> Column:
        return unit.withField("p", F.lit(float(copies))).withField("done", F.lit(True))

    def still(unit: Column, mass: Column) -> Column:
        return unit.withField("p", F.least(F.greatest(mass / unit["size"], F.lit(0.0)), F.lit(1.0)))

    def step(put_away: Column, open_unit: Column) -> Column:
        return F.struct(F.concat(state["away"], F.array(put_away)).alias("away"), open_unit.alias("open"))

    return (F.when(a.isNull(), F.struct(state["away"].alias("away"), b.alias("open")))
            .when(raised & (room_a <= mass_b), step(whole(a, 1), still(b, mass_b - room_a)))
            .when(raised, step(whole(b, 0), still(a, mass_a + mass_b)))
            .when(mass_a <= room_b, step(whole(a, 0), still(b, mass_a + mass_b)))
            .otherwise(step(whole(b, 1), still(a, mass_a - room_b))))


def _level(units: DataFrame, chunks: Column, kind: str, seed: int, level: int, name: str) -> DataFrame:
    """Fold each chunk of a source: all units come back, one of each chunk still open."""
    unit = F.struct("doc_id", "size", "n", "whole", "p", "done")
    start = F.struct(F.array().cast(f"array<{UNIT.format(id=kind)}>").alias("away"), F.lit(None).cast(UNIT.format(id=kind)).alias("open"))
    folded = (units.groupBy("source", "units", F.pmod(F.xxhash64(F.lit(level), F.col("doc_id"), F.col("size")), chunks).alias("chunk"))
              .agg(F.sort_array(F.collect_list(unit)).alias("all"))
              .select("source", "units", F.explode(F.aggregate("all", start, lambda s, b: _pair(s, b, seed, level),
                                                      lambda s: F.concat(s["away"], F.array(s["open"])))).alias("u")))
    return written(folded.select("source", "units", "u.*"), name)


def copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, source, size, n, source_size, target, copies): n equal rows are taken `copies` times in all."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size"))
    units = written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    aims = written(targets(sizes, weights, most), "mix-targets")
    aimed = units.join(lookup(aims.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    wanted = F.when(F.col("size") > 0, F.col("n") * F.col("target") / F.col("source_size")).otherwise(0.0)
    started = (aimed.withColumn("whole", F.floor(wanted).cast("long")).withColumn("p", wanted - F.floor(wanted))
               .withColumn("done", F.col("p") == 0).select("source", "doc_id", "size", "n", "whole", "p", "done", "units"))
    largest, level = aims.agg(F.max("units")).first()[0] or 0, 0
    settled, is_open = [started.filter("done").drop("units")], started.filter("NOT done")
    while chunk ** level < largest:
        chunks = F.ceil(F.col("units") / F.lit(float(chunk) ** (level + 1))).cast("long")
        folded = _level(is_open, chunks, kind, seed, level, f"mix-level{level}")
        settled.append(folded.filter("done").drop("units"))
        is_open, level = folded.filter("NOT done"), level + 1
    last = is_open.drop("units").withColumn("p", (uniform(F.lit(seed), F.lit(-1), F.col("doc_id"), F.col("size")) < F.col("p")).cast("double"))
    rounded = reduce(DataFrame.unionByName, [*settled, last])
    return (rounded.join(lookup(aims.drop("units").withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies")))


def _share(index: Column) -> Column:
    """Copies of the index-th of n equal rows."""
    return F.floor(F.col("copies") / F.col("n")).cast("long") + (index <= F.col("copies") % F.col("n")).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    each = copies(docs, **options).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return each.select("doc_id", "size", "source_size", "target", (_share(F.col("i")) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with the columns of docs."""
    taken = copies(docs, doc_id=doc_id, source=source, text=text, **options).filter("copies > 0")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    row, size, unit = (fresh(docs.columns, c) for c in ("mix_row", "mix_size", "mix_unit"))
    left = docs.withColumn(size, words(F.col(f"`{text}`")))
    right = taken.select(F.struct("doc_id", "source", "size", "n", "copies").alias(unit))
    joined = left.join(right, F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{unit}.doc_id")) & F.col(f"`{source}`").eqNullSafe(F.col(f"{unit}.source"))
                       & (F.col(size) == F.col(f"{unit}.size")))
    equal = Window.partitionBy(f"{unit}.doc_id", f"{unit}.source", f"{unit}.size").orderBy(F.xxhash64(*kept))
    numbered = joined.withColumn(row, F.row_number().over(equal))
    n, all_copies = F.col(f"{unit}.n"), F.col(f"{unit}.copies")
    times = (F.floor(all_copies / n) + (F.col(row) <= all_copies % n).cast("long")).cast("int")
    again = fresh(docs.columns, "mix_again")
    return numbered.select(*kept, F.explode(F.array_repeat(F.lit(True), times)).alias(again)).drop(again)
