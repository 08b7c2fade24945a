"""Statistics mined from sequences: n-grams, grammar, vocabulary, buckets, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.operators.ordered import running_state
from waymark.rulesets.fabrication import SPECIAL_TOKENS
from waymark.session import cut_lineage, small

SEP = "|"


# -- n-grams ---------------------------------------------------------------------

def contexts(lags: Sequence[Column]) -> Column:
    """array<struct<len, context>> for all context lengths, given lags 1, 2, ...

    The context of length 0 is the empty string (unigrams).
    """
    out = [F.struct(F.lit(0).alias("len"), F.lit("").alias("context"))]
    for k in range(1, len(lags) + 1):
        text = F.concat_ws(SEP, *reversed(lags[:k]))
        out.append(F.when(lags[k - 1].isNotNull(), F.struct(F.lit(k).alias("len"), text.alias("context"))))
    return F.array_compact(F.array(*out))


def with_lags(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 3, step: str = "step",
              hot_rows: int | None = None) -> DataFrame:
    return running_state(df, keys, order, hot_rows=hot_rows,
                         lags={f"lag{k}": (F.col(step), k) for k in range(1, n)})


def ngram_counts(lagged: DataFrame, keys: Sequence[str], n: int = 3, step: str = "step") -> DataFrame:
    """Counts of each next step after each context of 0 to n-1 steps.

    first_seen is the earliest (sequence, position); it breaks ties later on.
    """
    ctx = contexts([F.col(f"lag{k}") for k in range(1, n)])
    rows = lagged.select(F.explode(ctx).alias("c"), F.col(step).alias("next"),
                         F.struct(*keys, "step_index").alias("seen"))
    return rows.groupBy("c.len", "c.context", "next").agg(F.count(F.lit(1)).alias("cnt"),
                                                          F.min("seen").alias("first_seen"))


def ranked_next(counts: DataFrame, k: int | None = None) -> DataFrame:
    """Successors of each context by count, ties by first occurrence.

    With k, Spark keeps only k rows per context before the shuffle. Without k
    the successors of one context are bounded by the vocabulary.
    """
    order = Window.partitionBy("len", "context").orderBy(F.col("cnt").desc(), "first_seen")
    out = counts.withColumn("rank", F.row_number().over(order))
    return out.filter(F.col("rank") <= k) if k else out


def candidate_lists(counts: DataFrame, k: int | None = None) -> DataFrame:
    """One row per context: its k best (or all) successors with their share, in order.

    counts is read twice (ranking and totals), so callers write it once.
    """
    totals = counts.groupBy("len", "context").agg(F.sum("cnt").alias("total"))
    top = ranked_next(counts, k).join(totals, ["len", "context"])
    item = F.struct("rank", "next", (F.col("cnt") / F.col("total")).alias("p"))
    return top.groupBy("len", "context").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def back_off(prefixes: DataFrame, lists: DataFrame, lags: Sequence[str], out: str = "candidates") -> DataFrame:
    """The candidates of the longest context of each prefix that was ever seen.

    prefixes carries its last steps, latest first, in the columns named by lags.
    One join per context length; the unigram list is a single row.
    """
    found = []
    for k in range(len(lags), 0, -1):
        name = f"__cand{k}"
        text = F.when(F.col(lags[k - 1]).isNotNull(), F.concat_ws(SEP, *[F.col(c) for c in reversed(lags[:k])]))
        side = lists.filter(F.col("len") == k).select(F.col("context").alias(f"__ctx{k}"),
                                                      F.col("candidates").alias(name))
        prefixes = (prefixes.withColumn("__key", text)
                    .join(side, F.col("__key") == F.col(f"__ctx{k}"), "left").drop("__key", f"__ctx{k}"))
        found.append(name)
    unigrams = lists.filter(F.col("len") == 0).select("candidates").scalar()
    return prefixes.withColumn(out, F.coalesce(*found, unigrams)).drop(*found)


# -- likelihood -------------------------------------------------------------------------

def sequence_nll(lagged: DataFrame, counts: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Mean negative log-likelihood per sequence under add-one bigrams.

    counts is read three times, so callers write it once.
    """
    pairs = counts.filter(F.col("len") == 1).select(F.col("context").alias("lag1"), F.col("next").alias(step), "cnt")
    totals = pairs.groupBy("lag1").agg(F.sum("cnt").alias("total"))
    size = counts.filter(F.col("len") == 0).agg(F.count(F.lit(1)).alias("v")).scalar()
    p = (F.coalesce("cnt", F.lit(0)) + 1) / (F.coalesce("total", F.lit(0)) + size)
    # counted per distinct pair first: one row per sequence and pair joins the model
    seen = (lagged.filter(F.col("lag1").isNotNull()).groupBy(*keys, "lag1", step)
            .agg(F.count(F.lit(1)).alias("times")))
    # the model is broadcast where it is seen to be small, so a frequent pair meets in no task
    scored = seen.join(small(pairs), ["lag1", step], "left").join(small(totals), "lag1", "left")
    return scored.groupBy(*keys).agg((-F.sum(F.log(p) * F.col("times")) / F.sum("times")).alias("nll"))


def order_statistic(df: DataFrame, value: str, quantile: float, hot_rows: int | None = None) -> DataFrame:
    """sorted[min(n - 1, int(q * n))], exactly; not interpolated."""
    counted = cut_lineage(df.groupBy(F.lit(0).alias("__all"), F.col(value).alias("value"))
                          .agg(F.count(F.lit(1)).alias("cnt")))
    ranked = running_state(counted, ["__all"], ["value"], sums={"below": F.col("cnt")}, hot_rows=hot_rows)
    n = counted.agg(F.sum("cnt")).scalar()
    at = F.least(n - 1, F.floor(F.lit(float(quantile)) * n))
    return ranked.filter((at >= F.col("below")) & (at < F.col("below") + F.col("cnt"))).select(
        F.col("value").alias("threshold"))


def p_valid(score: Column, threshold: Column) -> Column:
    return 1 / (1 + F.exp(score - threshold))


# -- grammar and vocabulary ------------------------------------------------------------------

def transitions(lagged: DataFrame, kind: str = "step") -> DataFrame:
    """The set of (from, to) pairs that occur next to each other."""
    return lagged.filter(F.col("lag1").isNotNull()).select(
        F.col("lag1").alias("from_kind"), F.col(kind).alias("to_kind")).distinct()


def vocabulary(steps: DataFrame, step: str = "step", specials: Sequence[str] = SPECIAL_TOKENS,
               hot_rows: int | None = None) -> DataFrame:
    """Distinct tokens with dense ids: the specials first, then the steps in order."""
    tokens = steps.select(F.translate(F.trim(F.col(step)), " ", "_").alias("token")).distinct()
    tokens = tokens.filter(~F.col("token").isin(list(specials))).withColumn("__all", F.lit(0))
    numbered = running_state(tokens, ["__all"], ["token"], hot_rows=hot_rows)
    first = steps.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id long")
    return first.unionByName(numbered.select("token", (F.col("step_index") + len(specials)).alias("id")))


def distinct_sequences(df: DataFrame, steps: str, row_order: str) -> DataFrame:
    """The first row of each distinct array of steps.

    Grouping is by a 128-bit digest of the steps, so keys stay short; copies
    combine on the map side, however many there are.
    """
    kept = [c for c in df.columns if c != row_order]
    return (df.groupBy(F.md5(F.array_join(steps, SEP)).alias("__key"))
            .agg(F.min_by(F.struct(*kept), F.col(row_order)).alias("r"), F.count(F.lit(1)).alias("copies"))
            .select("r.*", "copies"))


def bucket_weights(lengths: DataFrame, length: str, buckets: int = 8) -> DataFrame:
    """Sampling weight of each row so that every occupied length bucket has the same mass.

    The lengths are needed for their range, the bucket sizes and the rows, so the
    table (one row per sequence) is written once.
    """
    lengths = cut_lineage(lengths)
    low = lengths.agg(F.min(length)).scalar()
    high = lengths.agg(F.max(length)).scalar()
    span = F.greatest(F.lit(1), high - low)
    number = F.least(F.lit(buckets - 1), F.floor((F.col(length) - low) * buckets / span))
    rows = lengths.withColumn("bucket", number.cast("bigint"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"))  # at most `buckets` rows
    active = sizes.agg(F.count(F.lit(1))).scalar()
    return (rows.join(F.broadcast(sizes), "bucket")
            .withColumn("weight", 1.0 / (F.col("in_bucket") * active)))


# -- sampling -----------------------------------------------------------------------------------

def hash_order(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def split(df: DataFrame, group: str, order: Sequence[str], val: float = 0.1, test: float = 0.1,
          hot_rows: int | None = None) -> DataFrame:
    """train / val / test per group with exact counts (half rounds to even).

    order is the shuffled order, for example a hash of id and seed.
    """
    ranked = running_state(df, [group], order, index="__rank", total="__n", hot_rows=hot_rows)
    n_test, n_val = F.bround(F.col("__n") * F.lit(test)), F.bround(F.col("__n") * F.lit(val))
    part = (F.when(F.col("__rank") < n_test, "test").when(F.col("__rank") < n_test + n_val, "val")
            .otherwise("train"))
    return ranked.withColumn("part", part).drop("__rank", "__n")


def strided(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, index: str = "i", hot_rows: int | None = None) -> DataFrame:
    """n rows of each key at equal distances, from the first on; all of them where there are fewer."""
    placed = running_state(df, keys, order, index=index, total="__n", hot_rows=hot_rows)
    stride = F.greatest(F.lit(1), F.floor(F.col("__n") / n))
    return placed.filter((F.col(index) % stride == 0) & (F.col(index) < stride * n)).drop("__n")


def holdout_examples(df: DataFrame, holdout: str, fraction: float, *, held_out: bool = False,
                     first: int | None = None, order: str | None = None) -> DataFrame:
    """Cut every sequence (family, steps) of the other families, or of the held-out one, at a fraction.

    Sequences with nothing behind the cut are left out. ``first`` takes that many
    sequences in the given order, as a small probe set.
    """
    rows = df.filter((F.col("family") == holdout) if held_out else (F.col("family") != holdout))
    if first is not None:
        rows = rows.orderBy(order).limit(first)
    cut = F.greatest(F.lit(1), F.floor(F.size("steps") * F.lit(float(fraction)))).cast("int")
    return rows.withColumn("cut", cut).filter(F.col("cut") < F.size("steps"))


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int,
                    hot_rows: int | None = None) -> DataFrame:
    """n draws with replacement, each key with probability proportional to its weight.

    Draws are uniform numbers from digests, placed on the line of running weights; each
    takes the key whose stretch it falls into (an as-of lookup in one scan).
    """
    items = cut_lineage(df.filter(F.col(weight) > 0).select(F.lit(0).alias("__all"), F.col(key).alias("key"),
                                                            F.col(weight).alias("w")))
    line = running_state(items, ["__all"], ["key"], sums={"start": F.col("w")}, hot_rows=hot_rows)
    total = items.agg(F.sum("w")).scalar()
    draws = df.sparkSession.range(n).select(
        F.lit(0).alias("__all"), F.col("id").alias("draw"),
        (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 13), 16, 10).cast("bigint") / float(1 << 52) * total).alias("at"))
    both = line.select("__all", F.col("start").alias("at"), "key", F.lit(None).cast("long").alias("draw"),
                       F.lit(0).alias("kind")).unionByName(
        draws.withColumn("kind", F.lit(1)).withColumn("key", F.lit(None).cast(df.schema[key].dataType)))
    placed = running_state(both, ["__all"], ["at", "kind"], hot_rows=hot_rows,
                           values={"picked": (F.col("kind") == 0, F.col("key"))})
    return placed.filter(F.col("kind") == 1).select("draw", F.col("picked").alias(key))
