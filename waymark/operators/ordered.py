"""Running state over ordered rows.

Every rule, n-gram and prefix operator needs "what happened before this row" per
sequence. For ordinary sequences that is one window. A sequence too long for one
task is cut into chunks along its order; each chunk is scanned by itself and the
state it starts with comes from one summary row per chunk. All pieces of state
(latest index, latest value, sums, short tails) combine exactly, so the result
does not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT_ROWS = 5_000_000      # sequences with more rows than this are cut
MAX_CHUNKS = 50_000       # bound on chunks over all cut sequences
SAMPLES = 64              # rows of the sketch for each chunk
# Steps that one array row holds; far above any sequence that fits a task, so one row is one sequence.
MAX_LEN = 32_768

CHUNK = "__chunk"


def running_state(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    last: Mapping[str, Column] | None = None,
    values: Mapping[str, tuple[Column, Column]] | None = None,
    sums: Mapping[str, Column] | None = None,
    lags: Mapping[str, tuple[Column, int]] | None = None,
    index: str = "step_index",
    total: str | None = None,
    reverse: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add, per row, the state left by the earlier rows of its sequence.

    index   0-based position in the sequence (BIGINT)
    last    name -> condition: position of the latest earlier row meeting it
    values  name -> (condition, value): non-null value at the latest such row
    sums    name -> number: its sum over the earlier rows
    lags    name -> (value, k): the value k rows earlier
    total   name of a column for the length of the sequence

    With ``reverse`` the rows are numbered from the end, so that "earlier" means
    later; ``index - last`` is then the distance to the next such row.
    """
    spec = _Spec(dict(last or {}), dict(values or {}), dict(sums or {}), dict(lags or {}),
                 index, total)
    keys, order = list(keys), list(order)
    hot = _hot_sequences(df, keys, hot_rows or HOT_ROWS)
    if hot is None:
        return _scan(df, keys, order, reverse, spec)
    names = F.broadcast(hot.select(*keys))
    cold = _scan(df.join(names, keys, "left_anti"), keys, order, reverse, spec)
    cut = _assign_chunks(df, hot, keys, order, reverse)
    return cold.unionByName(_scan_chunks(cut, keys, order, reverse, spec))


class _Spec:
    def __init__(self, last, values, sums, lags, index, total):
        self.last, self.values, self.sums, self.lags = last, values, sums, lags
        self.index, self.total = index, total


def _sort_columns(order: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc() if reverse else F.col(c).asc() for c in order]


def _scan(df, keys, order, reverse, spec: _Spec) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*_sort_columns(order, reverse))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn(spec.index, (F.row_number().over(window) - 1).cast("bigint"))
    state: dict[str, Column] = {}
    for name, condition in spec.last.items():
        state[name] = F.max(F.when(condition, F.col(spec.index))).over(before)
    for name, (condition, value) in spec.values.items():
        state[name] = F.last(F.when(condition, value), ignorenulls=True).over(before)
    for name, number in spec.sums.items():
        state[name] = F.coalesce(F.sum(number).over(before), F.lit(0))
    for name, (value, k) in spec.lags.items():
        state[name] = F.lag(value, k).over(window)
    if spec.total:
        state[spec.total] = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return numbered.withColumns(state) if state else numbered


# -- sequences too long for one task ------------------------------------------

def _hot_sequences(df, keys, hot_rows) -> DataFrame | None:
    """The sequences longer than hot_rows with their size and number of chunks, or None.

    At most total / hot_rows sequences can be returned, and hot_rows grows with
    the table so that the number of chunks stays below MAX_CHUNKS.
    """
    narrow = df.select(*keys)
    rows = narrow.count()
    limit = max(hot_rows, rows // MAX_CHUNKS)
    if rows <= limit:
        return None
    hot = (narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
           .withColumn("__chunks", F.ceil(F.col("__n") * 2 / F.lit(limit))))
    found = hot.collect()  # bounded by total / limit <= MAX_CHUNKS rows
    if not found:
        return None
    return df.sparkSession.createDataFrame(found, hot.schema)


def _cuts(rows: DataFrame, keys, order) -> DataFrame:
    """keys, __cuts: for each hot sequence the places at which it is cut, in runs of about the root of their number.

    The places are quantiles of a sketch: the rows whose hash is small enough, SAMPLES
    for each chunk on average, taken by the whole order and not by its first column
    alone, so outliers and long common prefixes make no difference. The size of a chunk
    between two cuts is off by a factor of 1 +- 4 / sqrt(SAMPLES) with a chance below one
    in ten thousand; results are exact wherever the cuts fall.
    """
    chance = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 40)) / float(1 << 40)
    taken = rows.filter(chance * F.col("__n") < F.col("__chunks") * SAMPLES).select(*keys, "__chunks", F.struct(*order).alias("__at"))
    line = Window.partitionBy(*keys)  # at most SAMPLES * MAX_CHUNKS rows over all hot sequences
    placed = taken.withColumns({"__r": F.row_number().over(line.orderBy("__at")) - 1, "__m": F.count(F.lit(1)).over(line)})
    number = F.floor(F.col("__r") * F.col("__chunks") / F.col("__m"))
    before = F.floor((F.col("__r") - 1) * F.col("__chunks") / F.col("__m"))
    points = placed.filter((F.col("__r") > 0) & (number > before))
    sets = points.groupBy(*keys).agg(F.array_sort(F.collect_set("__at")).alias("__points"), F.first("__chunks").alias("__chunks"))
    run = F.ceil(F.sqrt(F.size("__points"))).cast("int")
    runs = F.transform(F.sequence(F.lit(1), F.size("__points"), run), lambda i: F.slice("__points", i, run))
    return sets.select(*keys, runs.alias("__cuts"), run.alias("__run"))


def _assign_chunks(df, hot, keys, order, reverse) -> DataFrame:
    """Cut each hot sequence into chunks of similar size along its order.

    Rows of equal order share a chunk, so the order between chunks is the order of
    the rows. A row's chunk is the number of cuts up to it: whole runs by their first
    cut, then the cuts of one run.
    """
    rows = df.join(F.broadcast(hot), keys)
    cuts = _cuts(rows, keys, order)
    at = F.struct(*order)
    run = F.size(F.filter("__cuts", lambda r: r[0] <= at))
    inside = F.size(F.filter(F.get("__cuts", run - 1), lambda c: c <= at))
    number = F.when(run > 0, (run - 1) * F.col("__run") + inside).otherwise(0).cast("bigint")
    number = F.coalesce(number, F.lit(0).cast("bigint"))
    joined = rows.join(F.broadcast(cuts), keys, "left")
    return joined.withColumn(CHUNK, -number if reverse else number).drop("__n", "__chunks", "__cuts", "__run")


def _scan_chunks(df, keys, order, reverse, spec: _Spec) -> DataFrame:
    part = [*keys, CHUNK]
    tails = {f"__lag_{name}_{j}": (value, j) for name, (value, k) in spec.lags.items() for j in range(1, k + 1)}
    inner = _Spec({f"__{n}": c for n, c in spec.last.items()},
                  {f"__{n}": c for n, c in spec.values.items()},
                  {f"__{n}": c for n, c in spec.sums.items()}, tails, "__i", None)
    local = _scan(df, part, order, reverse, inner)

    pieces = [F.count(F.lit(1)).alias("__rows")]
    pieces += [F.max(F.when(c, F.col("__i"))).alias(f"__s_{n}") for n, c in spec.last.items()]
    pieces += [F.max(F.when(c & v.isNotNull(), F.struct(F.col("__i").alias("i"), v.alias("v")))).alias(f"__s_{n}")
               for n, (c, v) in spec.values.items()]
    pieces += [F.sum(c).alias(f"__s_{n}") for n, c in spec.sums.items()]
    for n, (v, k) in spec.lags.items():
        ending = F.array(*[F.col(f"__lag_{n}_{j}") for j in range(k - 1, 0, -1)], v)
        pieces.append(F.max(F.struct(F.col("__i").alias("i"), ending.alias("v"))).alias(f"__s_{n}"))
    summary = local.groupBy(*part).agg(*pieces)

    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__off", F.coalesce(F.sum("__rows").over(before), F.lit(0).cast("bigint")))
    carry = [F.col(c) for c in part] + [F.col("__off")]
    for n in spec.last:
        carry.append(F.max(F.col("__off") + F.col(f"__s_{n}")).over(before).alias(f"__c_{n}"))
    for n in spec.values:
        carry.append(F.max(F.when(F.col(f"__s_{n}").isNotNull(),
                                  F.struct((F.col("__off") + F.col(f"__s_{n}.i")).alias("i"),
                                           F.col(f"__s_{n}.v").alias("v")))).over(before)["v"].alias(f"__c_{n}"))
    for n in spec.sums:
        carry.append(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}"))
    for n, (_, k) in spec.lags.items():
        size = F.least(F.col("__rows"), F.lit(k)).cast("int")
        own = F.slice(F.col(f"__s_{n}.v"), -size, size)
        # every chunk has a row, so the k chunks before this one hold k rows
        carry.append(F.flatten(F.collect_list(own).over(chunks.rowsBetween(-k, -1))).alias(f"__c_{n}"))
    if spec.total:
        carry.append(F.sum("__rows").over(Window.partitionBy(*keys)).alias(spec.total))
    starts = summary.select(*carry)

    joined = local.join(F.broadcast(starts), part)  # one row per chunk, bounded by MAX_CHUNKS
    state: dict[str, Column] = {spec.index: F.col("__off") + F.col("__i")}
    for n in spec.last:
        state[n] = F.coalesce(F.col("__off") + F.col(f"__{n}"), F.col(f"__c_{n}"))
    for n in spec.values:
        state[n] = F.coalesce(F.col(f"__{n}"), F.col(f"__c_{n}"))
    for n in spec.sums:
        state[n] = F.col(f"__{n}") + F.col(f"__c_{n}")
    for n, (_, k) in spec.lags.items():
        back = (F.lit(k) - F.col("__i")).cast("int")
        state[n] = (F.when(F.col("__i") >= k, F.col(f"__lag_{n}_{k}"))
                    .when(back > 0, F.try_element_at(F.col(f"__c_{n}"), -back)))
    kept = [c for c in df.columns if c != CHUNK]
    extra = [spec.total] if spec.total else []
    return joined.withColumns(state).select(*kept, *state, *extra)


def segments(df: DataFrame, keys: Sequence[str], fields: Mapping[str, Column], *,
             index: str = "step_index", max_len: int = MAX_LEN, segment: str = "segment",
             steps: str = "steps") -> DataFrame:
    """Array form: one row per sequence and run of max_len positions.

    Arrays are bounded by max_len, so no group grows with the table; a sequence
    of at most max_len steps is one row with segment 0.
    """
    number = F.floor(F.col(index) / max_len).cast("bigint")
    item = F.struct(F.col(index).alias("i"), *[c.alias(n) for n, c in fields.items()])
    ordered = F.array_sort(F.collect_list(item))
    if len(fields) == 1:
        name = next(iter(fields))
        arrays = F.transform(ordered, lambda x: x[name])
    else:
        arrays = F.transform(ordered, lambda x: F.struct(*[x[n].alias(n) for n in fields]))
    return df.groupBy(*keys, number.alias(segment)).agg(arrays.alias(steps))
