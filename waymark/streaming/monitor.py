"""Rules and next-step candidates on streams of steps.

Event classes and levels are columns, computed before the grouping. What is left
for the keyed operator is a fold over small integers: the position, the latest
position of each enabler and the last level. Its state does not grow with the
length of a sequence; only rows still waiting for the watermark are kept, in the
state store, by cells of time. Keys are dealt by hash to buckets, which share the
calls to the state store and the timers; each key is judged by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from heapq import nlargest
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.functions.times import micros
from waymark.operators.rules import Fold, RuleBook
from waymark.session import ensure_checkpoint_dir

FOUND = "rule string, step_index long, step string, ts long, tie long, late boolean"
FOLD = "key array<string>, position array<long>, last array<array<long>>, level array<int>, newest array<long>, timer long"
WAITING = "key array<string>, ts array<long>, tie array<long>, step array<string>, mask array<int>, lvl array<int>"
BUCKETS = 1024
# Event time of the row that closes a stream which has come to its end.
FAR = "9000-01-01 00:00:00"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Monitor(StatefulProcessor):
    """The rules of a bucket of keys: a value for their folds, a map of cells of time for the steps that wait.

    A cell is read when the watermark has passed its end, so that all its steps are
    there, and by itself, so that a bucket with any number of steps needs the memory of one cell.
    """

    def __init__(self, book: RuleBook, cell: int, idle: int | None, terminal: str | None):
        self.book, self.cell, self.idle = book, cell, idle
        self.end_bit = book.bits[terminal] if terminal else 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rules = handle, Fold(self.book)
        self.state = handle.getValueState("fold", FOLD)
        self.waiting = handle.getMapState("waiting", "cell long", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, cells = timerValues.getCurrentWatermarkInMs() * 1000, []
        for batch in rows:
            old = batch["ts"] < mark
            for cell, part in batch[~old].groupby(batch["ts"] // self.cell):
                self._wait(int(cell), part)
                cells.append(int(cell))
            if old.any():
                yield self._frame([(r.key, None, None, r.step, r.ts, r.tie, True) for r in batch[old].itertuples()])
        if cells:
            folds, timer = self._folded()
            first = self._end(min(cells))
            if timer < 0 or first < timer:
                self.handle.registerTimer(first)
                self._keep(folds, first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        cells = sorted(k[0] for k in self.waiting.keys())
        due = [c for c in cells if self._end(c) <= now]
        none = (0, [-1] * len(self.rules.names), None)
        folds, _ = self._folded()
        for cell in due:
            out = []
            for own, ts, tie, step, mask, new_level in sorted(zip(*self.waiting.getValue((cell,))), key=lambda r: r[1:3]):
                position, last, level, newest = folds.get(own, (*none, -1))
                if self.idle is not None and newest >= 0 and ts - newest > self.idle:
                    position, last, level = none
                out += [(own, rule, position, step, ts, tie, False) for rule in self.rules.broken(position, last, level, mask, new_level)]
                last = [position if mask & bit else at for at, bit in zip(last, self.rules.bits)]
                level = level if new_level is None else new_level
                folds[own] = (*none, ts) if mask & self.end_bit else (position + 1, last, level, ts)
            self.waiting.removeKey((cell,))
            if out:
                yield self._frame(out)
        # steps to come are not older than the watermark, nor those that wait than their cell; a key idle by then begins anew
        left = cells[len(due):]
        coming = min(now * 1000, left[0] * self.cell) if left else now * 1000
        folds = {own: f for own, f in folds.items() if f[0] and (self.idle is None or f[3] + self.idle >= coming)}
        # one timer at a time: the end of the next cell, then the time at which a key has been idle
        if left:
            timer = self._end(left[0])
        elif self.idle is None or not folds:
            timer = -1
        else:
            timer = (min(f[3] for f in folds.values()) + self.idle) // 1000 + 1
        if timer < 0 and not folds:
            self.state.clear()
            return
        self._keep(folds, timer)
        if timer >= 0:
            self.handle.registerTimer(timer)

    def _end(self, cell: int) -> int:
        return -(-(cell + 1) * self.cell // 1000)

    def close(self) -> None:
        pass

    def _folded(self) -> tuple[dict, int]:
        """(position, latest enablers, last level, newest step) by key, and the timer."""
        if not self.state.exists():
            return {}, -1
        keys, positions, lasts, levels, newest, timer = self.state.get()
        return {k: (p, list(last), level, at) for k, p, last, level, at in zip(keys, positions, lasts, levels, newest)}, int(timer)

    def _keep(self, folds: dict, timer: int) -> None:
        columns = [list(c) for c in zip(*folds.values())] or [[], [], [], []]
        self.state.update((list(folds), *columns, timer))

    def _wait(self, cell: int, part: pd.DataFrame) -> None:
        levels = [None if pd.isna(v) else int(v) for v in part["lvl"]]
        new = [part["key"].tolist(), part["ts"].tolist(), part["tie"].tolist(), part["step"].tolist(), part["mask"].tolist(), levels]
        if self.waiting.containsKey((cell,)):
            new = [[*held, *more] for held, more in zip(self.waiting.getValue((cell,)), new)]
        self.waiting.updateValue((cell,), tuple(new))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["key", "rule", "step_index", "step", "ts", "tie", "late"])
        frame["step_index"] = frame["step_index"].astype("Int64")
        return frame


def monitor(stream: DataFrame, book: RuleBook, key: str, ts: str, tie: str, *, step: str = "step", mask=None, delay: str = "0 seconds",
            cell: str = "1 hour", idle: str | None = None, terminal: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """key, rule, step_index, step, ts, tie, late: violations as the steps arrive, and the steps that came too late.

    Steps of a key wait until the watermark, ``delay`` behind the newest step of the
    stream, has passed their cell of time, and are judged in order of (ts, tie). A step
    older than the watermark changes nothing; it is given out as late, with a null rule.
    A key's sequence begins anew after the event ``terminal``, and after a gap of more than
    ``idle`` in event time; its state goes when the watermark has passed either. Rules give
    the same violations as the batch check on the rows that aren't late. Rows at or after FAR only move the watermark.
    Keys must be the same after a cast to string and back; a task holds the steps of one cell and the folds of one of ``buckets`` at a time.
    """
    kind = stream.schema[key].dataType.simpleString()
    at = F.timestamp_micros(micros(F.col(ts), stream.schema[ts].dataType))
    marked = stream.select(F.col(key).cast("string").alias("key"), at.alias("at"), F.col(tie).cast("long").alias("tie"), F.col(step).alias("step"),
                           (book.mask(F.col(step)) if mask is None else mask).cast("int").alias("mask"), book.level_of(F.col(step)).alias("lvl"))
    # late rows have to reach the processor, so the column with the watermark is left out
    timed = marked.withWatermark("at", delay).filter(F.col("at") < F.lit(FAR).cast("timestamp")).withColumn("ts", F.unix_micros("at")).drop("at")
    micro = lambda span: int(pd.Timedelta(span).total_seconds() * 1_000_000)
    processor = _Monitor(book, micro(cell), micro(idle) if idle else None, terminal)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    found = dealt.groupBy("bucket").transformWithStateInPandas(processor, f"key string, {FOUND}", "Append", "EventTime")
    return found.select(F.col("key").cast(kind).alias(key), *[c for c in found.columns if c != "key"])


def run_monitor(stream: DataFrame, name: str, *args, **options) -> tuple[DataFrame, DataFrame]:
    """(violations, late steps) of all that a stream has now, by ``monitor``, each in a table of the shared folder.

    When the stream is read, one more row at FAR is sent through the same query: the
    watermark passes all steps, and those still waiting are judged.
    """
    spark: SparkSession = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    ts = args[2]
    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/closing")
    closing = spark.readStream.schema(stream.schema).parquet(f"{base}/closing")
    found = monitor(stream.unionByName(closing), *args, **options)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{base}/rows/batch={number}")

    def read_all() -> None:
        with _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
            (found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
             .awaitTermination())

    read_all()
    empty = [F.lit(FAR).cast("timestamp").cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]
    spark.range(1).select(*empty).write.mode("append").parquet(f"{base}/closing")
    read_all()
    out = spark.read.schema(T.StructType([f for f in found.schema if f.name != "late"] + [T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])).parquet(f"{base}/rows")
    return out.filter("NOT late").drop("late", "batch"), out.filter("late").drop("late", "batch", "rule", "step_index")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def live_contexts(stream: DataFrame, key: str, ts: str, tie: str, *, step: str = "step", n: int = 3) -> DataFrame:
    """key, seen, lag1, lag2, ...: the last n - 1 steps of every key that got new steps.

    Steps may come in any order, in any number of micro-batches; a micro-batch gives
    one row for each of its keys, and of a key's rows the one with the largest
    ``seen`` (steps so far) is the latest.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), micros(F.col(ts), stream.schema[ts].dataType).alias("ts"), F.col(tie).alias("tie"),
                         F.col(step).alias("step"))

    def remember(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, *held = state.get if state.exists else (0, [], [], [])
        last = list(zip(*held))
        for pdf in batches:
            count += len(pdf)
            last = nlargest(n - 1, [*last, *zip(pdf["ts"].tolist(), pdf["tie"].tolist(), pdf["step"].tolist())], key=lambda r: r[:2])
        state.update((count, *([list(c) for c in zip(*last)] if last else [[], [], []])))
        latest = [r[2] for r in last] + [None] * (n - 1 - len(last))
        yield pd.DataFrame([[name[0], count, *latest]], columns=[key, "seen", *[f"lag{i}" for i in range(1, n)]])

    lags = ", ".join(f"lag{i} string" for i in range(1, n))
    return rows.groupBy("key").applyInPandasWithState(remember, f"`{key}` {kind}, seen long, {lags}", "seen long, ts array<long>, tie array<long>, step array<string>",
                                                      "append", GroupStateTimeout.NoTimeout)


def live_next_steps(contexts: DataFrame, lists: DataFrame, lags: Sequence[str] = ("lag1", "lag2")) -> DataFrame:
    """Candidates for each live context: one stream-static join per context length, then the list without context."""
    found, out = [], contexts
    for k in range(len(lags), 0, -1):
        text = F.when(F.col(lags[k - 1]).isNotNull(), F.concat_ws("|", *[F.col(c) for c in reversed(lags[:k])]))
        side = lists.filter(F.col("len") == k).select(F.col("context").alias(f"__k{k}"),
                                                      F.col("candidates").alias(f"__c{k}"))
        out = out.withColumn("__t", text).join(side, F.col("__t") == F.col(f"__k{k}"), "left").drop("__t", f"__k{k}")
        found.append(F.col(f"__c{k}"))
    any_context = lists.filter(F.col("len") == 0).select("candidates").scalar()
    return out.withColumn("candidates", F.coalesce(*found, any_context)).drop(*[f"__c{k}" for k in range(1, len(lags) + 1)])


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there, append the result to files in the shared folder, and read them."""
    spark: SparkSession = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    query = (stream.writeStream.format("parquet").option("path", f"{base}/rows")
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
