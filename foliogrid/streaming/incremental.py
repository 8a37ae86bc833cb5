"""Structured Streaming variants of admission, error counts, cache filling and edit logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliogrid.functions.storage import shared_dir
from foliogrid.operators.gates import Rule, intake


#: Which state store a stream uses; values by key with a time to live need one that is not in memory.
STORE = "spark.sql.streaming.stateStore.providerClass"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, a few new files at a time.

    The path is a pattern, so that a table that is a single file can be a stream as well.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _run(stream: DataFrame, mode: str, write) -> None:
    """Work off what is there, exactly once, with state and progress in the shared folder."""
    where = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def _gathered(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Rows that a stream gives: those of its last batch in complete mode, of all batches in append and update mode.

    Every batch has a path of its own, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")
        seen.append(number)

    _run(stream, mode, write)
    paths = [f"{base}/batch={n}" for n in (seen[-1:] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)


def incremental_intake(stream: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """Gate of arriving records: ``key`` and the first rule that each breaks; earlier results never move."""
    return _gathered(intake(stream, rules).select(key, "check_no", "category"), "append", "admitted")


def running_error_counts(stream: DataFrame, categories: DataFrame) -> DataFrame:
    """Dense count of error categories after all that has arrived."""
    counts = _gathered(stream.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "complete", "errors")
    return categories.join(counts, "category", "left").fillna(0, ["n"])


class _FirstWrite(StatefulProcessor):
    """Keeps the value of least sequence of a key, and tells it whenever it changes; state goes once the watermark is past it."""

    def __init__(self, kinds: dict, hold_ms: int | None):
        self.kinds, self.hold_ms = kinds, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [T.StructField("seq", self.kinds["seq"]), T.StructField("value", self.kinds["value"]), T.StructField("until", T.LongType())]
        self.handle, self.first = handle, handle.getValueState("first", T.StructType(fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, value, until = tuple(self.first.get()) if self.first.exists() else (None, None, 0)
        best = held = None if seq is None else (seq, value)
        for batch in rows:
            for new in zip(batch["seq"].tolist(), batch["value"].tolist(), strict=True):
                best = new if best is None or new < best else best
            if self.hold_ms is not None:
                until = max(until, int(batch["time"].max().timestamp() * 1000) + self.hold_ms)
        self.first.update((*best, until))
        if self.hold_ms is not None:
            self.handle.registerTimer(until)
        if best != held:
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "value": [best[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a key that was written again since has a later timer
        if self.first.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.first.get()[2]:
            self.first.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def first_writes(stream: DataFrame, key: str, seq: str, value: str, time: str | None = None, hold: timedelta | None = None) -> DataFrame:
    """``key, value``: of every key the value of least ``seq``, whatever the batches that it arrived in.

    The state of a key is one value. If ``time`` and ``hold`` are given, it is deleted once the stream is ``hold`` past
    the key's last row: a key that comes back then counts if its sequence is smaller than what was told before. Rows
    later than twice ``hold`` are dropped, as are rows with a null in any of the columns.
    """
    spark = stream.sparkSession
    named = {"key": F.col(key), "seq": F.col(seq), "value": F.col(value)} | ({"time": F.col(time).cast("timestamp")} if time else {})
    rows = stream.select(*(c.alias(n) for n, c in named.items())).dropna()
    if time:
        rows = rows.withWatermark("time", f"{2 * int(hold.total_seconds())} seconds")
    kinds = {c: rows.schema[c].dataType for c in ("key", "seq", "value")}
    keeper = _FirstWrite(kinds, int(hold.total_seconds() * 1000) if time else None)
    told = rows.groupBy("key").transformWithStateInPandas(keeper, outputStructType=T.StructType([T.StructField(c, k) for c, k in kinds.items()]), outputMode="Update", timeMode="EventTime" if time else "None")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = _gathered(told, "update", "cache")
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    return changes.groupBy("key").agg(F.min(F.struct("seq", "value")).alias("f")).select(F.col("key").alias(key), F.col("f.value").alias(value))


def cache_fill(results: DataFrame, cache: DataFrame, secret: str | None = None) -> DataFrame:
    """A cache ``cache_key, translated`` with the first good answer of each new key of a stream of results.

    Results are ``cache_key, seq, result, result_status``; failures and answers with the secret stay out, and keys that
    the cache holds keep their value.
    """
    good = results.filter("result_status = 'ok'")
    if secret:
        good = good.filter(~F.contains("result", F.lit(secret)))
    fresh = good.join(cache.select("cache_key"), "cache_key", "left_anti")
    new = first_writes(fresh.select("cache_key", "seq", F.col("result").alias("translated")), "cache_key", "seq", "translated")
    return cache.select("cache_key", "translated").union(new)


def latest_edits_stream(stream: DataFrame) -> DataFrame:
    """The last live edit of every region after all that has arrived."""
    live = stream.filter("NOT invalidated").groupBy("region").agg(F.max_by("edited", "seq").alias("edited"))
    return _gathered(live, "complete", "edits")


def windowed_errors(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Errors per category and tumbling window; a window is given once the watermark has passed its end."""
    timed = stream.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    counts = timed.groupBy(F.window("at", width), "category").agg(F.count(F.lit(1)).alias("n"))
    return _gathered(counts.select(F.col("window.start").alias("start"), "category", "n"), "append", "windows")
