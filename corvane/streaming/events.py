"""Streams over audit events, uploads and reviews.

State is bounded where a lateness is given: event counts always, first uploads and the rolling limit with ``late``. Without it these two keep every key
for ever, which is exact and grows with the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.functions.instants import instant


def read_stream(spark: SparkSession, folder: str, schema: str | T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def event_counts(events: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Events per window and type; rows later than ``late`` are dropped with the state of their window."""
    e = events.withColumn("at", instant(F.col("created_at"))).withWatermark("at", late)
    return e.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event_type", "n")


def first_uploads(uploads: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """Each source key once. Without ``late`` the state is unbounded and exact; with it, replays later than that come again."""
    if late is None:
        return uploads.dropDuplicates(keys)
    return uploads.withColumn("at", instant(F.col("created_at"))).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def request_counts(log: DataFrame) -> DataFrame:
    """Requests per method, route and status, with their seconds."""
    return log.groupBy("method", "route", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))


def admit(events: DataFrame, key: str, at: str, seconds: int = 60, most: int = 6) -> DataFrame:
    """Exact rolling limit per key: an event is admitted if fewer than ``most`` admitted ones lie in the ``seconds`` before it.

    The state of a key is the times of at most ``most`` admitted events; it is kept for every key seen. A null key is the text None.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        ok = []
        for t in rows["at"].tolist():
            times = [x for x in times if x > t - seconds]
            ok.append(len(times) < most)
            if ok[-1]:
                times.append(t)
        state.update((times,))
        yield pd.DataFrame({"key": [str(k[0])] * len(rows), "at": rows["at"].to_numpy(), "admitted": ok})

    secs = events.select(F.col(key).cast("string").alias("key"), F.unix_seconds(F.col(at).cast("timestamp")).alias("at"))
    return secs.groupBy("key").applyInPandasWithState(step, "key string, at bigint, admitted boolean", "times array<bigint>", "append", GroupStateTimeout.NoTimeout)


def admit_bounded(events: DataFrame, key: str, at: str, seconds: int = 60, most: int = 6, late: str = "10 minutes") -> DataFrame:
    """``admit`` whose state goes: a key's times are dropped when the watermark is past the last of them by ``seconds``, and rows later than ``late`` are left out.

    A null key is a key of its own, apart from the text None.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        ok = []
        for t in rows["at"].tolist():
            times = [x for x in times if abs(t - x) < seconds or x > t]
            ok.append(sum(1 for x in times if t - seconds < x <= t) < most)
            if ok[-1]:
                times.append(t)
        state.update((times,))
        state.setTimeoutTimestamp(max(max(times, default=0) + seconds, state.getCurrentWatermarkMs() // 1000 + 1) * 1000)
        yield pd.DataFrame({"key": [None if k[1] else k[0]] * len(rows), "at": rows["at"].to_numpy(), "admitted": ok})

    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    secs = timed.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(key).isNull().alias("none"), F.unix_seconds("__at").alias("at"), "__at")
    return secs.groupBy("key", "none").applyInPandasWithState(step, "key string, at bigint, admitted boolean", "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def append_current(target: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends the newest row per key of each batch to a log under ``target``; a repeated batch writes its own part again.

    A batch costs what it holds, however large the table is. ``read_current`` gives the newest row per key, ``compact`` shortens the log.
    """

    def run(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(*order)).alias("x")).select("x.*")
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return run


def read_current(spark: SparkSession, target: str, key: str, order: list[str]) -> DataFrame:
    """The newest row per key of the log under ``target``."""
    log = spark.read.parquet(target)
    columns = [c for c in log.columns if c != "batch"]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x")).select("x.*")


def compact(spark: SparkSession, target: str, new: str, key: str, order: list[str]) -> None:
    """The current rows as the first batch of a new log under ``new``."""
    read_current(spark, target, key, order).write.mode("errorifexists").parquet(f"{new}/batch=-1")


def ingest_batches(target: str, make: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the tables ``make`` gives for the uploads of a batch, each under its name and the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        for name, df in make(batch).items():
            df.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")

    return run


def keep_current(target: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the newest row per key of all batches in versions of a table under ``target``.

    Each batch writes a version named by its number from the one before, so a repeated batch writes the same again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{target}/{number - 1}"))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("x")).select("x.*")
        last.write.mode("overwrite").parquet(f"{target}/{number}")

    return run
