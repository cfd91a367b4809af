"""Key health over a stream in order of time, whatever order rows come in.

A key's rows of a minute wait in the state of a window, which Spark deals over all tasks by key and minute, until the
watermark has passed the minute; the closed minutes of a key, each one row with its calls in the order of (ts, event_id), are then
folded in their order, and give one row each with its counts and the health after it. So rows that are late by less than the
watermark's delay count as if they had come in time, rows with an event_id met before in their minute count once, and the
state of a key is its fold. Rows of closed minutes are dropped by Spark. Only the fold of a key is in one task, which gets
successes and response times of the minutes that one trigger closes. A null success is a failure, as in the batch; rows without ts are not taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .health import STATE, start_state, step

MINUTE = 60_000
COUNTS = f"total long, ok long, failed long, {STATE}"
FOLDED = f"api_key string, minute long, {COUNTS}"
SCHEMA = f"api_key string, window_start timestamp, {COUNTS}"
COLUMNS = [part.split()[0] for part in FOLDED.split(", ")]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class MinuteHealth(StatefulProcessor):
    """State: the fold of all closed minutes. Minutes that one trigger closes are later than those of all before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = [row for frame in rows for row in frame[["minute", "success", "response_time"]].itertuples(index=False)]
        now = tuple(self.fold.get()) if self.fold.exists() else start_state()
        out = []
        for minute, success, took in sorted(closed, key=lambda row: row[0]):
            oks = [bool(x) for x in success]
            for good, seconds in zip(oks, took, strict=True):
                now = step(now, good, float(seconds))
            out.append((key[0], minute, len(oks), sum(oks), len(oks) - sum(oks), *now))
        self.fold.update(now)
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def closed_minutes(calls: DataFrame, delay: str) -> DataFrame:
    """(api_key, minute, success, response_time): a row a key and closed minute of the stream calls, with arrays in the order of (ts, event_id)."""
    call = F.struct(F.unix_micros("ts").alias("ts_us"), "event_id", F.coalesce("success", F.lit(False)).alias("success"), "response_time")
    rows = calls.filter("ts IS NOT NULL").withWatermark("ts", delay).groupBy("api_key", F.window("ts", "1 minute").alias("w")).agg(F.sort_array(F.collect_list(call)).alias("c"))
    before = lambda i: F.get("c", i - 1)
    once = F.filter("c", lambda x, i: (i == 0) | (x["ts_us"] != before(i)["ts_us"]) | ~x["event_id"].eqNullSafe(before(i)["event_id"]))
    minute = F.floor(F.unix_micros(F.col("w.start")) / (MINUTE * 1000)).alias("minute")
    return rows.select("api_key", minute, once.alias("c")).select("api_key", "minute", F.col("c.success").alias("success"), F.col("c.response_time").alias("response_time"))


def minute_health(calls: DataFrame, delay: str) -> DataFrame:
    """One row a key and closed minute of the stream calls (api_key, ts timestamp, event_id, success, response_time)."""
    folded = closed_minutes(calls, delay).groupBy("api_key").transformWithStateInPandas(MinuteHealth(), FOLDED, "Append", "None")
    return folded.select("api_key", F.timestamp_millis(F.col("minute") * MINUTE).alias("window_start"), *COLUMNS[2:])


def run_to_files(spark: SparkSession, rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The stream rows run over all input that is there, into Parquet files below path, and these read."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # transformWithState needs it
    try:
        run = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(SCHEMA).parquet(path)
