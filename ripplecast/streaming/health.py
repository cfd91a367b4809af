"""Health of API keys over a stream of calls: windows, weights, moving averages.

The streaming processor folds by `step`; the batch works by blocks of calls and gives the same
rows, however many calls a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked

# Fixed values of the weight rules.
RECOVERY = 0.05
PENALTY = 0.2
PENALTY_STEPS = 5
DISABLE_AFTER = 10
REENABLED_WEIGHT = 0.5
ALPHA = 0.1
WINDOW = "60 seconds"

#: Calls of a key are placed by blocks of this length of time, and folded by so many.
BLOCK = "MINUTE"
FOLD = 4096


def minute_counts(calls: DataFrame, watermark: str | None = None) -> DataFrame:
    """Calls, successes and failures by key and 60-second window; for a stream, windows close after the watermark."""
    rows = calls.withWatermark("ts", watermark) if watermark else calls
    n = rows.groupBy(F.window("ts", WINDOW).alias("w"), "api_key").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"))
    return n.select("api_key", F.col("w.start").alias("window_start"), "total", "ok", "failed")


def start_state() -> tuple[float, int, bool, float, int]:
    """weight, failures in a row, enabled, moving average, calls."""
    return 1.0, 0, True, 0.0, 0


def step(state: tuple, success: bool, response_time: float) -> tuple:
    weight, failures, enabled, average, calls = state
    if success:
        failures, weight = 0, min(1.0, weight + RECOVERY) if enabled else REENABLED_WEIGHT
        enabled = True
    else:
        failures += 1
        weight = max(0.0, weight - PENALTY * min(failures, PENALTY_STEPS))
        enabled = enabled and failures < DISABLE_AFTER
    average = response_time if calls == 0 else ALPHA * response_time + (1 - ALPHA) * average
    return weight, failures, enabled, average, calls + 1


def placed(calls: DataFrame) -> DataFrame:
    """calls by key with each one's place i in the order of (ts, event_id), the key's total, and run, prior:
    the failures in a row up to it and before it.

    Places and runs are those within a (key, BLOCK) plus what the blocks before leave over; only one
    row a block is ordered along a whole key. A null success counts as a failure, as in step.
    """
    order = ["ts", "event_id"]
    rows = calls.select("api_key", *order, F.coalesce("success", F.lit(False)).alias("success"), "response_time", F.date_trunc(BLOCK, "ts").alias("block"))
    w = Window.partitionBy("api_key", "block").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    done = F.count_if("success").over(so_far)
    last = F.max(F.when(F.col("success"), F.col("nth"))).over(so_far)
    local = rows.withColumn("nth", F.row_number().over(w)).select("*", done.alias("done"), last.alias("last"))

    # a block's tail: its failures after its last success, or all its calls
    blocks = rows.groupBy("api_key", "block").agg(F.count("*").alias("n"), F.count_if("success").alias("oks"))
    tails = local.filter("success").groupBy("api_key", "block").agg(F.max("nth").alias("last_ok"))
    along = Window.partitionBy("api_key").orderBy("block")
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.join(tails, ["api_key", "block"], "left").withColumn("tail", F.col("n") - F.coalesce("last_ok", F.lit(0)))
    blocks = blocks.withColumn("island", F.count_if(F.col("oks") > 0).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("left_over", F.sum("tail").over(Window.partitionBy("api_key", "island").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    starts = blocks.select(
        "api_key", "block", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("api_key")).alias("total"),
        F.coalesce(F.lag("left_over").over(along), F.lit(0)).alias("carry"),
    )
    run = F.when(F.col("done") == 0, F.col("nth") + F.col("carry")).otherwise(F.col("nth") - F.col("last"))
    joined = local.join(starts, ["api_key", "block"]).withColumn("run", run)
    prior = F.coalesce(F.lag("run").over(w), F.col("carry"))
    return joined.select("api_key", *order, "success", "response_time", (F.col("nth") + F.col("before")).alias("i"), "total", "run", prior.alias("prior"))


def average(i: Column, total: Column) -> Column:
    """The exponential moving average as a sum: call i of n counts ALPHA * (1 - ALPHA)**(n - i), the first (1 - ALPHA)**(n - 1)."""
    weight = F.pow(F.lit(1 - ALPHA), total - i) * F.when(i == 1, 1.0).otherwise(ALPHA)
    return F.sum(weight * F.col("response_time"))


def averages(calls: DataFrame) -> DataFrame:
    """(api_key, average): the exponential moving average over each key's calls in order of (ts, event_id)."""
    rows = ranked(calls.select("api_key", "ts", "event_id", "response_time"), ["api_key"], ["ts", "event_id"], F.date_trunc(BLOCK, "ts"), "i")
    totals = calls.groupBy("api_key").agg(F.count("*").alias("total"))
    return rows.join(F.broadcast(totals), "api_key").groupBy("api_key").agg(average(F.col("i"), F.col("total")).alias("average"))


def failure_runs(calls: DataFrame) -> DataFrame:
    """(api_key, event_id, run): failures in a row up to each call."""
    return placed(calls).select("api_key", "event_id", "run")


def weights(rows: DataFrame) -> DataFrame:
    """(api_key, weight) after all calls of placed rows.

    Each call maps a weight x to min(high, max(low, x + move)), and such maps compose to one of
    their kind. So FOLD maps in a row are folded to one, FOLD of those again, and what is left
    of a key, one map for FOLD**2 calls, at last; no list is longer than that.
    """
    ok = F.col("success")
    back = ok & (F.col("prior") >= DISABLE_AFTER)
    move = F.when(back, 0.0).when(ok, RECOVERY).otherwise(-PENALTY * F.least(F.col("run"), F.lit(PENALTY_STEPS)))
    maps = rows.select("api_key", "i", move.alias("move"), F.when(back, REENABLED_WEIGHT).otherwise(0.0).alias("low"), F.when(back, REENABLED_WEIGHT).otherwise(1.0).alias("high"))

    def clamped(x: Column, m: Column) -> Column:
        return F.least(m["high"], F.greatest(m["low"], x + m["move"]))

    def then(f: Column, m: Column) -> Column:
        return F.struct((f["move"] + m["move"]).alias("move"), clamped(f["low"], m).alias("low"), clamped(f["high"], m).alias("high"))

    start = F.struct(F.lit(0.0).alias("move"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    for group in (["api_key", F.floor(F.col("i") / FOLD).alias("i")], ["api_key", F.floor(F.col("i") / FOLD).alias("i")], ["api_key"]):
        listed = maps.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", "move", "low", "high"))).alias("maps"))
        folded = F.aggregate("maps", start, then)
        maps = listed.withColumn("f", folded).select(*listed.columns[:-1], "f.*")
    return maps.select("api_key", F.least(F.col("high"), F.greatest(F.col("low"), F.lit(1.0) + F.col("move"))).alias("weight"))


def final_health(calls: DataFrame) -> DataFrame:
    """(api_key, weight, failures, enabled, average, calls) after each key's calls in order, as a fold by step gives.

    A key is disabled while DISABLE_AFTER or more failures stand in a row.
    """
    rows = placed(calls)
    last = rows.groupBy("api_key").agg(F.max_by("run", "i").alias("failures"), average(F.col("i"), F.col("total")).alias("average"), F.count("*").alias("calls"))
    failures = F.col("failures").cast("int").alias("failures")
    return last.join(weights(rows), "api_key").select("api_key", "weight", failures, (F.col("failures") < DISABLE_AFTER).alias("enabled"), "average", "calls")


COLUMNS = ["api_key", "weight", "failures", "enabled", "average", "calls"]
SCHEMA = "api_key string, weight double, failures int, enabled boolean, average double, calls long"
STATE = "weight double, failures int, enabled boolean, average double, calls long"


def streaming_health(calls: DataFrame) -> DataFrame:
    """The same over a stream: a state per key, updated by each micro-batch in the order of (ts, event_id)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start_state()
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ok, took in zip(rows["success"], rows["response_time"], strict=True):
            now = step(now, bool(ok), float(took))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=COLUMNS)

    return calls.groupBy("api_key").applyInPandasWithState(update, SCHEMA, STATE, "update", "NoTimeout")


def progress(done: Column, total: Column) -> Column:
    return 0.05 + 0.9 * done / total
