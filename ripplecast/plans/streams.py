"""Queries on call statistics and key health (T*, W09-W11), as batch over the whole log.

tests/test_operators.py replays the same rows as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import FACTS, Facts
from ..registry import query
from ..session import new_folder
from ..streaming import health, minutes

MINUTES = "SELECT api_key, date_trunc('minute', ts) AS window_start, count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed FROM {log_f} GROUP BY api_key, date_trunc('minute', ts)"


def calls(f: Facts) -> DataFrame:
    return f.log_f.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("T01_minute_counts", MINUTES)
def t01(f: Facts) -> DataFrame:
    return health.minute_counts(calls(f))


@query("T02_live_windows", f"SELECT api_key, count(*) AS windows FROM ({MINUTES}) m WHERE window_start >= (SELECT max(ts) FROM {{log_f}}) - INTERVAL 60 SECOND GROUP BY api_key")
def t02(f: Facts) -> DataFrame:
    now = f.log_f.agg(F.max("ts").alias("now"))
    m = health.minute_counts(calls(f)).join(F.broadcast(now), F.expr("window_start >= now - INTERVAL 60 SECONDS"))
    return m.groupBy("api_key").agg(F.count("*").alias("windows"))


@query("T03_last_minute", f"SELECT api_key, CAST(sum(total) AS BIGINT) AS calls FROM ({MINUTES}) m WHERE window_start >= (SELECT max(ts) FROM {{log_f}}) - INTERVAL 60 SECOND GROUP BY api_key")
def t03(f: Facts) -> DataFrame:
    """Sum over live tumbling windows, which span up to two minutes."""
    now = f.log_f.agg(F.max("ts").alias("now"))
    m = health.minute_counts(calls(f)).join(F.broadcast(now), F.expr("window_start >= now - INTERVAL 60 SECONDS"))
    return m.groupBy("api_key").agg(F.sum("total").alias("calls"))




FOLD = """WITH lists AS (SELECT api_key, list({{'w': 1.0::DOUBLE, 'f': 0::BIGINT, 'ok': success, 'a': response_time, 'n': 1::BIGINT}} ORDER BY ts, event_id) AS l FROM {log_f} GROUP BY api_key),
  folds AS (SELECT api_key, list_reduce(l, lambda s, e: {{
    'w': CASE WHEN NOT e.ok THEN greatest(0.0, s.w - 0.2 * least(s.f + 1, 5)) WHEN s.f >= 10 THEN 0.5 ELSE least(1.0, s.w + 0.05) END,
    'f': CASE WHEN e.ok THEN 0 ELSE s.f + 1 END, 'ok': e.ok, 'a': CASE WHEN s.n = 0 THEN e.a ELSE 0.1 * e.a + 0.9 * s.a END, 'n': s.n + 1}},
    {{'w': 1.0::DOUBLE, 'f': 0::BIGINT, 'ok': true, 'a': 0.0::DOUBLE, 'n': 0::BIGINT}}) AS s FROM lists)
  """


@query("T04_key_health", FOLD + "SELECT api_key, round(s.w, 6) AS weight, CAST(s.f AS INT) AS failures, s.f < 10 AS enabled, round(s.a, 4) AS average, s.n AS calls FROM folds")
def t04(f: Facts) -> DataFrame:
    """The SQL folds call by call."""
    return health.final_health(f.log_f).select("api_key", F.round("weight", 6).alias("weight"), "failures", "enabled", F.round("average", 4).alias("average"), "calls")


@query("W11_key_weights", FOLD + "SELECT api_key, round(s.w, 6) AS weight FROM folds")
def w11(f: Facts) -> DataFrame:
    return health.weights(health.placed(f.log_f)).select("api_key", F.round("weight", 6).alias("weight"))


@query("T06_batch_progress", "SELECT task_id, result_id, round(0.05 + 0.9 * count(*) OVER (PARTITION BY task_id ORDER BY result_id) / count(*) OVER (PARTITION BY task_id), 6) AS progress FROM {llm_f}")
def t06(f: Facts) -> DataFrame:
    done = F.count("*").over(Window.partitionBy("task_id").orderBy("result_id"))
    total = F.count("*").over(Window.partitionBy("task_id"))
    return f.llm_f.select("task_id", "result_id", F.round(health.progress(done, total), 6).alias("progress"))


@query("W09_moving_average", """SELECT api_key, round(sum(power(0.9, n - i) * CASE WHEN i = 1 THEN 1.0 ELSE 0.1 END * response_time), 4) AS average FROM (SELECT api_key, response_time, row_number() OVER (PARTITION BY api_key ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY api_key) AS n FROM {log_f}) x GROUP BY api_key""")
def w09(f: Facts) -> DataFrame:
    return health.averages(f.log_f).select("api_key", F.round("average", 4).alias("average"))


@query("W10_failure_runs", """SELECT api_key, event_id, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY api_key, island ORDER BY ts, event_id) AS BIGINT) AS run
  FROM (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY api_key ORDER BY ts, event_id) AS island FROM {log_f}) x""")
def w10(f: Facts) -> DataFrame:
    return health.failure_runs(f.log_f)


@query("T02_streamed_minutes", """WITH r AS (SELECT *, date_trunc('minute', ts) AS window_start, count(*) OVER w AS calls, coalesce(max(CASE WHEN success THEN i END) OVER w, 0) AS last_ok FROM (SELECT *, row_number() OVER (PARTITION BY api_key ORDER BY ts, event_id) AS i FROM {log_f}) x WINDOW w AS (PARTITION BY api_key ORDER BY ts, event_id))
  SELECT api_key, window_start, count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, CAST(arg_max(i - last_ok, i) AS INT) AS failures, max(calls) AS calls FROM r
  WHERE window_start + INTERVAL 60 SECOND <= (SELECT max(ts) FROM {log_f}) - INTERVAL 120 SECOND GROUP BY api_key, window_start""")
def t02_streamed(f: Facts) -> DataFrame:
    """The log as a stream: minutes that the watermark has passed, with the health after each; their rows leave the state."""
    events = f.spark.readStream.schema(f.events.schema).parquet(f"{f.sf_dir}/events.parque[t]")  # a pattern, as streams take no path of one file
    log = f.spark.sql(FACTS["log_f"], events=events).withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = new_folder(f.spark, "minutes"), new_folder(f.spark, "state")
    rows = minutes.run_to_files(f.spark, minutes.minute_health(log, "120 seconds"), out, state)
    return rows.select("api_key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "total", "ok", "failed", "failures", "calls")
