"""The stream of key health with late and repeated rows against a plain fold."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from ripplecast.streaming import minutes
from ripplecast.streaming.health import start_state, step

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_late_and_repeated_rows_are_folded_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(3)}", START + timedelta(seconds=7 * i), i, rng.random() > 0.5 if i % 11 else None, rng.random()) for i in range(120)]
    kind = "api_key string, ts timestamp, event_id long, success boolean, response_time double"
    # rows up to eight places out of order, one without a time, and some of them twice
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(8))
    shuffled.insert(20, ("k1", None, 997, True, 1.0))
    end = [("end", START + timedelta(hours=2), 999, True, 1.0)]
    behind = [("k0", START, 998, True, 1.0)]  # far behind the watermark: dropped
    for n, part in enumerate([shuffled[:50] + shuffled[:5], shuffled[50:] + shuffled[45:50], end, behind]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={n}"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        made = minutes.run_to_files(spark, minutes.minute_health(stream, "2 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    want, now = {}, {}
    for key, ts, _, ok, took in rows:
        now[key] = step(now.get(key, start_state()), bool(ok), took)
        minute = ts.replace(second=0)
        total, good = want.get((key, minute), (0, 0))[:2]
        want[key, minute] = (total + 1, good + bool(ok), *now[key])
    got = {}
    for r in made.collect():
        at = (r.api_key, r.window_start.astimezone(timezone.utc))
        assert at not in got
        got[at] = (r.total, r.ok, r.weight, r.failures, r.enabled, r.average, r.calls)
    assert got == {k: pytest.approx(v) for k, v in want.items()}
