import datetime as dt
import random

from pyspark.sql import functions as F

from threadmill.operators.sessions import chat_sessions

SCHEMA = "id string, chat_jid string, timestamp timestamp, _key string"
BASE = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(i, c, BASE + dt.timedelta(seconds=s) if s is not None else None, "clash") for i, c, s in rows], SCHEMA)
    origin = int(BASE.timestamp() * 1e6)
    return sorted((r["chat_jid"] or "", (r["start_us"] - origin) // 10**6, (r["end_us"] - origin) // 10**6, r["n_messages"]) for r in chat_sessions(df, **kw).collect())


def _brute(rows, gap=1800):
    out = []
    for chat in {c for _, c, _ in rows}:
        times = sorted({(s, i) for i, c, s in rows if c == chat and s is not None})
        part = []
        for s, _ in times:
            if part and s - part[-1] > gap:
                out.append((chat or "", part[0], part[-1], len(part)))
                part = []
            part.append(s)
        if part:
            out.append((chat or "", part[0], part[-1], len(part)))
    return sorted(out)


def test_gap_of_exactly_thirty_minutes_keeps_the_session_open(spark):
    assert _run(spark, [("a", "c", 0), ("b", "c", 1800), ("d", "c", 3601)]) == [("c", 0, 1800, 2), ("c", 3601, 3601, 1)]


def test_repeats_nulls_ties_and_empty(spark):
    rows = [("a", "c", 0), ("a", "c", 0), ("b", "c", 0), ("x", "c", None), ("n", None, 5)]
    assert _run(spark, rows) == [("", 5, 5, 1), ("c", 0, 0, 2)]
    assert _run(spark, []) == []


def test_against_brute_force_over_bucket_borders(spark):
    rng = random.Random(3)
    rows = []
    for chat in "abc":
        at = 0
        for i in range(400):
            at += rng.choice([1, 60, 1700, 1800, 1801, 4000, 15000])
            rows.append((f"{chat}{i}", chat, at))
    rows += rng.sample(rows, 50)
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, rows, bucket_us=1900 * 10**6) == _brute(rows)
    assert _run(spark, rows, gap_us=60 * 10**6) == _brute(rows, 60)
