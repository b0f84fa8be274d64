import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.operators.incremental import IntervalLedger, merge_intervals, newest_changes, pending_messages, subtract_intervals

spans = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=12)


@given(spans, spans)
def test_intervals_against_sets(available, processed):
    def numbers(s):
        return {n for low, high in s for n in range(low, high + 1)}

    assert numbers(merge_intervals(available)) == numbers(available)
    gaps = subtract_intervals(available, processed)
    assert numbers(gaps) == numbers(available) - numbers(processed)
    assert all(a[1] + 1 < b[0] for a, b in zip(gaps, gaps[1:]))


def _arrivals(spark, rows):
    return spark.createDataFrame(rows, "arrival_no bigint, batch_no int, id string, chat_jid string, text_digest string")


def test_newest_change_follows_the_digest(spark):
    rows = [(1, 1, "a", "c", "x"), (2, 2, "a", "c", "x"), (3, 3, "a", "c", "y"), (4, 4, "a", "c", "y"), (5, 5, "a", "c", "x"), (6, 6, "b", "c", None), (7, 7, "b", "c", None)]
    found = {(r["id"], r["change_batch"]) for r in newest_changes(_arrivals(spark, rows), ["id", "chat_jid"], "batch_no", "arrival_no", "text_digest").collect()}
    assert found == {("a", 5), ("b", 6)}


def test_change_inside_one_batch(spark):
    rows = [(1, 1, "a", "c", "x"), (2, 3, "a", "c", "x"), (3, 3, "a", "c", "y"), (4, 3, "a", "c", "x")]
    assert newest_changes(_arrivals(spark, rows), ["id", "chat_jid"], "batch_no", "arrival_no", "text_digest").first()["change_batch"] == 3


def test_pending_takes_gaps_only(spark):
    t = dt.datetime(2026, 1, 1)
    arrivals = _arrivals(spark, [(i, i, f"m{i}", "c", "d") for i in range(1, 7)])
    runs = spark.createDataFrame(
        [(1, "embed", 1, 2, "started", t), (1, "embed", 1, 2, "ok", t), (2, "embed", 3, 4, "ok", t), (2, "embed", 3, 4, "rolled_back", t + dt.timedelta(hours=1)), (3, "embed", 5, 5, "ok", t), (4, "embed", 6, 6, "started", t)],
        "run_no int, stage string, from_batch int, to_batch int, status string, logged_at timestamp",
    )
    messages = spark.createDataFrame([(f"m{i}", "c", True, " " if i == 4 else "hello") for i in range(1, 7)], "id string, chat_jid string, is_group boolean, text_content string")
    assert {r["id"] for r in pending_messages(arrivals, runs, messages).collect()} == {"m3", "m6"}
    assert pending_messages(arrivals.limit(0), runs, messages).count() == 0
    assert pending_messages(arrivals, runs.limit(0), messages).count() == 0


def test_ledger_survives_failures(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}", "embed")

    def rows(spans):
        numbers = [(n,) for low, high in spans for n in range(low, high + 1)]
        return spark.createDataFrame(numbers, "n int")

    def broken(spans):
        return rows(spans).withColumn("x", F.raise_error(F.lit("lost")))

    assert ledger.run([(1, 5)], rows) == [(1, 5)]
    with pytest.raises(Exception, match="lost"):
        ledger.run([(1, 9)], broken)
    assert ledger.processed() == [(1, 5)]
    assert ledger.run([(1, 3), (8, 9)], rows) == [(8, 9)]
    assert ledger.run([(1, 10)], rows) == [(6, 7), (10, 10)]
    assert ledger.run([(1, 10)], rows) == []
    assert ledger.processed() == [(1, 10)]
    assert sorted(r["n"] for r in ledger.output().collect()) == list(range(1, 11))


def test_ledger_lets_one_of_two_racing_runs_commit(spark, tmp_path):
    ledger = IntervalLedger(spark, f"file://{tmp_path}", "extract")
    commit = {"number": 1, "folder": "x", "intervals": [(1, 2)], "processed": [(1, 2)]}
    ledger._publish(1, commit)
    with pytest.raises(FileExistsError):
        ledger._publish(1, commit)
    assert ledger.processed() == [(1, 2)]


def test_ledger_outlives_a_crash_at_any_point_of_the_commit(spark, tmp_path, monkeypatch):
    ledger = IntervalLedger(spark, f"file://{tmp_path}", "embed")

    def rows(spans):
        return spark.createDataFrame([(n,) for low, high in spans for n in range(low, high + 1)], "n int")

    assert ledger.run([(1, 4)], rows) == [(1, 4)]
    # the rows are written, the commit is not
    with monkeypatch.context() as patch:
        patch.setattr(IntervalLedger, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(RuntimeError):
            ledger.run([(1, 9)], rows)
    # the commit is half written
    (tmp_path / "embed" / "_commits" / "_draft-000002-torn").write_text('{"number": 2, "fol')
    assert ledger.processed() == [(1, 4)]
    again = IntervalLedger(spark, f"file://{tmp_path}", "embed")
    assert again.run([(1, 9)], rows) == [(5, 9)]
    assert again.processed() == [(1, 9)] and sorted(r["n"] for r in again.output().collect()) == list(range(1, 10))
    assert len(again.clear()) == 2 and again.clear() == []
    assert sorted(r["n"] for r in again.output().collect()) == list(range(1, 10))
