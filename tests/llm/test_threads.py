import datetime as dt

from threadmill.llm.threads import OWNER, conversations, resolve_threads

B = dt.datetime(2026, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "id string, chat_jid string, sender_jid string, is_from_me boolean, is_group boolean, timestamp timestamp, text_content string"


def test_pointer_jumping_finds_roots_orphans_and_cycles(spark):
    rows = [("a", None, 1), ("b", "a", 1), ("c", "b", 0), ("d", "c", 1), ("o", "gone", 1), ("p", "o", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1), ("t", "x", 1), ("s", "s", 1), ("b", "a", 1)]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, 1) for i in range(100)]
    found = {r["node"]: (r["root"], r["ahead"], r["state"]) for r in resolve_threads(spark.createDataFrame(rows, "node string, parent string, weight bigint")).collect()}
    assert found["a"] == ("a", 0, "ok") and found["b"] == ("a", 1, "ok") and found["d"] == ("a", 2, "ok")
    assert found["o"] == ("o", 0, "orphan") and found["p"] == ("o", 1, "orphan")
    assert all(found[n] == (None, None, "cycle") for n in "xyzts")
    assert found["n99"] == ("n0", 99, "ok") and len(found) == 111


def _turns(spark, rows):
    df = spark.createDataFrame([(i, c, s, me, g, B + dt.timedelta(seconds=t), x) for i, c, s, me, g, t, x in rows], SCHEMA)
    return sorted((r["chat_jid"], r["pos"], r["id"], r["turn_role"]) for r in conversations(df).collect())


def test_kept_and_dropped(spark):
    g, a, b = "1@g.us", "5@s.whatsapp.net", "6:2@s.whatsapp.net"
    rows = [("1", g, a, False, True, 0, "hi"), ("2", g, OWNER, True, True, 10, "yes"), ("2", g, OWNER, True, True, 10, "yes"), ("3", g, b, False, True, 20, " "), ("4", g, b, False, True, 20, "ok")]
    assert _turns(spark, rows) == [(g, 1, "1", "other"), (g, 2, "2", "owner"), (g, 3, "4", "other")]
    assert _turns(spark, rows + [("9", g, "", False, True, 60, None)]) == []
    assert _turns(spark, rows + [("9", g, OWNER, False, True, 60, "x")]) == []
    assert _turns(spark, [("1", a, a, False, False, 0, "hi"), ("2", a, a, False, False, 5, "hello?")]) == []
    assert _turns(spark, [("1", a, a, False, False, 0, "hi"), ("2", a, b, False, False, 5, "who")]) == []
    assert _turns(spark, []) == []


def test_one_long_conversation_over_many_buckets(spark):
    g, a = "1@g.us", "5@s.whatsapp.net"
    rows = [(f"{i:05d}", g, OWNER if i % 2 else a, bool(i % 2), True, i * 1700, "x") for i in range(300)]
    found = _turns(spark, rows)
    assert [(p, i) for _, p, i, _ in found] == [(i + 1, f"{i:05d}") for i in range(300)]
