import datetime as dt
import json

from pyspark.sql import functions as F

from threadmill.streaming.ingest import EVENT, Completion, Counters, Store, decoded, ingest, ingest_history

T0 = dt.datetime(2026, 3, 27, 9, 18, 59)


def _event(kind="message", ident=None, chat=None, sender=None, at=T0, payload=None, **kw):
    row = dict.fromkeys(EVENT.fieldNames())
    row.update(event_type=kind, id=ident, chat_jid=chat, sender_jid=sender, timestamp=at, payload=json.dumps(payload or {"conversation": "hi"}), **kw)
    return tuple(row[n] for n in EVENT.fieldNames())


def _write(spark, rows, path, name):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def _run(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*")
    ingest(stream, store, f"{tmp_path}/checkpoint").awaitTermination()
    return store


def test_late_group_message_is_kept_and_repeats_collapse(spark, tmp_path):
    group, direct = "120363123456789012@g.us", "15550001111@s.whatsapp.net"
    _write(spark, [_event(ident="dm-newer", chat=direct, sender=direct), _event(ident="dup-1", chat=direct, sender=direct), _event(ident="dup-1", chat=direct, sender=direct), _event(ident=None, chat=direct)], f"{tmp_path}/in", "a")
    _run(spark, tmp_path)
    _write(spark, [_event(ident="group-older", chat=group, sender="15551230000@s.whatsapp.net", at=T0 - dt.timedelta(minutes=45)), _event(ident="dup-1", chat=direct, sender=direct)], f"{tmp_path}/in", "b")
    store = _run(spark, tmp_path)
    rows = {r["id"]: r for r in store.messages().collect()}
    assert sorted(rows) == ["dm-newer", "dup-1", "group-older"] and store.messages().count() == 3
    assert rows["group-older"]["is_group"] and rows["group-older"]["timestamp"] == T0 - dt.timedelta(minutes=45)
    assert store.high_water() == T0


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    events = spark.createDataFrame([_event(ident="a", chat="c"), _event(kind="contact", chat="c", push_name="old", seq=1), _event(kind="contact", chat="c", push_name="new", seq=2)], EVENT)
    store.write(events, 0)
    store.write(events, 0)
    store.write(events, 1)
    assert store.messages().count() == 1
    assert [tuple(r) for r in store.contacts().select("jid", "push_name").collect()] == [("c", "new")]


def test_payload_variants(spark):
    payloads = [({"conversation": "x"}, ("text", "x", None)), ({"extended": {"text": "y"}}, ("text", "y", None)), ({"image": {"caption": "c", "mime": "image/png"}}, ("image", "c", "image/png")), ({"location": {"lat": 1.5, "lon": -2}}, ("location", "1.500000,-2.000000", None)), ({"reaction": {"text": "❤️"}}, ("reaction", "❤️", None)), ({"else": 1}, ("other", None, None))]
    df = spark.createDataFrame([_event(ident=str(i), chat="c", payload=p) for i, (p, _) in enumerate(payloads)], EVENT)
    got = [tuple(r) for r in decoded(df).orderBy("id").select("msg_type", "text_content", "media_type").collect()]
    assert got == [w for _, w in payloads]


def test_counters_close_once():
    calls = []
    counters = Counters(on_done=[lambda: calls.append(1)])
    counters.close()
    counters.close()
    assert calls == [1] and counters.done


def test_empty_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/none")
    assert store.messages().count() == 0 and store.contacts().count() == 0
    assert store.messages().agg(F.max("timestamp")).first()[0] is None


def test_history_is_complete_only_after_its_last_piece():
    now = [0.0]
    history = Completion(initial=5, between=40, settle=15, clock=lambda: now[0])
    history.saw(42)
    now[0] = 10
    assert not history.done
    history.saw(100)
    now[0] = 24
    assert not history.done
    now[0] = 25
    assert history.done
    history.saw(1)
    assert history.done
    idle = Completion(initial=5, clock=lambda: now[0])
    now[0] = 29
    assert not idle.done
    now[0] = 30
    assert idle.done
    slow = Completion(initial=5, between=40, clock=lambda: now[0])
    slow.saw(None)
    now[0] = 69
    assert not slow.done
    now[0] = 70
    assert slow.done


def test_history_ingest_stops_by_progress(spark, tmp_path):
    rows = [_event(kind="history", ident="a", chat="c", progress=50), _event(kind="history", ident="b", chat="c", progress=100), _event(kind="progress", progress=100)]
    _write(spark, rows, f"{tmp_path}/in", "a")
    store = Store(spark, f"{tmp_path}/store")
    stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*")
    ingest_history(stream, store, f"{tmp_path}/checkpoint", Completion(initial=120, between=120, settle=0.5), every="0 seconds", poll=0.2)
    assert {r["id"] for r in store.messages().collect()} == {"a", "b"} and not spark.streams.active


def test_a_batch_reads_the_cuts_it_touches(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store", cuts=4)
    store.write(spark.createDataFrame([_event(ident=str(i), chat="c") for i in range(40)], EVENT), 0)
    store.write(spark.createDataFrame([_event(ident="7", chat="c"), _event(ident="new", chat="c")], EVENT), 1)
    store.write(spark.createDataFrame([], EVENT), 2)
    assert store.messages().count() == 41 and store.messages(below=1).count() == 40
