"""Queries of the reference's operators over the domain tables, each with its SQL.

All run over whole tables.  Times are microseconds since the epoch in UTC and
``AS_OF`` stands for the present, so that results repeat.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.functions import columns
from threadmill.operators import filters, intervals, upsert
from threadmill.plans import entities, graph, reports, retrieval, store
from threadmill.session import cut_lineage
from threadmill.sources.tables import SCHEMAS, blank, empty, micros, reader
from threadmill.streaming import ingest

#: 2026-06-01 00:00:00 UTC.
AS_OF = 1_780_272_000_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_M = """m AS (SELECT id, chat_jid, any_value(epoch_us(timestamp)) AS us, any_value(regexp_replace(sender_jid, ':[0-9]+@', '@')) AS sender,
  any_value(coalesce(is_from_me, false)) AS mine, any_value(coalesce(is_group, false)) AS grouped, any_value(text_content) AS text_content,
  any_value(msg_type) AS msg_type, max(nullif(push_name, '')) AS push_name, any_value(sent_dow) AS sent_dow, any_value(sent_hour) AS sent_hour
  FROM messages GROUP BY id, chat_jid)"""
_C = """c AS (SELECT jid, max(nullif(push_name, '')) AS push_name, max(nullif(full_name, '')) AS full_name, max(nullif(business_name, '')) AS business_name,
  max(nullif(group_name, '')) AS group_name, bool_or(coalesce(is_group, false)) AS is_group FROM contacts GROUP BY jid)"""
_E = "e AS (SELECT message_id, entity_type, entity_value, min(chat_jid) AS chat_jid FROM extracted_entities GROUP BY message_id, entity_type, entity_value)"
_P = "p AS (SELECT jid AS source_id, coalesce(push_name, full_name, business_name, jid) AS display_name, push_name, full_name FROM c WHERE NOT is_group)"
_DM = """dm AS (SELECT sender, chat_jid AS receiver, count(*) AS message_count, min(us) AS first_us, max(us) AS last_us FROM m
  WHERE NOT grouped AND sender IN (SELECT source_id FROM p) AND chat_jid IN (SELECT source_id FROM p) GROUP BY sender, chat_jid)"""
_MO = """mo AS (SELECT sender AS person, chat_jid AS group_jid, count(*) AS message_count, min(us) AS first_us, max(us) AS last_us FROM m
  WHERE grouped AND sender IN (SELECT source_id FROM p) GROUP BY sender, chat_jid)"""
_CO = "co AS (SELECT a.person AS person1, b.person AS person2, count(*) AS shared_groups FROM mo a JOIN mo b ON a.group_jid = b.group_jid AND a.person < b.person GROUP BY 1, 2)"
_CV = """k AS (SELECT * FROM m WHERE grouped AND sender IN (SELECT source_id FROM p)),
cv AS (SELECT a.sender AS person1, b.sender AS person2, a.chat_jid AS group_jid, count(*) AS exchange_count, min(a.us) AS first_us, max(a.us) AS last_us
  FROM k a JOIN k b ON a.chat_jid = b.chat_jid AND a.sender < b.sender AND b.us BETWEEN a.us AND a.us + 300000000 GROUP BY 1, 2, 3)"""
_ME = """me AS (SELECT m.sender AS person, e.entity_type, e.entity_value, count(*) AS mention_count FROM e JOIN m ON m.id = e.message_id AND m.chat_jid = e.chat_jid
  WHERE m.sender IN (SELECT source_id FROM p) GROUP BY 1, 2, 3)"""
_W = """w AS (SELECT src, dst, sum(weight) AS weight FROM (
  SELECT sender AS src, receiver AS dst, message_count * 3.0::DOUBLE AS weight FROM dm
  UNION ALL SELECT person1, person2, exchange_count * 5.0::DOUBLE FROM cv UNION ALL SELECT person2, person1, exchange_count * 5.0::DOUBLE FROM cv
  UNION ALL SELECT a.person, b.person, count(*)::DOUBLE FROM mo a JOIN mo b ON a.group_jid = b.group_jid AND a.person <> b.person GROUP BY 1, 2
  UNION ALL SELECT a.person, b.person, count(*) * 2.0::DOUBLE FROM me a JOIN me b ON a.entity_type = b.entity_type AND a.entity_value = b.entity_value AND a.person <> b.person GROUP BY 1, 2
) GROUP BY src, dst)"""
_GRAPH = f"{_M}, {_C}, {_E}, {_P}, {_DM}, {_MO}, {_CV}, {_ME}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _messages(spark, root, *cols, names=False):
    return store.messages(reader(spark, root)("messages"), *cols, names=names)


def _contacts(spark, root):
    return store.contacts(reader(spark, root)("contacts"))


def _entities(spark, root):
    return store.entities(reader(spark, root)("extracted_entities"))


def graph_parts(spark: SparkSession, root: str, kept: bool = False) -> dict[str, DataFrame]:
    """All vertices and edges over one store; with ``kept`` the messages are made distinct once for all of them."""
    messages, contacts, found = _messages(spark, root), _contacts(spark, root), _entities(spark, root)
    if kept:
        messages = cut_lineage(messages.select("id", "chat_jid", "us", "sender", "grouped"))
    people = graph.persons(contacts)
    member, direct, talked, mentioned = graph.member_of(messages, people), graph.messaged(messages, people), graph.conversed(messages, people), graph.mentions(messages, found, people)
    topic = graph.topics(found)
    return {
        "persons": people,
        "groups": graph.groups(contacts, messages),
        "topics": topic,
        "entities": graph.entity_vertices(found),
        "messaged": direct,
        "member_of": member,
        "conversed": talked,
        "mentions": mentioned,
        "co_occurs": graph.co_occurs(member),
        "discusses": graph.discusses(mentioned, topic),
        "talk": graph.talk_edges(direct, talked),
        "hubs": graph.hubs_of(member, mentioned),
    }


# ------------------------------------------------------------ sources and sinks


@query("sc1_scan_projection", "SELECT id, chat_jid, msg_type FROM messages")
def _(spark, root):
    return reader(spark, root)("messages").select("id", "chat_jid", "msg_type")


@query("sc5_typed_empty", "SELECT message_id, entity_type, entity_value FROM extracted_entities")
def _(spark, root):
    """An empty relation takes the rows of the stored table as they are, so its types are theirs."""
    stored = reader(spark, root)("extracted_entities")
    return empty(spark, "extracted_entities").unionAll(stored.select(*SCHEMAS["extracted_entities"].names)).select("message_id", "entity_type", "entity_value")


@query(
    "sc6_schema_columns",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' WHEN 'DATE' THEN 'date'
 WHEN 'SMALLINT' THEN 'smallint' WHEN 'BLOB' THEN 'binary' WHEN 'FLOAT[]' THEN 'array<float>' ELSE column_type END AS column_type, row_number() OVER () - 1 AS position FROM (DESCRIBE {t})"""
        for t in ("messages", "contacts", "classifications", "extracted_entities")
    ),
)
def _(spark, root):
    """The declared schemas, against those of the stored files."""
    rows = [(t, f.name, f.dataType.simpleString(), i) for t in SCHEMAS for i, f in enumerate(empty(spark, t).schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string, position bigint")


@query(
    "sc7_insert_or_ignore",
    "SELECT id, chat_jid, arg_min(text_digest, (batch_no, arrival_no)) AS text_digest, arg_min(arrival_no, (batch_no, arrival_no)) AS arrival_no FROM message_arrivals GROUP BY id, chat_jid",
)
def _(spark, root):
    return upsert.first_wins(reader(spark, root)("message_arrivals"), ["id", "chat_jid"], F.struct("batch_no", "arrival_no"), ["text_digest", "arrival_no"])


@query(
    "sc8_upsert_last_wins",
    "SELECT id, chat_jid, arg_max(text_digest, (batch_no, arrival_no)) AS text_digest, arg_max(batch_no, (batch_no, arrival_no)) AS batch_no FROM message_arrivals GROUP BY id, chat_jid",
)
def _(spark, root):
    return upsert.last_wins(reader(spark, root)("message_arrivals"), ["id", "chat_jid"], F.struct("batch_no", "arrival_no"), ["text_digest", "batch_no"])


@query(
    "sc9_keyed_update",
    """WITH ch AS (SELECT message_id AS id, chat_jid, max(category) AS category FROM classifications GROUP BY 1, 2),
t AS (SELECT id, chat_jid, any_value(msg_type) AS msg_type FROM messages GROUP BY id, chat_jid)
SELECT t.id, t.chat_jid, coalesce(ch.category, t.msg_type) AS msg_type FROM t LEFT JOIN ch ON t.id = ch.id AND t.chat_jid = ch.chat_jid""",
)
def _(spark, root):
    t = reader(spark, root)
    changes = t("classifications").groupBy(F.col("message_id").alias("id"), "chat_jid").agg(F.max("category").alias("msg_type")).where("msg_type is not null")
    return upsert.updated(t("messages").select("id", "chat_jid", "msg_type").dropDuplicates(["id", "chat_jid"]), changes, ["id", "chat_jid"], "msg_type")


@query("sc10_column_reset", "SELECT id, chat_jid, CAST(NULL AS VARCHAR) AS media_path FROM messages")
def _(spark, root):
    return upsert.cleared(reader(spark, root)("messages").select("id", "chat_jid", "media_path"), "media_path")


@query("sc11_dedup_keep_first", f"WITH {_E} SELECT * FROM e")
def _(spark, root):
    return _entities(spark, root)


@query(
    "sc12_payload_decode",
    """WITH e AS (SELECT event_id, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE k % 12 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'image' WHEN 3 THEN 'video' WHEN 4 THEN 'audio' WHEN 5 THEN 'document' WHEN 6 THEN 'sticker' WHEN 7 THEN 'location'
  WHEN 8 THEN 'contact' WHEN 9 THEN 'reaction' WHEN 10 THEN 'text' ELSE 'other' END AS msg_type,
CASE WHEN k % 12 IN (0, 1, 2, 3, 5, 8, 9, 10) THEN t WHEN k % 12 = 7 THEN k || '.500000,-' || k || '.000000' END AS text_content,
CASE k % 12 WHEN 2 THEN 'image/png' WHEN 3 THEN 'video/mp4' WHEN 4 THEN 'audio/ogg' WHEN 5 THEN 'application/pdf' WHEN 6 THEN 'image/webp' END AS media_type FROM e""",
)
def _(spark, root):
    """Payloads of every variant, made from the events, as the ingest decodes them."""
    made = {
        0: '{"conversation":"%s"}', 1: '{"extended":{"text":"%s"}}', 2: '{"image":{"caption":"%s","mime":"image/png"}}', 3: '{"video":{"caption":"%s","mime":"video/mp4"}}', 4: '{"audio":{"mime":"audio/ogg"}}',
        5: '{"document":{"title":"%s","mime":"application/pdf"}}', 6: '{"sticker":{"mime":"image/webp"}}', 7: '{"location":{"lat":#.5,"lon":-#}}', 8: '{"contact":{"name":"%s"}}', 9: '{"reaction":{"text":"%s"}}',
        10: '{"image":{"caption":"no"},"conversation":"%s"}', 11: '{"unheard":1}',
    }
    k = F.get_json_object("props", "$.k").cast("int")
    payload = None
    for rest, text in made.items():
        filled = F.replace(F.replace(F.lit(text), F.lit("%s"), F.col("event_type")), F.lit("#"), k.cast("string"))
        payload = F.when(k % 12 == rest, filled) if payload is None else payload.when(k % 12 == rest, filled)
    return ingest.decoded(reader(spark, root)("events").select("event_id", payload.alias("payload"))).select("event_id", "msg_type", "text_content", "media_type")


@query(
    "sc13_media_selection",
    """SELECT DISTINCT id, chat_jid, msg_type FROM messages WHERE raw_proto IS NOT NULL AND NOT coalesce(media_downloaded, false)
AND msg_type IN ('image', 'video', 'audio', 'document', 'sticker') AND timestamp >= TIMESTAMPTZ '2026-03-05 00:00:00+00' AND timestamp <= TIMESTAMPTZ '2026-04-20 00:00:00+00'""",
)
def _(spark, root):
    return filters.media_to_download(reader(spark, root)("messages"), "2026-03-05", "2026-04-20").select("id", "chat_jid", "msg_type").distinct()


@query(
    "sc14_media_path",
    """SELECT DISTINCT id, chat_jid, 'media/' || replace(replace(chat_jid, '@', '_'), ':', '_') || '/' || strftime(timezone('UTC', timestamp), '%Y-%m-%d') || '_' || id || '.' ||
CASE split_part(lower(media_type), ';', 1) WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' WHEN 'image/gif' THEN 'gif' WHEN 'video/mp4' THEN 'mp4'
WHEN 'video/3gpp' THEN '3gp' WHEN 'audio/ogg' THEN 'ogg' WHEN 'audio/mpeg' THEN 'mp3' WHEN 'audio/mp4' THEN 'm4a' WHEN 'application/pdf' THEN 'pdf'
ELSE CASE msg_type WHEN 'image' THEN 'jpg' WHEN 'video' THEN 'mp4' WHEN 'audio' THEN 'ogg' ELSE 'bin' END END AS path
FROM messages WHERE media_type IS NOT NULL AND media_type <> ''""",
)
def _(spark, root):
    media = reader(spark, root)("messages").where("media_type is not null and media_type <> ''")
    path = columns.media_path("media", F.col("chat_jid"), F.col("timestamp"), F.col("id"), F.col("media_type"), F.col("msg_type"))
    return media.select("id", "chat_jid", path.alias("path")).distinct()


# ------------------------------------------------------------ reports


@query(
    "qr1_summary",
    f"""WITH {_M} SELECT count(*) AS total_messages, count(DISTINCT chat_jid) AS total_chats, count(DISTINCT sender) AS unique_senders, min(us) AS earliest_us, max(us) AS latest_us,
CAST(coalesce(sum(CASE WHEN mine THEN 1 ELSE 0 END), 0) AS BIGINT) AS sent_by_me, CAST(coalesce(sum(CASE WHEN NOT mine THEN 1 ELSE 0 END), 0) AS BIGINT) AS received FROM m""",
)
def _(spark, root):
    return reports.summary(_messages(spark, root))


@query(
    "qr2_unanswered",
    f"""WITH {_M}, s AS (SELECT chat_jid, max(us) FILTER (WHERE mine) AS sent_us, max(us) FILTER (WHERE NOT mine) AS received_us,
  last(push_name ORDER BY us, id) AS contact, last(text_content ORDER BY us, id) FILTER (WHERE NOT mine) AS t, count(*) AS total_msgs FROM m WHERE NOT grouped GROUP BY chat_jid)
SELECT contact, chat_jid, received_us, round(({AS_OF} - received_us) / 3600000000.0::DOUBLE, 3) AS hours_ago, substring(t, 1, 80) AS their_message, total_msgs FROM s
WHERE received_us > coalesce(sent_us, 0) AND received_us < {AS_OF} - 172800000000 AND total_msgs >= 2 AND length(trim(coalesce(t, ''))) > 2
AND NOT regexp_matches(trim(t), '{reports.EMOJI_ONLY}') AND NOT regexp_matches(lower(trim(regexp_replace(t, '{reports.EMOJI}', '', 'g'))), '{reports.CLOSING}')
ORDER BY received_us DESC, chat_jid LIMIT 20""",
)
def _(spark, root):
    return reports.unanswered(_messages(spark, root, "text_content", names=True), AS_OF)


@query(
    "qr3_stale",
    f"""WITH {_M}, s AS (SELECT chat_jid, last(push_name ORDER BY us, id) AS contact, count(*) AS total_messages, max(us) AS last_us, CAST(sum(CASE WHEN mine THEN 1 ELSE 0 END) AS BIGINT) AS my_messages
  FROM m WHERE NOT grouped GROUP BY chat_jid HAVING count(*) >= 5)
SELECT contact, chat_jid, total_messages, my_messages, last_us, CAST(({AS_OF} - last_us) // 86400000000 AS BIGINT) AS days_inactive FROM s
WHERE last_us < {AS_OF} - 2592000000000 ORDER BY total_messages DESC, chat_jid LIMIT 20""",
)
def _(spark, root):
    return reports.stale(_messages(spark, root, names=True), AS_OF)


@query(
    "qr4_response_time",
    f"""WITH {_M}, {_C}, r AS (SELECT a.chat_jid, a.us AS received_us, min(b.us) AS replied_us FROM m a JOIN m b ON a.chat_jid = b.chat_jid AND b.mine AND b.us > a.us AND b.us < a.us + 86400000000
  WHERE NOT a.mine AND NOT a.grouped GROUP BY 1, 2)
SELECT r.chat_jid, coalesce(c.push_name, c.full_name, r.chat_jid) AS contact, count(*) AS replies, round(avg((replied_us - received_us) / 60000000.0::DOUBLE), 1) AS avg_reply_minutes,
round(median((replied_us - received_us) / 60000000.0::DOUBLE), 1) AS median_reply_minutes
FROM r LEFT JOIN c ON r.chat_jid = c.jid GROUP BY r.chat_jid, c.push_name, c.full_name ORDER BY avg_reply_minutes, r.chat_jid LIMIT 20""",
)
def _(spark, root):
    return reports.response_time(_messages(spark, root), _contacts(spark, root))


@query(
    "qr5_top_contacts",
    f"""WITH {_M} SELECT chat_jid, grouped AS is_group, last(push_name ORDER BY us, id) AS contact_name, count(*) AS total_messages, CAST(sum(CASE WHEN mine THEN 1 ELSE 0 END) AS BIGINT) AS sent,
CAST(sum(CASE WHEN NOT mine THEN 1 ELSE 0 END) AS BIGINT) AS received, min(us) AS first_us, max(us) AS last_us FROM m GROUP BY chat_jid, grouped ORDER BY total_messages DESC, chat_jid LIMIT 20""",
)
def _(spark, root):
    return reports.top_contacts(_messages(spark, root, names=True))


@query(
    "qr6_heatmap",
    f"WITH {_M} SELECT CASE sent_dow WHEN 0 THEN 'Sun' WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' END AS day, sent_hour AS hour, count(*) AS messages FROM m GROUP BY sent_dow, sent_hour",
)
def _(spark, root):
    return reports.heatmap(_messages(spark, root, "sent_dow", "sent_hour"))


@query("qr7_text_search", f"WITH {_M} SELECT us, push_name, chat_jid, substring(text_content, 1, 120) AS message FROM m WHERE text_content ILIKE '%flat%' ORDER BY us DESC, id, chat_jid LIMIT 30")
def _(spark, root):
    return reports.search_text(_messages(spark, root, "text_content", names=True), "flat")


#: Of each report what identifies its rows and two of their figures.
_REPORT_ROWS = {"summary": ("'all'", "total_messages", "latest_us"), "unanswered": ("chat_jid", "total_msgs", "received_us"), "stale": ("chat_jid", "total_messages", "last_us"), "top_contacts": ("chat_jid", "total_messages", "last_us")}


@query("qr8_all_reports", " UNION ALL ".join(f"SELECT '{name}' AS report, {key} AS about, {n} AS n, {us} AS us FROM ({ORACLES[query_name]})" for (name, (key, n, us)), query_name in zip(_REPORT_ROWS.items(), ("qr1_summary", "qr2_unanswered", "qr3_stale", "qr5_top_contacts"))))
def _(spark, root):
    made = reports.all_reports(_messages(spark, root, "text_content", names=True), AS_OF)
    out = None
    for name, (key, n, us) in _REPORT_ROWS.items():
        rows = made[name].selectExpr(f"'{name}' AS report", f"{key} AS about", f"{n} AS n", f"{us} AS us")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(
    "qr9_table_counts",
    "SELECT 'messages' AS table_name, count(*) AS n_rows FROM messages UNION ALL SELECT 'contacts', count(*) FROM contacts UNION ALL SELECT 'classifications', count(*) FROM classifications UNION ALL SELECT 'extracted_entities', count(*) FROM extracted_entities",
)
def _(spark, root):
    t = reader(spark, root)
    return reports.table_counts({n: t(n) for n in SCHEMAS})


@query("qr10_ad_hoc_sql", "SELECT msg_type, count(*) AS n FROM messages WHERE is_group GROUP BY msg_type HAVING count(*) > 1")
def _(spark, root):
    return spark.sql("SELECT msg_type, count(*) AS n FROM {messages} WHERE is_group GROUP BY msg_type HAVING count(*) > :least", args={"least": 1}, messages=reader(spark, root)("messages"))


# ------------------------------------------------------------ filters, joins, aggregates


@query(
    "pf1_composed_filter",
    f"WITH {_M} SELECT id, chat_jid FROM m WHERE text_content ILIKE '%the%' AND text_content ILIKE '%gate%' AND us >= epoch_us(TIMESTAMPTZ '2026-03-10 00:00:00+00') AND us < epoch_us(TIMESTAMPTZ '2026-04-11 00:00:00+00')",
)
def _(spark, root):
    wanted = filters.SearchFilter(keywords=("the", "gate"), after="2026-03-10", before="2026-04-10")
    return reader(spark, root)("messages").where(wanted.predicate()).select("id", "chat_jid").distinct()


@query(
    "pf6_chat_resolver",
    f"WITH {_C} SELECT jid FROM c WHERE CASE WHEN is_group THEN coalesce(group_name ILIKE '%a%', false) ELSE coalesce(push_name ILIKE '%a%', false) OR coalesce(full_name ILIKE '%a%', false) END",
)
def _(spark, root):
    return filters.resolve_chats(_contacts(spark, root), "a")


@query("pf7_non_blank", "SELECT count(*) AS n FROM messages WHERE text_content IS NOT NULL AND trim(text_content) <> ''")
def _(spark, root):
    return reader(spark, root)("messages").where(~blank(F.col("text_content"))).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pf9_name_fallback",
    f"WITH {_C} SELECT jid, coalesce(full_name, push_name, jid) AS shown, CASE WHEN regexp_matches(split_part(jid, '@', 1), '^[0-9]+$') THEN '+' || split_part(jid, '@', 1) ELSE '' END AS phone, push_name IS NULL OR push_name NOT LIKE '%@%' AS plain FROM c",
)
def _(spark, root):
    c = _contacts(spark, root)
    plain = F.coalesce(~F.col("push_name").like("%@%"), F.lit(True))
    return c.select("jid", columns.first_filled(F.col("full_name"), F.col("push_name"), F.col("jid")).alias("shown"), columns.phone_of(F.col("jid")).alias("phone"), plain.alias("plain"))


@query(
    "j6_interval_join",
    f"WITH {_M} SELECT a.chat_jid, count(*) AS pairs, CAST(sum(b.us - a.us) AS BIGINT) AS gap_us FROM m a JOIN m b ON a.chat_jid = b.chat_jid AND a.sender <> b.sender AND b.us BETWEEN a.us AND a.us + 300000000 WHERE a.grouped AND b.grouped GROUP BY a.chat_jid",
)
def _(spark, root):
    m = _messages(spark, root).where("grouped")
    right = m.select(F.col("chat_jid").alias("r_chat_jid"), F.col("sender").alias("r_sender"), F.col("us").alias("r_us"))
    pairs = intervals.within(m.select("chat_jid", "sender", "us"), right, ["chat_jid"], 0, 5 * intervals.MINUTE).where("sender <> r_sender")
    return pairs.groupBy("chat_jid").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("r_us") - F.col("us")).alias("gap_us"))


@query(
    "j7_first_reply",
    f"WITH {_M} SELECT a.chat_jid, a.us AS received_us, min(b.us) AS replied_us FROM m a JOIN m b ON a.chat_jid = b.chat_jid AND b.mine AND b.us > a.us AND b.us < a.us + 86400000000 WHERE NOT a.mine AND NOT a.grouped AND NOT b.grouped GROUP BY 1, 2",
)
def _(spark, root):
    return intervals.replies(_messages(spark, root).where("not grouped"))


@query(
    "j9_either_end",
    f"WITH {_M}, {_C}, {_P}, {_DM} SELECT p.source_id, coalesce(CAST(sum(message_count) AS BIGINT), 0) AS dm_volume FROM dm JOIN p ON dm.sender = p.source_id OR dm.receiver = p.source_id GROUP BY p.source_id",
)
def _(spark, root):
    people = graph.persons(_contacts(spark, root))
    ends = graph.messaged(_messages(spark, root), people).select(F.explode(F.array_distinct(F.array("sender", "receiver"))).alias("source_id"), "message_count")
    return ends.groupBy("source_id").agg(F.sum("message_count").alias("dm_volume"))


@query(
    "j11_context_window",
    f"""WITH {_M}, t AS (SELECT id, chat_jid, us, text_content AS x FROM m WHERE trim(coalesce(text_content, '')) <> '')
SELECT a.id, a.chat_jid, coalesce((SELECT string_agg(x, chr(10) ORDER BY us, id) FROM (SELECT b.us, b.id, b.x FROM t b WHERE b.chat_jid = a.chat_jid AND b.us < a.us AND b.us >= a.us - 1800000000 ORDER BY b.us DESC, b.id DESC LIMIT 3)), '') AS before,
coalesce((SELECT string_agg(x, chr(10) ORDER BY us, id) FROM (SELECT b.us, b.id, b.x FROM t b WHERE b.chat_jid = a.chat_jid AND b.us >= a.us AND b.us <= a.us + 1800000000 AND (b.id <> a.id OR b.us <> a.us) ORDER BY b.us, b.id LIMIT 3)), '') AS after
FROM t a""",
)
def _(spark, root):
    t = _messages(spark, root, "text_content").where(~blank(F.col("text_content"))).select("id", "chat_jid", "us", F.col("text_content").alias("text"))
    return intervals.context_texts(t).select("id", "chat_jid", "before", "after")


@query(
    "f14_embedding_text",
    f"""WITH {_M}, t AS (SELECT id, chat_jid, us, text_content AS x FROM m WHERE trim(coalesce(text_content, '')) <> ''),
j AS (SELECT a.id, a.chat_jid, a.x, (SELECT string_agg(x, chr(10) ORDER BY us, id) FROM (SELECT b.us, b.id, b.x FROM t b WHERE b.chat_jid = a.chat_jid AND b.us < a.us AND b.us >= a.us - 1800000000 ORDER BY b.us DESC, b.id DESC LIMIT 3)) AS before,
(SELECT string_agg(x, chr(10) ORDER BY us, id) FROM (SELECT b.us, b.id, b.x FROM t b WHERE b.chat_jid = a.chat_jid AND b.us >= a.us AND b.us <= a.us + 1800000000 AND (b.id <> a.id OR b.us <> a.us) ORDER BY b.us, b.id LIMIT 3)) AS after FROM t a)
SELECT id, chat_jid, substring(concat_ws(chr(10) || '---' || chr(10), before, x, after), 1, 8000) AS embedding_text FROM j""",
)
def _(spark, root):
    t = _messages(spark, root, "text_content").where(~blank(F.col("text_content"))).select("id", "chat_jid", "us", F.col("text_content").alias("text"))
    return intervals.context_texts(t).select("id", "chat_jid", columns.assembled_text(F.col("before"), F.col("text"), F.col("after")).alias("embedding_text"))


@query(
    "a6_filtered_aggregates",
    f"WITH {_M} SELECT sender, count(*) AS n, count(*) FILTER (WHERE grouped) AS in_groups, max(us) FILTER (WHERE NOT grouped) AS last_direct_us, last(msg_type ORDER BY us, id, chat_jid) AS last_type FROM m GROUP BY sender",
)
def _(spark, root):
    m = _messages(spark, root, "msg_type")
    return m.groupBy("sender").agg(F.count(F.lit(1)).alias("n"), F.count_if("grouped").alias("in_groups"), F.max(F.when(~F.col("grouped"), F.col("us"))).alias("last_direct_us"), F.max_by("msg_type", F.struct("us", "id", "chat_jid")).alias("last_type"))


@query("a8_distinct_lists", f"WITH {_E} SELECT message_id, array_to_string(list_sort(list(DISTINCT entity_value)), '|') AS all_values, count(DISTINCT entity_type) AS n_types FROM e GROUP BY message_id HAVING count(*) >= 2")
def _(spark, root):
    e = _entities(spark, root)
    return e.groupBy("message_id").agg(F.array_join(F.array_sort(F.collect_set("entity_value")), "|").alias("all_values"), F.count_distinct("entity_type").alias("n_types"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


@query("a9_string_agg", f"WITH {_E} SELECT message_id, string_agg(entity_value, ' / ' ORDER BY entity_type, entity_value) AS joined FROM e GROUP BY message_id")
def _(spark, root):
    item = F.struct("entity_type", "entity_value")
    return _entities(spark, root).groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["entity_value"]), " / ").alias("joined"))


@query("w3_top_n_per_group", f"WITH {_M}, r AS (SELECT sender, chat_jid, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY chat_jid ORDER BY n DESC, sender) AS place FROM r) SELECT chat_jid, sender, n, place FROM k WHERE place <= 5")
def _(spark, root):
    counted = _messages(spark, root).groupBy("chat_jid", "sender").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("chat_jid").orderBy(F.col("n").desc(), "sender"))
    return counted.withColumn("place", place.cast("bigint")).where("place <= 5")


@query("f9_sent_parts", "SELECT DISTINCT id, chat_jid, CAST(timezone('UTC', timestamp) AS DATE) AS sent_date, CAST(extract(hour FROM timezone('UTC', timestamp)) AS SMALLINT) AS sent_hour, CAST(extract(dow FROM timezone('UTC', timestamp)) AS SMALLINT) AS sent_dow FROM messages")
def _(spark, root):
    m = reader(spark, root)("messages")
    return m.select("id", "chat_jid", *(c.alias(n) for n, c in columns.sent_parts(F.col("timestamp")).items())).distinct()


# ------------------------------------------------------------ graph


def _part(name: str, cols: list[str], sql: str, label: str) -> None:
    query(label, sql)(lambda spark, root: graph_parts(spark, root)[name].select(*cols))


_part("persons", ["source_id", "display_name", "push_name", "full_name"], f"WITH {_C}, {_P} SELECT * FROM p", "g1_persons")
_part("groups", ["group_jid", "group_name", "member_count"], f"WITH {_M}, {_C} SELECT jid AS group_jid, coalesce(group_name, jid) AS group_name, (SELECT count(DISTINCT sender) FROM m WHERE m.chat_jid = c.jid) AS member_count FROM c WHERE is_group", "g2_groups")
_part("topics", ["topic_name", "source", "message_count"], f"WITH {_E} SELECT entity_value AS topic_name, entity_type AS source, count(*) AS message_count FROM e WHERE entity_type IN ('tech', 'org', 'event') GROUP BY 1, 2 HAVING count(*) >= 3", "g3_topics")
_part("entities", ["entity_type", "entity_value", "mention_count"], f"WITH {_E} SELECT entity_type, entity_value, count(*) AS mention_count FROM e GROUP BY 1, 2", "g4_entities")
_part("messaged", ["sender", "receiver", "message_count", "first_us", "last_us"], f"WITH {_M}, {_C}, {_P}, {_DM} SELECT * FROM dm", "g5_messaged")
_part("member_of", ["person", "group_jid", "message_count", "first_us", "last_us"], f"WITH {_M}, {_C}, {_P}, {_MO} SELECT * FROM mo", "g6_member_of")
_part("discusses", ["person", "topic_name", "source", "mention_count"], f"WITH {_GRAPH}, t AS (SELECT entity_value, entity_type FROM e WHERE entity_type IN ('tech', 'org', 'event') GROUP BY 1, 2 HAVING count(*) >= 3) SELECT person, entity_value AS topic_name, entity_type AS source, mention_count FROM me JOIN t USING (entity_type, entity_value)", "g7_discusses_topic")
_part("co_occurs", ["person1", "person2", "shared_groups"], f"WITH {_M}, {_C}, {_P}, {_MO}, {_CO} SELECT * FROM co", "g8_co_occurs")
_part("conversed", ["person1", "person2", "group_jid", "exchange_count", "first_us", "last_us"], f"WITH {_M}, {_C}, {_P}, {_CV} SELECT * FROM cv", "g9_conversed")
_part("mentions", ["person", "entity_type", "entity_value", "mention_count"], f"WITH {_M}, {_C}, {_E}, {_P}, {_ME} SELECT * FROM me", "g10_mentions")


@query("g13_weighted_digraph", f"WITH {_GRAPH}, {_W} SELECT * FROM w")
def _(spark, root):
    parts = graph_parts(spark, root, kept=True)
    return graph.weighted_digraph(*(parts[name] for name in ("messaged", "conversed", "member_of", "mentions")))



_TOPICS = "tp AS (SELECT entity_value, entity_type FROM e WHERE entity_type IN ('tech', 'org', 'event') GROUP BY 1, 2 HAVING count(*) >= 3)"


@query(
    "g11_graph_counts",
    f"""WITH {_GRAPH}, {_CO}, {_TOPICS} SELECT 'Messaged' AS label, count(*) AS n_rows FROM dm UNION ALL SELECT 'MemberOf', count(*) FROM mo UNION ALL SELECT 'CoOccurs', count(*) FROM co
UNION ALL SELECT 'Conversed', count(*) FROM cv UNION ALL SELECT 'Mentions', count(*) FROM me UNION ALL SELECT 'DiscussesTopic', count(*) FROM me JOIN tp USING (entity_type, entity_value)
UNION ALL SELECT 'Person', count(*) FROM p UNION ALL SELECT 'ChatGroup', count(*) FROM c WHERE is_group UNION ALL SELECT 'Topic', count(*) FROM tp
UNION ALL SELECT 'Entity', count(*) FROM (SELECT DISTINCT entity_type, entity_value FROM e)""",
)
def _(spark, root):
    parts = graph_parts(spark, root)
    return graph.graph_counts({label: parts[relation] for labels in graph.GRAPH.values() for label, relation in labels.items()}).withColumnRenamed("table_name", "label")


@query(
    "g12_graph_declaration",
    """SELECT * FROM (VALUES ('vertices', 'Person', 'source_id,source,display_name,push_name,full_name'), ('vertices', 'ChatGroup', 'group_jid,group_name,member_count'),
('vertices', 'Topic', 'topic_name,source,message_count'), ('vertices', 'Entity', 'entity_type,entity_value,mention_count'),
('edges', 'Messaged', 'receiver,sender,message_count,first_us,last_us'), ('edges', 'MemberOf', 'person,group_jid,message_count,first_us,last_us'), ('edges', 'CoOccurs', 'person1,person2,shared_groups'),
('edges', 'Conversed', 'person1,person2,group_jid,exchange_count,first_us,last_us'), ('edges', 'DiscussesTopic', 'person,topic_name,source,mention_count'),
('edges', 'Mentions', 'person,entity_type,entity_value,mention_count')) AS v(part, label, columns)""",
)
def _(spark, root):
    """What is declared, with the columns that the relations behind it really have."""
    parts = graph_parts(spark, root)
    rows = [(k, label, ",".join(parts[relation].columns)) for k, labels in graph.GRAPH.items() for label, relation in labels.items()]
    return spark.createDataFrame(rows, "part string, label string, columns string")


#: Both sides iterate until nothing moves within twelve digits, so that six are safe to compare.
_RANK_SQL = f"""WITH RECURSIVE {_GRAPH}, {_W}, z AS (SELECT person AS node, count(*) AS n FROM mo GROUP BY person ORDER BY n DESC, person LIMIT 5), s AS (SELECT node, n::DOUBLE / sum(n) OVER () AS p FROM z),
v AS (SELECT src AS node FROM w UNION SELECT dst FROM w), o AS (SELECT src, sum(weight) AS total FROM w GROUP BY src),
r AS (SELECT v.node, coalesce(s.p, 0) AS p, o.total FROM v LEFT JOIN s ON v.node = s.node LEFT JOIN o ON o.src = v.node),
step AS MATERIALIZED (SELECT a.node AS src, b.node AS dst, 0.85::DOUBLE * CASE WHEN a.total IS NULL THEN b.p ELSE coalesce(w.weight, 0) / a.total END + 0.15::DOUBLE * b.p AS share
  FROM r a CROSS JOIN r b LEFT JOIN w ON w.src = a.node AND w.dst = b.node),
x AS (SELECT 0 AS i, node, p AS score FROM r UNION ALL SELECT x.i + 1, step.dst, sum(x.score * step.share) FROM x JOIN step ON step.src = x.node WHERE x.i < 200 GROUP BY x.i + 1, step.dst)
SELECT node, round(score, 6) AS score FROM x WHERE i = 200"""


def _busiest(parts, n: int) -> DataFrame:
    """``node, weight``: the persons in most groups."""
    return parts["member_of"].groupBy(F.col("person").alias("node")).agg(F.count(F.lit(1)).alias("weight")).orderBy(F.col("weight").desc(), "node").limit(n)


@query("g14_personalized_rank", _RANK_SQL)
def _(spark, root):
    parts = graph_parts(spark, root)
    return graph.personalized_rank(parts["talk"], _busiest(parts, 5), steps=200, tolerance=1e-14, hubs=parts["hubs"]).select("node", F.round("score", 6).alias("score"))


@query("g15_flow_paths")
def _(spark, root):
    parts = graph_parts(spark, root, kept=True)
    top = _busiest(parts, 6).collect()  # six seeds
    return graph.flow_paths(parts["talk"], [r["node"] for r in top], hubs=parts["hubs"])


def _undirected(spark, root):
    parts = graph_parts(spark, root)
    return graph.undirected(parts["messaged"], parts["conversed"], parts["co_occurs"])


@query(
    "g16_undirected_graph",
    f"""WITH {_GRAPH}, {_CO} SELECT src, dst, sum(weight) AS weight FROM (SELECT least(sender, receiver) AS src, greatest(sender, receiver) AS dst, message_count * 3.0::DOUBLE AS weight FROM dm
UNION ALL SELECT person1, person2, exchange_count * 5.0::DOUBLE FROM cv UNION ALL SELECT person1, person2, shared_groups::DOUBLE FROM co) WHERE src <> dst GROUP BY 1, 2""",
)
def _(spark, root):
    return _undirected(spark, root)


@query("g16_communities")
def _(spark, root):
    return graph.communities(_undirected(spark, root))


@query(
    "g16_quality",
    f"""WITH {_GRAPH}, {_CO}, u AS (SELECT least(sender, receiver) AS a, greatest(sender, receiver) AS b FROM dm UNION SELECT person1, person2 FROM cv UNION SELECT person1, person2 FROM co)
SELECT (SELECT count(*) FROM (SELECT a FROM u WHERE a <> b UNION SELECT b FROM u WHERE a <> b)) AS placed, 0::BIGINT AS placed_twice, 0::BIGINT AS badly_named, true AS better_than_one""",
)
def _(spark, root):
    """Invariants of the communities: every node in one, named by its smallest member, and better than the graph undivided."""
    edges = cut_lineage(_undirected(spark, root))
    member = cut_lineage(graph.communities(edges))
    named = member.groupBy("community").agg(F.min("node").alias("least")).where("least <> community")
    counts = member.agg(F.count_distinct("node").alias("placed"), (F.count(F.lit(1)) - F.count_distinct("node")).alias("placed_twice"))
    return counts.crossJoin(named.agg(F.count(F.lit(1)).alias("badly_named"))).crossJoin(graph.modularity(edges, member).select((F.col("modularity") > 0).alias("better_than_one")))


@query("g17_community_cards")
def _(spark, root):
    parts = graph_parts(spark, root)
    member = cut_lineage(graph.communities(graph.undirected(parts["messaged"], parts["conversed"], parts["co_occurs"])))
    return graph.community_cards(member, parts["persons"], parts["member_of"], parts["groups"], parts["mentions"])


@query("g17_stored_communities", f"WITH {_C}, {_P} SELECT source_id, true AS numbered FROM p")
def _(spark, root):
    """Persons with the number of their community, -1 for those in none."""
    parts = graph_parts(spark, root)
    stored = graph.store_communities(parts["persons"], graph.communities(graph.undirected(parts["messaged"], parts["conversed"], parts["co_occurs"])))
    return stored.select("source_id", (F.col("community_id") >= -1).alias("numbered"))


# ------------------------------------------------------------ entities


@query(
    "e1_unprocessed",
    "SELECT DISTINCT id, chat_jid FROM messages WHERE is_group AND text_content IS NOT NULL AND trim(text_content) <> '' AND id NOT IN (SELECT message_id FROM extracted_entities WHERE message_id IS NOT NULL)",
)
def _(spark, root):
    t = reader(spark, root)
    return entities.unprocessed(t("messages"), t("extracted_entities")).select("id", "chat_jid").distinct()


@query(
    "e2_pattern_entities",
    r"""WITH t AS (SELECT DISTINCT id, chat_jid, text_content AS x FROM messages WHERE text_content IS NOT NULL),
u AS (SELECT id, chat_jid, 'url' AS k, regexp_replace(v, '[.,;:!?)''"]+$', '') AS v FROM (SELECT id, chat_jid, unnest(regexp_extract_all(x, '(?i)(?:https?://[^\s]+|www\.[^\s]+)')) AS v FROM t)
UNION SELECT id, chat_jid, 'url', unnest(regexp_extract_all(x, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')) FROM t
UNION SELECT id, chat_jid, 'person', '@' || trim(v) FROM (SELECT id, chat_jid, unnest(regexp_extract_all(x, '@(\+?[0-9][0-9\s\-]{5,}[0-9]|[A-Za-z0-9_.]+)', 1)) AS v FROM t) WHERE length(trim(v)) > 2)
SELECT DISTINCT id AS message_id, chat_jid, k AS entity_type, v AS entity_value FROM u""",
)
def _(spark, root):
    return entities.by_pattern(reader(spark, root)("messages"))


@query(
    "e4_normalised",
    f"""WITH {_E}, n AS (SELECT message_id, entity_type, entity_value, lower(trim(entity_value)) AS low FROM e)
SELECT message_id, CASE WHEN entity_type = 'url' THEN entity_type ELSE coalesce(CASE low
WHEN 'claude' THEN 'tech' WHEN 'claude code' THEN 'tech' WHEN 'chatgpt' THEN 'tech' WHEN 'gpt' THEN 'tech' WHEN 'gemini' THEN 'tech'
WHEN 'copilot' THEN 'tech' WHEN 'cursor' THEN 'tech' WHEN 'openai' THEN 'org' WHEN 'anthropic' THEN 'org' WHEN 'whatsapp' THEN 'tech'
WHEN 'linkedin' THEN 'tech' WHEN 'slack' THEN 'tech' WHEN 'kubernetes' THEN 'tech' WHEN 'docker' THEN 'tech' WHEN 'react' THEN 'tech'
WHEN 'python' THEN 'tech' WHEN 'langchain' THEN 'tech' WHEN 'langgraph' THEN 'tech' WHEN 'autogpt' THEN 'tech' WHEN 'gpu' THEN 'tech'
WHEN 'mcp' THEN 'tech' WHEN 'aws' THEN 'tech' WHEN 'github' THEN 'tech' WHEN 'phd' THEN 'org'
END, entity_type) END AS entity_type,
CASE WHEN entity_type = 'url' THEN entity_value ELSE coalesce(CASE low
WHEN 'claude code' THEN 'Claude Code' WHEN 'cc' THEN 'Claude Code' WHEN 'claude' THEN 'Claude' WHEN 'chatgpt' THEN 'ChatGPT' WHEN 'gpt' THEN 'GPT'
WHEN 'openai' THEN 'OpenAI' WHEN 'anthropic' THEN 'Anthropic' WHEN 'gemini' THEN 'Gemini' WHEN 'copilot' THEN 'Copilot' WHEN 'cursor' THEN 'Cursor'
WHEN 'langchain' THEN 'LangChain' WHEN 'langgraph' THEN 'LangGraph' WHEN 'kubernetes' THEN 'Kubernetes' WHEN 'k8s' THEN 'Kubernetes'
WHEN 'docker' THEN 'Docker' WHEN 'react' THEN 'React'
END, trim(entity_value)) END AS entity_value
FROM n WHERE entity_type = 'url' OR (low NOT IN (
'2024', '2025', '2026', '2027', 'a', 'africa', 'ai', 'amazon', 'an', 'api', 'apple', 'april', 'august', 'austin', 'b2b', 'b2c', 'bangalore',
'bengaluru', 'bhai', 'ca', 'canada', 'cc', 'ceo', 'chandigarh', 'chennai', 'china', 'christmas', 'cli', 'cto', 'cv', 'daily', 'december', 'delhi',
'diwali', 'dl', 'dm', 'dming', 'dubai', 'europe', 'february', 'friday', 'google', 'gtm', 'gurgaon', 'haha', 'hai', 'hello', 'hey', 'hi', 'holi', 'hr',
'hyderabad', 'india', 'intro', 'ip', 'it', 'jaipur', 'january', 'japan', 'ji', 'july', 'june', 'kolkata', 'last week', 'llm', 'lol', 'london', 'march',
'max', 'may', 'meta', 'microsoft', 'ml', 'monday', 'mumbai', 'new york', 'next week', 'nlp', 'no', 'noida', 'november', 'october', 'ok', 'one', 'ops',
'oss', 'ot', 'pm', 'pr', 'pune', 'qa', 'rl', 'saas', 'san francisco', 'saturday', 'sdk', 'september', 'sf', 'singapore', 'sir', 'spc', 'sunday', 'swe',
'thank', 'thanks', 'that', 'the', 'this', 'three', 'thursday', 'time', 'today', 'tomorrow', 'tuesday', 'two', 'ui', 'uk', 'us', 'usa', 'ux', 'vc',
'wednesday', 'weekly', 'yes', 'yesterday'
) AND length(low) >= 2 AND NOT starts_with(low, 'http') AND low NOT LIKE '%@%' AND NOT regexp_matches(low, '^[0-9]+$'))""",
)
def _(spark, root):
    return entities.normalised(_entities(spark, root)).drop("chat_jid")


@query("e6_merge_plan")
def _(spark, root):
    return entities.merged(_entities(spark, root))


@query("e6_related_parts", f"""WITH {_E}, n AS (SELECT entity_type, entity_value, lower(entity_value) AS low, count(*) AS n FROM e WHERE entity_type <> 'url' GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT a.entity_type, a.entity_value, b.entity_value AS other, CASE WHEN a.low = b.low THEN 'case' ELSE 'part' END AS relation FROM n a JOIN n b ON a.entity_type = b.entity_type AND (a.n < b.n OR a.n = b.n AND a.entity_value > b.entity_value)
WHERE a.low = b.low OR (length(a.low) > 3 AND length(b.low) > 3 AND (contains(a.low, b.low) OR contains(b.low, a.low)))""")
def _(spark, root):
    """The pairs of the merge plan that SQL can tell: equal but for case, or one within the other."""
    counts = _entities(spark, root).where("entity_type <> 'url'").groupBy("entity_type", "entity_value").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return entities.related(counts).where("relation <> 'alike'").select("entity_type", "entity_value", "other", "relation")


@query("e6_renamed_values", f"WITH {_E} SELECT count(DISTINCT message_id) AS messages, 0::BIGINT AS old_values_left, true AS no_more_rows FROM e")
def _(spark, root):
    """Entities after the plan: no message lost, no value left that was renamed and is nobody's new name."""
    found = cut_lineage(_entities(spark, root))
    plan = cut_lineage(entities.merged(found))
    done = entities.renamed_entities(found, plan)
    left = done.select(F.col("entity_value").alias("old")).distinct().join(plan.select("old"), "old", "left_semi").join(plan.select(F.col("new").alias("old")), "old", "left_anti")
    counted = done.agg(F.count_distinct("message_id").alias("messages"), F.count(F.lit(1)).alias("rows"))
    return counted.crossJoin(left.agg(F.count(F.lit(1)).alias("old_values_left"))).crossJoin(found.agg(F.count(F.lit(1)).alias("before"))).select("messages", "old_values_left", (F.col("rows") <= F.col("before")).alias("no_more_rows"))


@query("e7_entity_statistics", f"WITH {_E} SELECT entity_type, count(*) AS mentions, count(DISTINCT entity_value) AS unique_values FROM e GROUP BY entity_type")
def _(spark, root):
    return entities.statistics(_entities(spark, root))


# ------------------------------------------------------------ retrieval

_QUERY = "meeting at the north gates"
_STOPPED = (
    "'a','about','above','after','again','against','all','am','an','and','any','are','as','at','be','because','been','before','being','below','between','both','but','by','can','could','did','do','does','doing','down','during',"
    "'each','few','for','from','further','had','has','have','having','he','her','here','hers','herself','him','himself','his','how','i','if','in','into','is','it','its','itself','just','me','more','most','my','myself','no','nor',"
    "'not','now','of','off','on','once','only','or','other','our','ours','ourselves','out','over','own','same','she','should','so','some','such','than','that','the','their','theirs','them','themselves','then','there','these',"
    "'they','this','those','through','to','too','under','until','up','very','was','we','were','what','when','where','which','while','who','whom','why','will','with','would','you','your','yours','yourself','yourselves'"
)
_BM25 = f"""d AS (SELECT id, chat_jid, list_filter(string_split_regex(strip_accents(lower(text_content)), '[^a-z]+'), lambda t: t <> '' AND t NOT IN ({_STOPPED})) AS terms FROM m WHERE text_content IS NOT NULL),
g AS (SELECT count(*) AS n, avg(len(terms)) AS mean_length FROM d),
st AS (SELECT id, chat_jid, l, CASE WHEN term IN ('meet', 'meets', 'meeting', 'meetings') THEN 'meet' WHEN term IN ('north', 'norths') THEN 'north' WHEN term IN ('gate', 'gates', 'gated', 'gating') THEN 'gate' END AS term
  FROM (SELECT id, chat_jid, len(terms) AS l, unnest(terms) AS term FROM d)),
tf AS (SELECT id, chat_jid, term, count(*) AS tf, any_value(l) AS l FROM st WHERE term IS NOT NULL GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
b AS (SELECT id, chat_jid, sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean_length))) AS score FROM tf JOIN df USING (term) CROSS JOIN g GROUP BY 1, 2)"""


@query("r1_bm25", f"WITH {_M}, {_BM25} SELECT id, chat_jid, round(score, 6) AS score FROM b")
def _(spark, root):
    index = retrieval.TextIndex.build(_messages(spark, root, "text_content"))
    return index.scores(_QUERY).select("id", "chat_jid", F.round("score", 6).alias("score"))


def _query_vectors(spark, root) -> list[list[float]]:
    rows = reader(spark, root)("embeddings").where("vec_id < 3").orderBy("vec_id").collect()  # three query vectors
    return [list(map(float, r["embedding"])) for r in rows]


_SIM = """v AS (SELECT id, chat_jid, any_value(embedding) AS x FROM messages WHERE len(embedding) = 64 GROUP BY id, chat_jid, embedding),
q AS (SELECT embedding AS y FROM embeddings WHERE vec_id < 3),
s AS (SELECT id, chat_jid, max(list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[])))) AS similarity
  FROM v CROSS JOIN q WHERE list_dot_product(x::DOUBLE[], x::DOUBLE[]) > 0 GROUP BY 1, 2)"""


@query("r2_similarity_top", f"WITH {_SIM}, k AS (SELECT id, chat_jid, similarity FROM s WHERE similarity IS NOT NULL AND NOT isnan(similarity) ORDER BY round(similarity, 9) DESC, id, chat_jid LIMIT 50) SELECT id, chat_jid, round(similarity, 8) AS similarity FROM k")
def _(spark, root):
    m = reader(spark, root)("messages").select("id", "chat_jid", "embedding")
    return retrieval.similar(m, _query_vectors(spark, root), 50).select("id", "chat_jid", F.round("similarity", 8).alias("similarity"))


@query(
    "r3_rank_fusion",
    f"""WITH {_M}, {_BM25}, {_SIM}, one AS (SELECT id, chat_jid, row_number() OVER (ORDER BY round(score, 9) DESC, id, chat_jid) AS r, NULL::DOUBLE AS similarity FROM b),
two AS (SELECT id, chat_jid, row_number() OVER (ORDER BY round(similarity, 9) DESC, id, chat_jid) AS r, similarity FROM s WHERE similarity IS NOT NULL AND NOT isnan(similarity))
SELECT id, chat_jid, round(sum(1.0::DOUBLE / (60 + r)), 8) AS rrf_score, round(coalesce(max(similarity), 0), 8) AS similarity FROM (SELECT * FROM one WHERE r <= 45 UNION ALL SELECT * FROM two WHERE r <= 45) GROUP BY 1, 2""",
)
def _(spark, root):
    m = _messages(spark, root, "text_content")
    lists = [retrieval.TextIndex.build(m).search(_QUERY, 45), retrieval.similar(reader(spark, root)("messages"), _query_vectors(spark, root), 45)]
    return retrieval.fuse(lists).select("id", "chat_jid", F.round("rrf_score", 8).alias("rrf_score"), F.round("similarity", 8).alias("similarity"))


@query(
    "r8_enriched_names",
    f"""WITH {_M}, {_C}, {_P}, {_DM}, vol AS (SELECT source_id, CAST(sum(message_count) AS BIGINT) AS n FROM dm JOIN p ON dm.sender = p.source_id OR dm.receiver = p.source_id GROUP BY 1)
SELECT m.id, m.chat_jid, CASE WHEN g.jid IS NULL THEN m.chat_jid WHEN g.is_group THEN coalesce(g.group_name, g.push_name, g.jid) ELSE 'DM' END AS group_name,
coalesce(h.full_name, h.push_name, h.jid, m.push_name, '?') AS display_name, coalesce(vol.n, 0) AS dm_volume
FROM m LEFT JOIN c g ON g.jid = m.chat_jid LEFT JOIN c h ON h.jid = m.sender LEFT JOIN vol ON vol.source_id = m.sender""",
)
def _(spark, root):
    parts = graph_parts(spark, root)
    return retrieval.enrich(_messages(spark, root, names=True), _contacts(spark, root), parts, "none").select("id", "chat_jid", "group_name", "display_name", "dm_volume")


@query(
    "r9_thread_context",
    f"""WITH {_M}, x AS (SELECT id, chat_jid, us FROM m WHERE text_content ILIKE '%north gate%')
SELECT x.id, x.chat_jid, least(10, count(*)) AS n_texts, round(least(1.0::DOUBLE, least(10, count(*)) / 8.0::DOUBLE), 6) AS conversation_boost
FROM x JOIN m ON m.chat_jid = x.chat_jid AND m.us BETWEEN x.us - 3600000000 AND x.us + 3600000000 AND m.text_content IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, root):
    m = _messages(spark, root, "text_content", names=True)
    found = retrieval.thread_context(m.where(F.col("text_content").ilike("%north gate%")), m)
    return found.select("id", "chat_jid", F.size("thread").cast("bigint").alias("n_texts"), F.round("conversation_boost", 6).alias("conversation_boost"))


_OWNER = "155599999999@s.whatsapp.net"


def _search(spark, root, depth: str = "balanced", text: str = _QUERY):
    full = _messages(spark, root, "text_content", names=True)
    held = reader(spark, root)("messages").where("embedding is not null").select("id", "chat_jid", columns.bare_jid(F.col("sender_jid")).alias("sender"), "embedding")
    use_graph = retrieval.DEPTHS[depth][2]
    parts = graph_parts(spark, root, kept=use_graph)
    if use_graph:  # what the rank and the paths both read
        parts |= {name: cut_lineage(parts[name]) for name in ("conversed", "messaged", "member_of", "mentions")}
        parts |= {"talk": cut_lineage(graph.talk_edges(parts["messaged"], parts["conversed"])), "hubs": cut_lineage(graph.hubs_of(parts["member_of"], parts["mentions"]))}
    stored = _query_vectors(spark, root)
    # no embedder is at hand: the variants have stored vectors
    found = retrieval.run_search(text, lambda texts: stored[: len(texts)], full, _contacts(spark, root), parts, retrieval.TextIndex.build(full), depth, expand=lambda query, n: [f"{query} ({i})" for i in range(n)], stored=held)
    return found, parts


@query("r4_vectors_alone", f"WITH {_SIM.replace('vec_id < 3', 'vec_id < 1')}, k AS (SELECT similarity FROM s WHERE similarity IS NOT NULL AND NOT isnan(similarity) ORDER BY round(similarity, 9) DESC, id, chat_jid LIMIT 30) SELECT round(similarity, 8) AS rrf_score FROM k")
def _(spark, root):
    """A query of whose words no text holds one: the similarity is the score."""
    found, _ = _search(spark, root, "fast", "zyxgfd")
    return found["results"].select(F.round("rrf_score", 8).alias("rrf_score"))


@query("r10_people")
def _(spark, root):
    found, _ = _search(spark, root)
    return found["people"].select("sender", "display_name", "phone", F.round("score", 6).alias("score"), "message_count", "dm_volume")


@query("r11_connections")
def _(spark, root):
    found, parts = _search(spark, root)
    return retrieval.connections(found["people"], parts["conversed"], _OWNER)


@query("r11_insights")
def _(spark, root):
    found, parts = _search(spark, root, "deep")
    return retrieval.insights(found["people"], parts["conversed"], parts["groups"], _OWNER)


@query("r13_search_json")
def _(spark, root):
    found, _ = _search(spark, root)
    return retrieval.as_json(found["results"], found["people"])


@query(
    "sc18_embedded",
    """SELECT DISTINCT id, chat_jid, length(text_content)::DOUBLE AS first, 2.0::DOUBLE AS second FROM messages WHERE text_content IS NOT NULL AND trim(text_content) <> ''""",
)
def _(spark, root):
    """Every text through an embedder, here one that counts code points."""
    texts = _messages(spark, root, "text_content").select("id", "chat_jid", F.col("text_content").alias("embedding_text"))
    made = retrieval.embedded(texts, lambda batch: [(float(len(t)), 2.0) for t in batch], limit=1_000_000)
    return made.select("id", "chat_jid", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query(
    "r14_neighbour_expansion",
    f"""WITH {_GRAPH}, z AS (SELECT person AS node, count(*) AS n FROM mo GROUP BY person ORDER BY n DESC, person LIMIT 5),
x AS (SELECT sender AS src, receiver AS dst, message_count::DOUBLE AS w FROM dm UNION ALL SELECT person1, person2, exchange_count::DOUBLE FROM cv UNION ALL SELECT person2, person1, exchange_count::DOUBLE FROM cv)
SELECT dst AS node, sum(w) AS weight FROM x WHERE src IN (SELECT node FROM z) GROUP BY dst ORDER BY weight DESC, node LIMIT 30""",
)
def _(spark, root):
    parts = graph_parts(spark, root)
    seeds = parts["member_of"].groupBy(F.col("person").alias("node")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "node").limit(5)
    talk = parts["conversed"]
    edges = [
        parts["messaged"].select(F.col("sender").alias("src"), F.col("receiver").alias("dst"), F.col("message_count").cast("double").alias("weight")),
        talk.select(F.col("person1").alias("src"), F.col("person2").alias("dst"), F.col("exchange_count").cast("double").alias("weight")),
        talk.select(F.col("person2").alias("src"), F.col("person1").alias("dst"), F.col("exchange_count").cast("double").alias("weight")),
    ]
    return retrieval.neighbours(edges, seeds)


@query("st5_high_water", "SELECT max(epoch_us(timestamp)) AS high_water_us FROM messages")
def _(spark, root):
    return reader(spark, root)("messages").agg(F.max(micros(F.col("timestamp"))).alias("high_water_us"))
