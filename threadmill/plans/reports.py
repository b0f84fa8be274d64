"""The named reports over messages and contacts.

Every report takes the store's relations (see ``plans.store``) and a fixed
``as_of`` time in microseconds, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.columns import day_name
from threadmill.operators.intervals import DAY, HOUR, MINUTE, replies

#: Replies that need no answer, as patterns.
EMOJI_ONLY = r"^[\x{1F44D}\x{1F44C}\x{1F64F}\x{2764}\x{FE0F}\x{1F602}\x{1F60A}\x{1F525}\x{2705}\x{1F4AF}\x{1F44B}\x{1F389}\x{1F38A}\x{1F609}\x{2B50}\x{1F499}\x{1F49A}\x{1F90D}\x{1F929}\x{1F913}\x{1F917}\s]+$"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F900}-\x{1F9FF}]"
CLOSING = (
    r"^(thanks?(\s+\w+)?|thank\s+you(\s+\w+)?|ok(ay)?|sure(\s+\w+)?|done|great|nice|cool|perfect|noted|will\s+do|sounds?\s+good|got\s+it|np|no\s+worries|no\s+probs?|haha|lol|yes|ya|yep|yup|nope|no|haan(\s+sure)?|let\s+me\s+see|acha|theek\s+hai|all\s+good|good|awesome|amazing|wonderful|fantastic)"
    r"([.!,\s]+(thanks?(\s+\w+)*|thank\s+you(\s+\w+)*|got\s+it|noted|will\s+do|sure|ok|cheers|much\s+appreciated|really\s+appreciate\s+it))?[.!,\s]*$"
)


def _latest(column: str) -> F.Column:
    return F.max_by(column, F.struct("us", "id"))


def needs_answer(text) -> F.Column:
    """Longer than two characters, not emoji only and no closing phrase."""
    trimmed = F.trim(text)
    closing = F.lower(F.trim(F.regexp_replace(text, EMOJI, ""))).rlike(CLOSING)
    return (F.length(F.coalesce(trimmed, F.lit(""))) > 2) & ~trimmed.rlike(EMOJI_ONLY) & ~closing


def summary(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_distinct("chat_jid").alias("total_chats"),
        F.count_distinct("sender").alias("unique_senders"),
        F.min("us").alias("earliest_us"),
        F.max("us").alias("latest_us"),
        F.coalesce(F.sum(F.col("mine").cast("bigint")), F.lit(0)).alias("sent_by_me"),
        F.coalesce(F.sum((~F.col("mine")).cast("bigint")), F.lit(0)).alias("received"),
    )


def unanswered(messages: DataFrame, as_of_us: int, limit: int = 20) -> DataFrame:
    """Direct chats whose last received message is unanswered for two days, newest first."""
    stats = (
        messages.where(~F.col("grouped"))
        .groupBy("chat_jid")
        .agg(
            F.max(F.when(F.col("mine"), F.col("us"))).alias("sent_us"),
            F.max(F.when(~F.col("mine"), F.col("us"))).alias("received_us"),
            _latest("push_name").alias("contact"),
            F.max_by(F.when(~F.col("mine"), F.col("text_content")), F.when(~F.col("mine"), F.struct("us", "id"))).alias("their_text"),
            F.count(F.lit(1)).alias("total_msgs"),
        )
    )
    open_chats = stats.where(
        (F.col("received_us") > F.coalesce("sent_us", F.lit(0))) & (F.col("received_us") < as_of_us - 48 * HOUR) & (F.col("total_msgs") >= 2) & needs_answer(F.col("their_text"))
    )
    ranked = open_chats.orderBy(F.col("received_us").desc(), "chat_jid").limit(limit)
    return ranked.select("contact", "chat_jid", "received_us", F.round((F.lit(as_of_us) - F.col("received_us")) / float(HOUR), 3).alias("hours_ago"), F.substring("their_text", 1, 80).alias("their_message"), "total_msgs")


def stale(messages: DataFrame, as_of_us: int, days: int = 30, limit: int = 20) -> DataFrame:
    """Direct chats of five messages or more that rest for ``days``, busiest first."""
    activity = (
        messages.where(~F.col("grouped"))
        .groupBy("chat_jid")
        .agg(_latest("push_name").alias("contact"), F.count(F.lit(1)).alias("total_messages"), F.max("us").alias("last_us"), F.sum(F.col("mine").cast("bigint")).alias("my_messages"))
        .where("total_messages >= 5")
    )
    ranked = activity.where(F.col("last_us") < as_of_us - days * DAY).orderBy(F.col("total_messages").desc(), "chat_jid").limit(limit)
    return ranked.select("contact", "chat_jid", "total_messages", "my_messages", "last_us", F.floor((F.lit(as_of_us) - F.col("last_us")) / DAY).alias("days_inactive"))


def response_time(messages: DataFrame, contacts: DataFrame, limit: int | None = 20) -> DataFrame:
    """Average and median minutes to the own reply per direct chat, fastest first."""
    answered = replies(messages.where(~F.col("grouped")))
    minutes = (F.col("replied_us") - F.col("received_us")) / float(MINUTE)
    timed = answered.groupBy("chat_jid").agg(F.count(F.lit(1)).alias("replies"), F.round(F.avg(minutes), 1).alias("avg_reply_minutes"), F.round(F.median(minutes), 1).alias("median_reply_minutes"))
    named = timed.join(contacts.select(F.col("jid").alias("chat_jid"), "push_name", "full_name"), "chat_jid", "left")
    out = named.select("chat_jid", F.coalesce("push_name", "full_name", "chat_jid").alias("contact"), "replies", "avg_reply_minutes", "median_reply_minutes")
    return out.orderBy("avg_reply_minutes", "chat_jid").limit(limit) if limit else out


def top_contacts(messages: DataFrame, limit: int = 20) -> DataFrame:
    counted = messages.groupBy("chat_jid", "grouped").agg(
        _latest("push_name").alias("contact_name"),
        F.count(F.lit(1)).alias("total_messages"),
        F.sum(F.col("mine").cast("bigint")).alias("sent"),
        F.sum((~F.col("mine")).cast("bigint")).alias("received"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    )
    return counted.withColumnRenamed("grouped", "is_group").orderBy(F.col("total_messages").desc(), "chat_jid").limit(limit)


def heatmap(messages: DataFrame) -> DataFrame:
    """Messages by day of week and hour in UTC."""
    return messages.groupBy("sent_dow", "sent_hour").agg(F.count(F.lit(1)).alias("messages")).select(day_name(F.col("sent_dow")).alias("day"), F.col("sent_hour").alias("hour"), "messages")


def search_text(messages: DataFrame, term: str, limit: int = 30) -> DataFrame:
    """The newest messages whose text contains the term in any case; wildcards of the pattern are kept."""
    hits = messages.where(F.col("text_content").ilike(f"%{term}%"))
    return hits.orderBy(F.col("us").desc(), "id", "chat_jid").limit(limit).select("us", "push_name", "chat_jid", F.substring("text_content", 1, 120).alias("message"))


def all_reports(messages: DataFrame, as_of_us: int) -> dict[str, DataFrame]:
    return {"summary": summary(messages), "unanswered": unanswered(messages, as_of_us), "stale": stale(messages, as_of_us), "top_contacts": top_contacts(messages)}


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows`` of each table; one scan each, answered from file footers."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
