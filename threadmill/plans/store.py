"""The base tables as the plans see them: one row a key, names without empties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.functions.columns import bare_jid, filled
from threadmill.sources.tables import micros


def messages(raw: DataFrame, *columns: str, names: bool = False) -> DataFrame:
    """Distinct messages with ``us`` (time) and ``sender`` (jid without device).

    Repeats agree on all but the push name and the vector, so any of them will
    do; with ``names`` the largest push name is kept.
    """
    kept = raw.select("id", "chat_jid", micros(F.col("timestamp")).alias("us"), bare_jid(F.col("sender_jid")).alias("sender"), F.coalesce("is_from_me", F.lit(False)).alias("mine"), F.coalesce("is_group", F.lit(False)).alias("grouped"), *columns, *([filled(F.col("push_name")).alias("push_name")] if names else []))
    if not names:
        return kept.dropDuplicates(["id", "chat_jid"])
    rest = [c for c in kept.columns if c not in ("id", "chat_jid", "push_name")]
    return kept.groupBy("id", "chat_jid").agg(*(F.any_value(c).alias(c) for c in rest), F.max("push_name").alias("push_name"))


def contacts(raw: DataFrame) -> DataFrame:
    """One row a jid; of repeated rows the largest of each name is kept."""
    return raw.groupBy("jid").agg(
        *(F.max(filled(F.col(c))).alias(c) for c in ("push_name", "full_name", "business_name", "group_name")),
        F.max(F.coalesce("is_group", F.lit(False))).alias("is_group"),
    )


def entities(raw: DataFrame) -> DataFrame:
    """Distinct (message, type, value) with the chat."""
    return raw.groupBy("message_id", "entity_type", "entity_value").agg(F.min("chat_jid").alias("chat_jid"))
