"""Filters of search and download, composed as one predicate that reaches the scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.columns import all_of


@dataclass(frozen=True)
class SearchFilter:
    """Keywords (all, as substrings, wildcards of the pattern kept), chats, and days from and to, both included."""

    keywords: tuple[str, ...] = ()
    chats: tuple[str, ...] = ()
    after: str | None = None
    before: str | None = None

    def predicate(self, text: str = "text_content", chat: str = "chat_jid", time: str = "timestamp") -> Column:
        parts = [F.col(text).ilike(f"%{word}%") for word in self.keywords]
        if self.chats:
            parts.append(F.col(chat).isin(*self.chats))
        if self.after:
            parts.append(F.col(time) >= F.lit(self.after).cast("timestamp"))
        if self.before:
            parts.append(F.col(time) < F.lit(self.before).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
        return all_of(parts)


def download_window(after: str | None, before: str | None, time: str = "timestamp") -> Column:
    """Times from one midnight to another; unlike in a search the last day is not included."""
    parts = []
    if after:
        parts.append(F.col(time) >= F.lit(after).cast("timestamp"))
    if before:
        parts.append(F.col(time) <= F.lit(before).cast("timestamp"))
    return all_of(parts)


def media_to_download(messages: DataFrame, after: str | None = None, before: str | None = None, chat: str | None = None, kinds: tuple[str, ...] = ("image", "video", "audio", "document", "sticker")) -> DataFrame:
    """Messages whose media is known and not yet there; order them by time on writing."""
    wanted = F.col("raw_proto").isNotNull() & ~F.coalesce("media_downloaded", F.lit(False)) & F.col("msg_type").isin(*kinds) & download_window(after, before)
    return messages.where(wanted & (F.col("chat_jid") == chat) if chat else wanted)


def resolve_chats(contacts: DataFrame, wanted: str | None) -> DataFrame | None:
    """Chats that a name may mean: ``jid``; None for no name, an error if nothing matches."""
    if not wanted:
        return None
    if "@" in wanted:
        return contacts.sparkSession.createDataFrame([(wanted,)], "jid string")
    like = f"%{wanted}%"
    group = F.coalesce("is_group", F.lit(False))
    hit = F.when(group, F.col("group_name").ilike(like)).otherwise(F.coalesce(F.col("push_name").ilike(like), F.lit(False)) | F.coalesce(F.col("full_name").ilike(like), F.lit(False)))
    found = contacts.where(hit).select("jid").distinct()
    if found.isEmpty():
        raise ValueError(f"no chat matches {wanted!r}")
    return found
