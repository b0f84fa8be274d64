"""Column expressions shared by the plans; all stay inside generated code."""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings by MIME type.
EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/gif": "gif",
    "video/mp4": "mp4",
    "video/3gpp": "3gp",
    "audio/ogg": "ogg",
    "audio/mpeg": "mp3",
    "audio/mp4": "m4a",
    "application/pdf": "pdf",
}
DAYS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def filled(column: Column) -> Column:
    """Null instead of an empty text."""
    return F.nullif(column, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(filled(c) for c in columns))


def bare_jid(column: Column) -> Column:
    """A jid without its device number."""
    return F.regexp_replace(column, ":[0-9]+@", "@")


def phone_of(jid: Column) -> Column:
    """``+digits`` where the local part is all digits, else an empty text."""
    local = F.substring_index(jid, "@", 1)
    return F.when(local.rlike("^[0-9]+$"), F.concat(F.lit("+"), local)).otherwise("")


def safe_jid(jid: Column) -> Column:
    """A jid as part of a path."""
    return F.translate(jid, "@:/\\", "____")


def extension(mime: Column, kind: Column) -> Column:
    """File ending by MIME type (parameters ignored), else by message type, else ``bin``."""
    plain = F.substring_index(F.lower(mime), ";", 1)
    chosen = functools.reduce(lambda acc, kv: acc.when(plain == kv[0], kv[1]), list(EXTENSIONS.items())[1:], F.when(plain == "image/jpeg", "jpg"))
    return F.coalesce(chosen, F.when(kind == "image", "jpg").when(kind == "video", "mp4").when(kind == "audio", "ogg"), F.lit("bin"))


def media_path(root: str, jid: Column, time: Column, ident: Column, mime: Column, kind: Column) -> Column:
    """``root/jid/date_id.ext``."""
    return F.concat(F.lit(root.rstrip("/") + "/"), safe_jid(jid), F.lit("/"), F.date_format(time, "yyyy-MM-dd"), F.lit("_"), ident, F.lit("."), extension(mime, kind))


def human_size(column: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    steps = [(1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")]
    out = None
    for size, unit in steps:
        text = F.concat(F.format_number(column / size, 1), F.lit(f" {unit}"))
        out = F.when(column >= size, text) if out is None else out.when(column >= size, text)
    return out.otherwise(F.concat(column.cast("string"), F.lit(" B")))


def day_name(dow: Column) -> Column:
    """``Sun`` for 0 to ``Sat`` for 6."""
    return functools.reduce(lambda acc, i: acc.when(dow == i, DAYS[i]), range(1, 7), F.when(dow == 0, DAYS[0]))


def sent_parts(time: Column) -> dict[str, Column]:
    """Date, hour and day of week (0 = Sunday) of a time in UTC."""
    return {"sent_date": F.to_date(time), "sent_hour": F.hour(time).cast("smallint"), "sent_dow": (F.dayofweek(time) - 1).cast("smallint")}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of one length; null where a norm is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def assembled_text(before: Column, text: Column, behind: Column, limit: int = 8000) -> Column:
    """Context before, text and context behind, parted by lines of dashes and cut to ``limit`` characters."""
    return F.substring(F.concat_ws("\n---\n", filled(before), text, filled(behind)), 1, limit)


def strip_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def all_of(predicates: Iterable[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, predicates, F.lit(True))
