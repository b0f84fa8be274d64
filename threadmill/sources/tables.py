"""Parquet tables of the message model."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan ``root/name.parquet``; columns and filters are pushed by Catalyst."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def reader(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    return lambda name: table(spark, root, name)


def blank(column) -> F.Column:
    """True where a text is null, empty or only spaces."""
    return F.coalesce(F.trim(column) == "", F.lit(True))


def micros(column) -> F.Column:
    """A timestamp (with or without zone) as bigint microseconds since the epoch in UTC."""
    return F.unix_micros(column.cast("timestamp"))


MESSAGES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("chat_jid", T.StringType(), False),
        T.StructField("sender_jid", T.StringType(), False),
        T.StructField("is_from_me", T.BooleanType(), False),
        T.StructField("is_group", T.BooleanType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("msg_type", T.StringType(), False),
        T.StructField("text_content", T.StringType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("push_name", T.StringType()),
        T.StructField("sent_date", T.DateType(), False),
        T.StructField("sent_hour", T.ShortType(), False),
        T.StructField("sent_dow", T.ShortType(), False),
        T.StructField("raw_proto", T.BinaryType()),
        T.StructField("media_downloaded", T.BooleanType()),
        T.StructField("media_path", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

CONTACTS = T.StructType(
    [
        T.StructField("jid", T.StringType(), False),
        T.StructField("push_name", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("business_name", T.StringType()),
        T.StructField("is_group", T.BooleanType()),
        T.StructField("group_name", T.StringType()),
    ]
)

CLASSIFICATIONS = T.StructType(
    [
        T.StructField("message_id", T.StringType(), False),
        T.StructField("chat_jid", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("confidence", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)

EXTRACTED_ENTITIES = T.StructType(
    [
        T.StructField("message_id", T.StringType(), False),
        T.StructField("chat_jid", T.StringType(), False),
        T.StructField("entity_type", T.StringType(), False),
        T.StructField("entity_value", T.StringType(), False),
    ]
)

SCHEMAS = {
    "messages": MESSAGES,
    "contacts": CONTACTS,
    "classifications": CLASSIFICATIONS,
    "extracted_entities": EXTRACTED_ENTITIES,
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A typed empty relation of one of the base tables."""
    return spark.createDataFrame([], SCHEMAS[name])
