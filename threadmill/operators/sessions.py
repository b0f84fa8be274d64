"""Grouping events into sessions separated by gaps of inactivity.

The textbook plan (lag, flag, running sum over one window per key) puts a whole
key into one task.  Here each key is first cut at fixed time buckets.  The lag
window runs per (key, bucket) and yields *pieces*: maximal bursts inside the
bucket.  A piece that touches neither end of its bucket is a finished session.
Only the first and the last piece of each bucket can continue into a
neighbouring bucket, so the second window, which joins them with the same lag
and running sum, sees at most two rows a bucket, however hot the key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_US = 30 * 60 * 1_000_000
BUCKET_US = 4 * 3600 * 1_000_000


def distinct_events(df: DataFrame, key: str, ident: str, us: Column, columns: dict[str, Column], bucket_us: int = BUCKET_US) -> DataFrame:
    """One row per (ident, key, time), hash-partitioned by (key, bucket).

    Repeats of an event agree on their time, so after the sort that the lag
    window needs anyway they stand next to each other; no aggregate is needed.
    Of repeats that agree on the time any may stay.  Rows without a time cannot
    be placed and are left out; a null key is a key of its own.
    """
    placed = (
        df.select(F.col(key).alias("_key"), F.col(ident).alias("_id"), us.alias("_us"), *[c.alias(n) for n, c in columns.items()])
        .where(F.col("_us").isNotNull())
        .withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket_us)))
        .repartition("_key", "_bucket")
    )
    ordered = Window.partitionBy("_key", "_bucket").orderBy("_us", "_id")
    repeat = (F.lag("_us").over(ordered) == F.col("_us")) & F.lag("_id").over(ordered).eqNullSafe(F.col("_id")) & (F.row_number().over(ordered) > 1)
    return placed.withColumn("_repeat", F.coalesce(repeat, F.lit(False))).where(~F.col("_repeat")).drop("_repeat")


def with_pieces(events: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """Adds ``_piece``, the number of the burst inside (key, bucket), from 1."""
    ordered = Window.partitionBy("_key", "_bucket").orderBy("_us", "_id")
    starts = F.coalesce(F.col("_us") - F.lag("_us").over(ordered) > gap_us, F.lit(True))
    return events.withColumn("_starts", starts.cast("int")).withColumn("_piece", F.sum("_starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def sessionize(df: DataFrame, key: str, ident: str, us: Column, gap_us: int = GAP_US, bucket_us: int = BUCKET_US) -> DataFrame:
    """Sessions of every key: ``_key, start_us, end_us, n_events``.

    A session ends where the next event comes more than ``gap_us`` later; an
    equal gap keeps it open.  Repeated rows of one event count once, rows
    without a time are left out, an empty input gives an empty result.
    """
    pieces = (
        with_pieces(distinct_events(df, key, ident, us, {}, bucket_us), gap_us)
        .groupBy("_key", "_bucket", "_piece")
        .agg(F.min("_us").alias("start_us"), F.max("_us").alias("end_us"), F.count(F.lit(1)).alias("n_events"))
    )
    of_bucket = Window.partitionBy("_key", "_bucket")
    near_end = (F.col("start_us") - F.col("_bucket") * bucket_us <= gap_us) | ((F.col("_bucket") + 1) * bucket_us - F.col("end_us") <= gap_us)
    edge = near_end & ((F.col("_piece") == 1) | (F.col("_piece") == F.max("_piece").over(of_bucket)))
    marked = pieces.withColumn("_edge", edge)
    by_time = Window.partitionBy("_key").orderBy("start_us")
    opens = F.coalesce(F.col("start_us") - F.lag("end_us").over(by_time) > gap_us, F.lit(True)).cast("int")
    joined = (
        marked.where("_edge")
        .withColumn("_opens", opens)
        .withColumn("_session", F.sum("_opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_key", "_session")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_events").alias("n_events"))
        .drop("_session")
    )
    inner = marked.where(~F.col("_edge")).select("_key", "start_us", "end_us", "n_events")
    return inner.unionByName(joined)


def chat_sessions(messages: DataFrame, gap_us: int = GAP_US, bucket_us: int = BUCKET_US) -> DataFrame:
    """Sessions of every chat over distinct messages, with their duration."""
    from threadmill.sources.tables import micros

    found = sessionize(messages, "chat_jid", "id", micros(F.col("timestamp")), gap_us, bucket_us)
    return found.select(
        F.col("_key").alias("chat_jid"),
        "start_us",
        "end_us",
        F.col("n_events").alias("n_messages"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
    )
