"""Joins on nearness in time, without windows over whole chats.

All of them cut a chat into time buckets at least as wide as the reach, so a
row meets rows of its own and of the neighbouring bucket only, and a chat that
holds a third of all rows spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def within(left: DataFrame, right: DataFrame, key: list[str], low: int, high: int, left_us: str = "us", right_us: str = "r_us") -> DataFrame:
    """Pairs with equal keys and right time in [left + low, left + high] microseconds.

    ``right`` names its keys ``r_<key>``.  Left rows are copied into the
    buckets that the interval touches, at most two of width high - low.
    """
    width = max(1, high - low)
    reach = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col(left_us) + low) / width), F.floor((F.col(left_us) + high) / width))))
    there = right.withColumn("_c", F.floor(F.col(right_us) / width))
    equal = F.col("_b") == F.col("_c")
    for k in key:
        equal = equal & (F.col(k) == F.col(f"r_{k}"))
    return reach.join(there, equal & (F.col(right_us) >= F.col(left_us) + low) & (F.col(right_us) <= F.col(left_us) + high)).drop("_b", "_c")


def replies(messages: DataFrame, reach: int = DAY) -> DataFrame:
    """``chat_jid, received_us, replied_us``: the earliest own message strictly within ``reach``.

    ``messages`` has ``chat_jid, us, mine``.  Inside a bucket a running minimum
    in falling order finds the next own message; the first one of the next
    bucket stands in where the bucket has none.  Receipts at one instant are one.
    """
    placed = messages.select("chat_jid", "us", F.when(F.col("mine"), F.col("us")).alias("own"), F.floor(F.col("us") / reach).alias("bucket"))
    falling = Window.partitionBy("chat_jid", "bucket").orderBy(F.col("us").desc()).rangeBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("next_own", F.min("own").over(falling))
    firsts = placed.where("own is not null").groupBy("chat_jid", (F.col("bucket") - 1).alias("bucket")).agg(F.min("own").alias("later_own"))
    received = inside.where("own is null").groupBy("chat_jid", "bucket", "us").agg(F.min("next_own").alias("next_own"))
    answered = received.join(firsts, ["chat_jid", "bucket"], "left").withColumn("replied_us", F.coalesce("next_own", "later_own"))
    return answered.where(F.col("replied_us") < F.col("us") + reach).select("chat_jid", F.col("us").alias("received_us"), "replied_us")


def exchanges(messages: DataFrame, reach: int = 5 * MINUTE) -> DataFrame:
    """``person1, person2, group_jid, exchange_count, first_us, last_us``.

    A pair of messages of one group counts if the second comes at most
    ``reach`` after the first and the person whose jid is lower speaks first.
    ``messages`` has ``chat_jid, sender, us``.
    """
    first = messages.select("chat_jid", "sender", "us")
    second = messages.select(F.col("chat_jid").alias("r_chat_jid"), F.col("sender").alias("r_sender"), F.col("us").alias("r_us"))
    pairs = within(first, second, ["chat_jid"], 0, reach).where(F.col("sender") < F.col("r_sender"))
    return pairs.groupBy(F.col("sender").alias("person1"), F.col("r_sender").alias("person2"), F.col("chat_jid").alias("group_jid")).agg(
        F.count(F.lit(1)).alias("exchange_count"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


def context_texts(messages: DataFrame, n: int = 3, reach: int = 30 * MINUTE, bucket: int = HOUR) -> DataFrame:
    """``chat_jid, id, us, before, after``: up to n texts on either side within ``reach``.

    ``messages`` has ``chat_jid, id, us, text`` with non-blank texts.  Texts at
    the very instant count as later ones.  Each bucket also holds copies of the
    neighbours within reach, so no window spans a chat.
    """
    home = F.floor(F.col("us") / bucket)
    copies = messages.withColumn("_b", F.explode(F.sequence(F.floor((F.col("us") - reach) / bucket), F.floor((F.col("us") + reach) / bucket)))).withColumn("_home", F.col("_b") == home)
    by_time = Window.partitionBy("chat_jid", "_b").orderBy("us")
    item = F.struct("us", "id", "text")
    earlier = F.collect_list(item).over(by_time.rangeBetween(-reach, -1))
    later = F.collect_list(item).over(by_time.rangeBetween(0, reach))
    me = F.col("id")
    near = copies.withColumn("_earlier", earlier).withColumn("_later", later).where("_home")
    last = F.slice(F.reverse(F.array_sort("_earlier")), 1, n)
    behind = F.slice(F.filter(F.array_sort("_later"), lambda x: (x["id"] != me) | (x["us"] != F.col("us"))), 1, n)
    return near.select(
        "chat_jid",
        "id",
        "us",
        "text",
        F.array_join(F.transform(F.reverse(last), lambda x: x["text"]), "\n").alias("before"),
        F.array_join(F.transform(behind, lambda x: x["text"]), "\n").alias("after"),
    )
