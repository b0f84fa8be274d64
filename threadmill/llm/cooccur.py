"""Items that appear together, and how much more often than chance.

Basket collapsing: every record becomes the sorted array of its distinct
items, equal arrays are counted once with a weight, and pairs are enumerated
once for each distinct array.  Two exact prunings come before the arrays are
built: an item in fewer than ``min_together`` records is in no pair asked for,
and neither is one in more than ``n / min_lift`` of the n records, since a pair
is never in more records than its rarer item.  The second takes out the items
that a large share of all records holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.session import cut_lineage


def collapsed_baskets(records: DataFrame, basket: str, item: str) -> DataFrame:
    """``items, weight``: each distinct sorted array of items and how many records have it."""
    arrays = records.groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return arrays.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))


#: A basket of more items is enumerated by joins of its parts, so that no task has all its pairs.
LARGE_BASKET = 256


def item_pairs(baskets: DataFrame, large: int = LARGE_BASKET) -> DataFrame:
    """``value_a, value_b, n_ab`` for all pairs, each enumerated once a distinct basket.

    The items of a large basket are dealt out over one part in ``large`` of
    them, and each part meets all items, in tasks of its own.
    """
    baskets = cut_lineage(baskets.where(F.size("items") > 1))
    first = baskets.where(F.size("items") <= large).select("weight", "items", F.posexplode("items").alias("at", "value_a"))
    pairs = first.select("weight", "value_a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("value_b"))
    # numbered between two checkpoints, so that a task that runs again gives the same numbers
    wide = cut_lineage(baskets.where(F.size("items") > large).withColumn("basket", F.monotonically_increasing_id()))
    wide = wide.select("basket", "weight", F.ceil(F.size("items") / large).cast("int").alias("parts"), F.posexplode("items").alias("at", "value"))
    one = wide.select("basket", "weight", F.pmod("at", "parts").alias("part"), "at", F.col("value").alias("value_a"))
    two = wide.select("basket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("at").alias("at_b"), F.col("value").alias("value_b"))
    pairs = pairs.unionByName(one.join(two, ["basket", "part"]).where("at < at_b").select("weight", "value_a", "value_b"))
    return pairs.groupBy("value_a", "value_b").agg(F.sum("weight").alias("n_ab"))


def associations(records: DataFrame, basket: str, item: str, min_together: int = 3, min_lift: float = 5.0) -> DataFrame:
    """Pairs of items with n_ab >= min_together and lift >= min_lift.

    Returns ``value_a, value_b, n_ab, n_a, n_b, n, lift, conviction``; conviction
    of a => b is null where every record with a has b.  Rows with a null basket
    or item are no occurrence; repeated rows count once.
    """
    distinct = records.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("_basket"), F.col(item).alias("_item")).distinct()
    total = distinct.agg(F.count_distinct("_basket").alias("n"))
    counts = distinct.groupBy("_item").agg(F.count(F.lit(1)).alias("n_item"))
    able = counts.crossJoin(F.broadcast(total)).where((F.col("n_item") >= min_together) & (F.col("n_item") * F.lit(min_lift) <= F.col("n")))
    pairs = item_pairs(collapsed_baskets(distinct.join(able, "_item", "left_semi"), "_basket", "_item")).where(F.col("n_ab") >= min_together)
    a = able.select(F.col("_item").alias("value_a"), F.col("n_item").alias("n_a"), "n")
    b = able.select(F.col("_item").alias("value_b"), F.col("n_item").alias("n_b"))
    scored = pairs.join(a, "value_a").join(b, "value_b").where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return scored.select(
        "value_a",
        "value_b",
        "n_ab",
        "n_a",
        "n_b",
        "n",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / F.col("n")) / (1 - F.col("n_ab") / F.col("n_a"))).alias("conviction"),
    )
