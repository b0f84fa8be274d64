"""Keyed writes as relations: what a table holds after rows have arrived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Insert or ignore within one batch: the first row of a key stays.

    It is an aggregate, so repeats fold before the shuffle and a key that
    arrives without end costs no window.
    """
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def last_wins(rows: DataFrame, key: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Insert or replace: the last row of a key stays."""
    picked = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return picked.select(*key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def new_rows(target: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a batch whose key the target lacks, one a key."""
    return batch.dropDuplicates(key).join(target.select(*key), key, "left_anti")


def updated(target: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    """Keyed update of one column; keys without a change keep their value."""
    fresh = changes.select(*key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    joined = target.join(fresh, key, "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def renamed(values: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Values replaced by name: ``mapping`` has ``old, new``."""
    joined = values.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_new")


def cleared(table: DataFrame, column: str) -> DataFrame:
    """The table with one column set to null."""
    return table.withColumn(column, F.lit(None).cast(table.schema[column].dataType))
