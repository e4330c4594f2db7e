"""Store size and the state of the model channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstore import settings as S
from turnstore.sources.store import Store


def store_stats(memories: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of users and of memories, in one row."""
    users = F.approx_count_distinct("user_id") if approximate else F.countDistinct("user_id")
    return memories.agg(users.alias("users"), F.count("*").alias("items"))


def channel_health(calls: DataFrame) -> DataFrame:
    """Counters over ``status`` and whether the channel counts as degraded."""
    made = F.col("status") != "off"
    counted = calls.agg(
        F.count_if(made).alias("calls"), F.count_if(F.col("status") == "failed").alias("failures"),
        F.count_if(F.col("status") == "empty").alias("empty_extractions"))
    bad = (F.col("calls") >= S.DEGRADED_MIN_CALLS) & (
        F.col("failures") > S.DEGRADED_FAILURE_SHARE * F.col("calls"))
    return counted.withColumn("status", F.when(bad, "degraded").otherwise("ok"))


def stored_stats(spark: SparkSession, store: Store) -> DataFrame:
    """:func:`store_stats` of a written store, users estimated, out of the sketches that every commit carries.

    No table is read, however large the store is.
    """
    return store.stats(spark).select(F.round("users").cast("long").alias("users"), F.col("items").cast("long").alias("items"))
