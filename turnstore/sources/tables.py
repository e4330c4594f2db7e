"""The tables of a store and of an evaluation, as Parquet.

Memories and the ledger live in a :class:`~turnstore.sources.store.Store`; rejected requests and
evaluation tables are plain tables beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from turnstore.runtime import small_side
from turnstore.schemas import ADD_REQUEST
from turnstore.sources.store import USER_BUCKETS, Store, read_or_empty, user_bucket

CORRUPT = "_corrupt_record"
QUARANTINE = T.StructType([*ADD_REQUEST.fields, T.StructField(CORRUPT, T.StringType()), T.StructField("problem", T.StringType()),
                           T.StructField("batch", T.LongType()), T.StructField("reject_id", T.StringType())])


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Requests that were written completely."""
    return Store(root).ledger(spark)


def read_memories(spark: SparkSession, root: str) -> DataFrame:
    """All committed memories."""
    return Store(root).memories(spark)


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Rejected requests with the field at fault, as they came; malformed ones keep their text."""
    return read_or_empty(spark, QUARANTINE, f"{root}/quarantine")


def write_quarantine(root: str, batch: int, rejected: DataFrame) -> None:
    """Add rejected requests (with ``problem``); rows without a corrupt column have no raw text.

    A reject is known by its whole content, so a batch that is repeated adds nothing.
    """
    kept = rejected if CORRUPT in rejected.columns else rejected.withColumn(CORRUPT, F.lit(None).cast("string"))
    content = F.struct(*[f.name for f in ADD_REQUEST], CORRUPT, "problem")
    kept = kept.withColumn("batch", F.lit(batch).cast("bigint")).withColumn("reject_id", F.sha2(F.to_json(content), 256))
    known = read_quarantine(rejected.sparkSession, root).select("reject_id")
    (kept.select([F.col(f.name).cast(f.dataType) for f in QUARANTINE]).dropDuplicates(["reject_id"])
     .join(known, "reject_id", "left_anti").select(QUARANTINE.fieldNames()).write.mode("append").parquet(f"{root}/quarantine"))


def user_memories(memories: DataFrame, users: str | DataFrame, buckets: int = USER_BUCKETS) -> DataFrame:
    """Memories of one user, or of all in *users* (user_id), in the order they were written.

    On a stored table only the buckets of these users are read.
    """
    if isinstance(users, str):
        wanted = F.col("user_id") == users
        if "user_bucket" in memories.columns:
            wanted = (F.col("user_bucket") == user_bucket(F.lit(users), buckets)) & wanted
        return memories.where(wanted).orderBy("seq")
    asked = small_side(users.select("user_id").distinct())
    return of_askers(memories, users, buckets).join(asked, "user_id", "left_semi").orderBy("user_id", "seq")


def of_askers(memories: DataFrame, queries: DataFrame, buckets: int = USER_BUCKETS) -> DataFrame:
    """Memories in the buckets of the asking users.

    The bucket list has at most *buckets* entries and becomes a filter on the folders of a
    stored table; other tables are returned as they are.
    """
    if "user_bucket" not in memories.columns:
        return memories
    return memories.where(F.col("user_bucket").isin(Store("", buckets).buckets_of(queries)))


def write_batch(root: str, batch: int, memories: DataFrame, ledger: DataFrame, buckets: int = USER_BUCKETS) -> None:
    """Write and commit one batch of a store."""
    Store(root, buckets).append(batch, memories, ledger)


def _overwrite(df: DataFrame, path: str, partitions: list[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def write_results(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Evaluation tables (retrieval, answers, judged, sweep), by tag and prefix."""
    _overwrite(df, path, partitions)


def latest_by_id(items: DataFrame, version: str) -> DataFrame:
    """Last write per id."""
    newest = W.partitionBy("id").orderBy(F.desc(version))
    return items.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """Rows of *existing* replaced by id with the last row of *incoming*.

    Only the ids of the new rows meet the stored table, as an anti join that leaves
    the table where it is for a batch of ordinary size.
    """
    fresh = latest_by_id(incoming, version)
    return existing.join(small_side(fresh.select("id")), "id", "left_anti").unionByName(fresh.select(existing.columns))


def responses(results: DataFrame) -> DataFrame:
    """Result rows as JSON objects; ``created_at`` is absent when unknown."""
    body = F.struct("id", "content", "score", "created_at")
    return results.select("query_id", "pos", F.to_json(body, {"ignoreNullFields": "true"}).alias("item"))
