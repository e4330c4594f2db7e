"""Add and Search requests: reading, checking, and turning rows into requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from turnstore.schemas import ADD_REQUEST, MESSAGE, SEARCH_REQUEST
from turnstore.sources.tables import CORRUPT

def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_add_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Add requests, one per row; unreadable JSON lines keep their text in ``_corrupt_record``."""
    if fmt == "json":
        return spark.read.schema(with_corrupt(ADD_REQUEST)).json(path)
    return spark.read.schema(ADD_REQUEST).format(fmt).load(path)


def read_search_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        return spark.read.schema(with_corrupt(SEARCH_REQUEST)).json(path)
    return spark.read.schema(SEARCH_REQUEST).format(fmt).load(path)


def _missing(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit(name))


def add_request_problem(df: DataFrame) -> Column:
    """Why a request cannot be accepted, null when it can."""
    bad_message = F.exists(
        "messages", lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull())
    checks = [F.when(F.col(CORRUPT).isNotNull(), "malformed")] if CORRUPT in df.columns else []
    checks += [_missing(c) for c in ("request_id", "user_id", "session_id", "messages")]
    checks += [F.when(F.size("messages") == 0, "messages"), F.when(bad_message, "messages")]
    return F.coalesce(*checks)


def search_request_problem(df: DataFrame) -> Column:
    checks = [F.when(F.col(CORRUPT).isNotNull(), "malformed")] if CORRUPT in df.columns else []
    return F.coalesce(*checks, *[_missing(c) for c in ("query", "user_id", "top_k")], F.lit(None).cast("string"))


def accepted(df: DataFrame) -> DataFrame:
    """Requests that pass :func:`add_request_problem`."""
    return df.where(add_request_problem(df).isNull()).drop(CORRUPT)


def quarantined(df: DataFrame) -> DataFrame:
    """Rejected requests with the field at fault."""
    return df.withColumn("problem", add_request_problem(df)).where("problem is not null")


def requests_from_messages(messages: DataFrame) -> DataFrame:
    """Group message rows into Add requests.

    Input: request_id, user_id, session_id, position, role, content, timestamp,
    arrival. A request is one chunk, so its array is as small as the sender's
    chunk; rows are ordered by position, and the position inside the array is
    the message's position.
    """
    entry = F.struct("position", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in MESSAGE])
    grouped = messages.groupBy("request_id", "user_id", "session_id").agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"), F.min("arrival").alias("arrival"))
    fields = [f.name for f in MESSAGE]
    ordered = F.transform("_entries", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return grouped.select("request_id", "user_id", "session_id", ordered.alias("messages"), "arrival")
