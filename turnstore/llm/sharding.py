"""Proportional stratified interleaving of rows into shards.

Rows are shuffled by a seeded hash within their source and numbered there. Row r of a
source with n rows stands at (2r + 1) / 2n; all rows in this order, cut into equal
runs, give shards that each hold the mixture of sources. Both numberings are done in
buckets of bounded size plus counts of the buckets before, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Rows that one bucket of a numbering holds on average.
BUCKET_ROWS = 20_000


def _numbered(rows: DataFrame, group: list[str], bucket: Column, order: list, out: str, total: str | None = None) -> DataFrame:
    """Add ``out``, the place of a row in its group (from 0), where *bucket* follows *order*."""
    rows = rows.withColumn("_bucket", bucket)
    sums = rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_n").over(W.partitionBy(*group)))
    place = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    joined = rows.withColumn("_place", place).join(sums.drop("_n"), [*group, "_bucket"])
    return joined.withColumn(out, F.col("_before") + F.col("_place")).drop("_bucket", "_before", "_place")


def order_key(key: Column, seed: int) -> Column:
    """32 hexadecimal digits that shuffle rows by their key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))


def interleave(rows: DataFrame, n_shards: int, key: str = "doc_id", source: str = "source", seed: int = 0,
               ties: list[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """*rows* with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Row counts of two shards differ by one at most, and by source they follow the
    mixture. Rows without a source are a source of their own; rows with equal or no
    keys are ordered by *ties*, so that only rows equal in both could change places.
    No rows: no shards. Columns whose names start with an underscore are not allowed.
    """
    n = rows.count()
    buckets = max(1, n // bucket_rows)
    made = rows.withColumn("_key", order_key(F.col(key), seed)).withColumn(
        "_source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    digits = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    hashed = F.floor(digits * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    order = ["_key", *(ties or [])]
    made = _numbered(made, ["_source"], hashed, order, "_rank", "_count")
    made = made.withColumn("_share", (2 * F.col("_rank") + 1) / (2 * F.col("_count")))
    # One group for all rows: a literal keeps the grouping general, the rows stay in their buckets.
    made = _numbered(made.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_share") * buckets).cast("long"),
                     ["_share", "_source"], "_position")
    size, larger = divmod(n, n_shards)
    edge = larger * (size + 1)
    beyond = F.col("_position") - edge
    first = F.col("_position") < edge
    shard = F.when(first, F.floor(F.col("_position") / (size + 1))).otherwise(
        larger + F.floor(beyond / max(size, 1)))
    slot = F.when(first, F.col("_position") % (size + 1)).otherwise(beyond % max(size, 1))
    return made.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop(
        "_key", "_source", "_rank", "_count", "_share", "_all", "_position")


def write_shards(rows: DataFrame, path: str, n_shards: int, **options) -> None:
    """Write *rows* below *path*, one ``shard=`` folder each, in the order of their slots."""
    placed = interleave(rows, n_shards, **options)
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
