"""The memory store: a log of attempts, merged tier by tier.

Every batch writes a new attempt (a folder per table) and becomes visible as a whole by one
row in one file of the commit log. An attempt holds

``memories``   by user bucket, sorted by user
``ledger``     one row per stored request
``counters``   how many memories each user has in the attempt
``filters``    a Bloom filter of the requests, cut into blocks of 512 bytes

A batch looks its requests up in the filters of its own user buckets; the ledger is read only
for those that may be there, and only in the attempts and buckets a filter points at. The next
``seq`` of a user is the sum of the user's counters, one row per attempt. So that neither grows
with the number of batches, attempts of one tier are merged into one of the next as soon as
there are ``fan_in``. A merge writes its result first and then starts a new epoch of the commit
log, whose first file lists all live attempts: until that file is there nothing has changed.
Replaced folders stay for readers that began before.

One writer at a time (one stream, or one series of batches) appends, merges and replaces.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from turnstore.runtime import BLOCK_KEYS, SENT_BLOCKS, cut_lineage, filter_blocks, key_hashes, may_hold, small_side
from turnstore.schemas import LEDGER, MEMORY

# Buckets of users; all attempts of a store have the same.
USER_BUCKETS = 64
# Live attempts of one tier that are merged into one of the next.
FAN_IN = 16
# Attempts with at most so many memories are a few files, without a folder per bucket.
FLAT_ITEMS = 200_000

_BUCKET = T.StructField("user_bucket", T.IntegerType())
_BATCH = T.StructField("batch", T.LongType())
# What was written and read again may hold nulls, as far as Spark knows.
_MEMORY = [T.StructField(f.name, T.ArrayType(f.dataType.elementType) if isinstance(f.dataType, T.ArrayType) else f.dataType) for f in MEMORY]
TABLES = {
    "memories": T.StructType([*_MEMORY, _BATCH, _BUCKET]),
    "ledger": T.StructType([*LEDGER.fields, _BATCH, _BUCKET]),
    "counters": T.StructType([T.StructField("user_id", T.StringType()), T.StructField("n_items", T.LongType()), _BUCKET]),
    "filters": T.StructType([T.StructField("n_blocks", T.LongType()), T.StructField("block", T.LongType()),
                             T.StructField("words", T.ArrayType(T.LongType())), _BUCKET]),
}
COMMIT = T.StructType([
    _BATCH, T.StructField("attempt", T.StringType()), T.StructField("number", T.LongType()), T.StructField("tier", T.IntegerType()),
    T.StructField("flat", T.BooleanType()), T.StructField("replaces", T.BooleanType()), T.StructField("n_items", T.LongType()),
    T.StructField("users", T.BinaryType())])
_HINT = T.StructType([T.StructField("epoch", T.LongType())])


def user_bucket(user_id: Column, buckets: int = USER_BUCKETS) -> Column:
    return F.pmod(F.crc32(user_id.cast("binary")), F.lit(buckets)).cast("int")


def read_or_empty(spark: SparkSession, schema: T.StructType, *paths: str, base: str | None = None) -> DataFrame:
    """Parquet at *paths*, or no rows where there is none."""
    reader = spark.read.schema(schema)
    try:
        return (reader.option("basePath", base) if base else reader).parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_REQUEST = ["request_id", "user_id"]


def request_filters(ledger: DataFrame) -> DataFrame:
    """Filter blocks (user_bucket, n_blocks, block, words) of ledger rows with ``user_bucket``.

    The number of blocks is a power of four that fits the fullest bucket, so that few sizes
    occur in a store.
    """
    fullest = ledger.groupBy("user_bucket").count().agg(F.max("count")).first()[0] or 0
    n_blocks = 1
    while n_blocks * BLOCK_KEYS < fullest:
        n_blocks *= 4
    return filter_blocks(ledger, _REQUEST, n_blocks, ["user_bucket"]).withColumn("n_blocks", F.lit(n_blocks).cast("long"))


@dataclass(frozen=True)
class Store:
    """A store below *root*. *fan_in* of 0 leaves merging to :meth:`merge`."""

    root: str
    buckets: int = USER_BUCKETS
    fan_in: int = FAN_IN
    flat_items: int = FLAT_ITEMS

    # --- the commit log -------------------------------------------------------------

    def _log(self, epoch: int) -> str:
        return f"{self.root}/commits" if epoch == 0 else f"{self.root}/commits-{epoch}"

    def _epoch(self, spark: SparkSession) -> tuple[int, list[Row]]:
        """The newest epoch and its commits. The hint may be old or missing, so later epochs are looked for."""
        hints = read_or_empty(spark, _HINT, f"{self.root}/epoch").collect()
        epoch = max((r.epoch for r in hints), default=0)
        rows = read_or_empty(spark, COMMIT, self._log(epoch)).collect()
        while following := read_or_empty(spark, COMMIT, self._log(epoch + 1)).collect():
            epoch, rows = epoch + 1, following
        return epoch, rows

    def attempts(self, spark: SparkSession) -> list[Row]:
        """Live attempts in the order of their commits; with merging their number grows with the logarithm of the batches."""
        return sorted(self._epoch(spark)[1], key=lambda r: r.number)

    def _append_log(self, spark: SparkSession, epoch: int, rows: list[tuple]) -> None:
        # One file, which the committer renames into place.
        spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("append").parquet(self._log(epoch))

    # --- reading --------------------------------------------------------------------

    def read(self, spark: SparkSession, table: str, attempts: list[Row] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of *table* in *attempts* (default: all live ones), with their ``attempt``.

        *buckets* is a filter on folders, and on row groups where an attempt has none.
        """
        attempts = self.attempts(spark) if attempts is None else attempts
        if table != "memories":
            # What only replaces rows has no other table.
            attempts = [a for a in attempts if not a.replaces or a.tier]
        schema = T.StructType([*TABLES[table].fields, T.StructField("attempt", T.StringType())])
        parts = []
        for flat in (False, True):
            paths = [f"{self.root}/{table}/attempt={a.attempt}" for a in attempts if a.flat is flat]
            if paths:
                part = read_or_empty(spark, schema, *paths, base=f"{self.root}/{table}")
                parts.append(part if buckets is None else part.where(F.col("user_bucket").isin(buckets)))
        return _union(parts) if parts else spark.createDataFrame([], schema)

    def memories(self, spark: SparkSession, attempts: list[Row] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All live memories; a replaced id has the row of its last attempt."""
        attempts = self.attempts(spark) if attempts is None else attempts
        rows = self.read(spark, "memories", attempts, buckets)
        replacing = [a for a in attempts if a.replaces]
        if not replacing:
            return rows.drop("attempt")
        number = F.create_map(*[F.lit(x) for a in attempts for x in (a.attempt, a.number)])[F.col("attempt")]
        last = self.read(spark, "memories", replacing, buckets).groupBy("id").agg(F.max(number).alias("_last"))
        return (rows.withColumn("_number", number).join(small_side(last), "id", "left")
                .where("_last is null or _number >= _last").select(*TABLES["memories"].fieldNames()))

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self.read(spark, "ledger").drop("attempt")

    def stats(self, spark: SparkSession) -> DataFrame:
        """Users and memories, out of the sketches of the commit log: no table is read.

        Users are estimated; ids that were replaced and not merged yet count twice.
        """
        rows = spark.createDataFrame(self.attempts(spark), COMMIT)
        return rows.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("users", F.lit(True))), F.lit(0)).alias("users"),
                        F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"))

    # --- what a batch needs to know -----------------------------------------------------

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The user buckets of *rows*, at most as many as the store has."""
        found = rows.select(user_bucket(F.col("user_id"), self.buckets).alias("b")).distinct().collect()
        return sorted(r.b for r in found if r.b is not None)

    def stored_requests(self, keys: DataFrame, attempts: list[Row]) -> DataFrame:
        """Those of *keys* (request_id, user_id) that are in the ledger of *attempts*."""
        spark, names = keys.sparkSession, _REQUEST
        none = spark.createDataFrame([], T.StructType([f for f in LEDGER.fields if f.name in names]))
        buckets = self.buckets_of(keys)
        if not attempts or not buckets:
            return none
        filters = self.read(spark, "filters", attempts, buckets)
        sizes = [r.n_blocks for r in filters.select("n_blocks").distinct().collect()]
        place, bits = key_hashes(_REQUEST)
        asked = keys.select(*names, user_bucket(F.col("user_id"), self.buckets).alias("user_bucket"), place.alias("_place"), bits.alias("_bits"),
                            F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("n_blocks")).withColumn(
            "block", F.expr("pmod(_place, n_blocks)"))
        maybe = cut_lineage(asked.join(small_side(filters, SENT_BLOCKS), ["user_bucket", "n_blocks", "block"])
                            .where(may_hold(F.col("words"), F.col("_bits"))).select(*names, "user_bucket", "attempt").distinct())
        pointed = maybe.select("attempt", "user_bucket").distinct().collect()
        if not pointed:
            return none
        where = {p.attempt for p in pointed}
        ledger = self.read(spark, "ledger", [a for a in attempts if a.attempt in where], sorted({p.user_bucket for p in pointed}))
        return ledger.join(small_side(maybe.select(*names).distinct()), names, "left_semi").select(*names).distinct()

    def stored_counts(self, users: DataFrame, attempts: list[Row]) -> DataFrame:
        """(user_id, start): how many memories each of *users* has."""
        counters = self.read(users.sparkSession, "counters", attempts, self.buckets_of(users) if attempts else None)
        return (counters.join(small_side(users.select("user_id").distinct()), "user_id", "left_semi")
                .groupBy("user_id").agg(F.sum("n_items").alias("start")))

    # --- writing --------------------------------------------------------------------------

    def _write(self, table: str, attempt: str, rows: DataFrame, order: list[str], flat: bool) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]])
        path = f"{self.root}/{table}/attempt={attempt}"
        # Rebalancing groups small buckets into few files and splits the bucket of a hot user, by
        # measured size; inside a file rows are in user order, so that row groups can be skipped.
        grouped = rows.hint("rebalance") if flat else rows.hint("rebalance", F.col("user_bucket"))
        writer = grouped.sortWithinPartitions("user_bucket", *order).write
        (writer if flat else writer.partitionBy("user_bucket")).parquet(path)

    def _write_tables(self, attempt: str, memories: DataFrame, ledger: DataFrame, flat: bool) -> None:
        self._write("memories", attempt, memories, ["user_id", "seq"], flat)
        self._write("ledger", attempt, ledger, ["user_id", "request_id"], flat)

    def _write_index(self, attempt: str, ledger: DataFrame, counters: DataFrame, flat: bool) -> None:
        self._write("counters", attempt, counters.groupBy("user_id", "user_bucket").agg(F.sum("n_items").alias("n_items")), ["user_id"], flat)
        self._write("filters", attempt, request_filters(ledger), ["block"], flat)

    def append(self, batch: int, memories: DataFrame, ledger: DataFrame, n_items: int | None = None) -> None:
        """Write one batch as a new attempt, commit it, and merge what is due."""
        spark = memories.sparkSession
        bucket = user_bucket(F.col("user_id"), self.buckets)
        number = F.lit(batch).cast("bigint")
        ledger = ledger.withColumn("user_bucket", bucket).withColumn("batch", number)
        n_items = ledger.agg(F.sum("n_items")).first()[0] or 0 if n_items is None else n_items
        flat, attempt = n_items <= self.flat_items, uuid.uuid4().hex
        self._write_tables(attempt, memories.withColumn("batch", number).withColumn("user_bucket", bucket), ledger, flat)
        self._write_index(attempt, ledger, ledger, flat)
        self._commit(spark, batch, attempt, flat, False, n_items, ledger)
        self.maintain(spark)

    def _commit(self, spark: SparkSession, batch: int | None, attempt: str, flat: bool, replaces: bool, n_items: int, users: DataFrame) -> None:
        sketch = users.agg(F.hll_sketch_agg("user_id").alias("s")).first().s
        epoch, rows = self._epoch(spark)
        number = max((r.number for r in rows), default=-1) + 1
        self._append_log(spark, epoch, [(batch, attempt, number, 0, flat, replaces, n_items, sketch)])

    def replace(self, memories: DataFrame, version: str, batch: int | None = None) -> None:
        """Upsert by id: write *memories* (the last by *version* for an id) over stored ones.

        New ids are added. ``seq`` comes with the rows; the ledger and the counters are left alone.
        """
        spark = memories.sparkSession
        newest = W.partitionBy("id").orderBy(F.desc(version))
        rows = memories.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
        rows = cut_lineage(rows.withColumn("batch", F.lit(batch).cast("bigint")).withColumn(
            "user_bucket", user_bucket(F.col("user_id"), self.buckets)).select(*TABLES["memories"].fieldNames()))
        n_items, attempt = rows.count(), uuid.uuid4().hex
        flat = n_items <= self.flat_items
        self._write("memories", attempt, rows, ["user_id", "seq"], flat)
        self._commit(spark, batch, attempt, flat, True, n_items, rows)
        self.maintain(spark)

    # --- merging --------------------------------------------------------------------------

    def maintain(self, spark: SparkSession) -> None:
        """Merge tiers that are full, the lowest first."""
        while self.fan_in:
            live = self.attempts(spark)
            full = [t for t in sorted({a.tier for a in live}) if sum(a.tier == t for a in live) >= self.fan_in]
            if not full:
                return
            # What is merged is the newest end of the log, so that replaced ids stay in order.
            first = min(i for i, a in enumerate(live) if a.tier <= full[0])
            self._swap(spark, live, self._rewrite(spark, live, live[first:], full[0] + 1))

    def merge(self, spark: SparkSession) -> None:
        """Merge all live attempts into one."""
        live = self.attempts(spark)
        if len(live) > 1 or any(a.replaces for a in live):
            self._swap(spark, live, self._rewrite(spark, live, live, max(a.tier for a in live) + 1))

    def _rewrite(self, spark: SparkSession, live: list[Row], merged: list[Row], tier: int) -> tuple[list[Row], tuple]:
        """Write *merged* as one attempt; returns them and the commit of the result, which nobody sees yet."""
        attempt = uuid.uuid4().hex
        whole = len(merged) == len(live)
        memories, ledger = self.memories(spark, merged), self.read(spark, "ledger", merged)
        self._write_tables(attempt, memories, ledger, False)
        self._write_index(attempt, ledger, self.read(spark, "counters", merged), False)
        written = spark.read.schema(TABLES["memories"]).parquet(f"{self.root}/memories/attempt={attempt}")
        size = written.agg(F.count("*").alias("n"), F.hll_sketch_agg("user_id").alias("s")).first()
        # Ids replaced here may also be in older attempts.
        replaces = not whole and any(a.replaces for a in merged)
        number = max(a.number for a in merged)
        return merged, (None, attempt, number, tier, False, replaces, size.n, size.s)

    def _swap(self, spark: SparkSession, live: list[Row], result: tuple[list[Row], tuple]) -> None:
        """Begin an epoch that lists what is live now; its one file is the moment of the change."""
        merged, commit = result
        gone = {a.attempt for a in merged}
        epoch = self._epoch(spark)[0] + 1
        self._append_log(spark, epoch, [*[tuple(a) for a in live if a.attempt not in gone], commit])
        spark.createDataFrame([(epoch,)], _HINT).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/epoch")
