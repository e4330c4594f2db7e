"""Session set-up, shared scratch space, lineage cuts and skew-safe prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def build_session(app: str = "turnstore", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; the cluster's own win elsewhere."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings that the results, the skew handling or the memory of Python workers depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A worker holds two or three Arrow batches at once, so they are kept below what it gathers itself.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    # A retried stage must rewrite only its own partitions.
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by the cluster.

    Only a local session without one (tests, a laptop) gets a folder of its own;
    elsewhere executors would each write to their own disk, so that is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnstore-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write *df* to the shared folder and read it back.

    The files outlive lost executors, unlike cached or local blocks, and their
    size is known when the next plan is made.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Most rows of a side that is sent to every task. Such sides hold keys, ids and
# numbers, a few hundred bytes each.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """*df*, marked for broadcast if it was counted to be small.

    The other side of the join then stays where it is. A larger *df* is left to
    the shuffle join, which splits skewed keys.
    """
    return F.broadcast(df) if df.count() <= rows else df


# Bits and keys of one block of a Bloom filter, bits tested per key, and most blocks that are sent
# to every task (half a KB each).
BLOCK_BITS, BLOCK_KEYS, PROBES = 4096, 341, 5
SENT_BLOCKS = 20_000


def key_hashes(on: list[str]) -> tuple[Column, Column]:
    """Two hashes of a key: one for its block, one for its bits."""
    return F.xxhash64(*on), F.xxhash64(F.lit("bits"), *reversed(on))


def _positions(bits: Column) -> list[Column]:
    """Bits of a key inside its block, twelve bits of the hash for each."""
    return [F.shiftrightunsigned(bits, 12 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(PROBES)]


def filter_blocks(keys: DataFrame, on: list[str], n_blocks: int, by: list[str] | None = None) -> DataFrame:
    """Blocks (by, block, words) of a Bloom filter of *keys*; blocks without a key have no row."""
    by = by or []
    place, bits = key_hashes(on)
    at = keys.select(*by, F.pmod(place, F.lit(n_blocks)).alias("block"), F.explode(F.array(*_positions(bits))).alias("at"))
    words = at.groupBy(*by, "block", F.expr("at div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    blocks = words.groupBy(*by, "block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("of"))
    every = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0)))
    return blocks.select(*by, "block", every.alias("words"))


def may_hold(words: Column, bits: Column) -> Column:
    """Whether a block may hold the key with these *bits*: never false for one it was made of."""
    held = F.lit(True)
    for at in _positions(bits):
        held = held & (F.getbit(F.element_at(words, F.expr("cast(1 as int)") + F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64))) == 1)
    return held


def join_few(large: DataFrame, few: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS,
             blocks: int = SENT_BLOCKS) -> DataFrame:
    """*large* joined with *few* of its keys, without shuffling the rest of *large*.

    Up to *rows* keys are sent to every task. For more, a Bloom filter of them is (up to *blocks*
    blocks), and only rows that pass it are shuffled. Beyond that the whole is a shuffle join.
    *how* must not keep rows of *large* without a partner.
    """
    n = few.count()
    if n <= rows:
        return large.join(F.broadcast(few), on, how)
    n_blocks = -(-n // BLOCK_KEYS)
    if n_blocks <= blocks:
        place, bits = key_hashes(on)
        sent = filter_blocks(few.select(*on).distinct(), on, n_blocks)
        large = (large.withColumn("_block", F.pmod(place, F.lit(n_blocks))).join(F.broadcast(sent.toDF("_block", "_words")), "_block")
                 .where(may_hold(F.col("_words"), bits)).drop("_block", "_words"))
    return large.join(few, on, how)


def order_splitters(df: DataFrame, order: list[str], pieces: int) -> list[tuple]:
    """At most ``pieces - 1`` values that cut *df* into similar ranges of *order*.

    They come from a bounded sample and only steer the balance of the work: any
    splitters give the same result.
    """
    if pieces < 2:
        return []
    total = df.count()
    wanted = pieces * 50
    if total <= wanted:
        return []
    sample = df.select(*order).sample(fraction=min(1.0, 2.0 * wanted / total), seed=7)
    rows = sorted(tuple(r) for r in sample.limit(4 * wanted).collect() if None not in tuple(r))
    step = max(1, len(rows) // pieces)
    return sorted(set(rows[step::step]))[: pieces - 1]


def _block(df: DataFrame, order: list[str], splitters: list[tuple]) -> Column:
    """How many splitters are not above this row."""
    if not splitters:
        return F.lit(0)

    def entry(values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, values)])

    here = F.struct(*[F.col(c) for c in order])
    return F.size(F.filter(F.array(*[entry(v) for v in splitters]), lambda bound: bound <= here))


def running_total(df: DataFrame, key: list[str], order: list[str], value: str, out: str,
                  start: DataFrame | None = None, pieces: int = 64) -> DataFrame:
    """Add ``out``: the sum of *value* over earlier rows of the same *key*.

    *start* (key, ``start``) holds what a key begins with. A plain window would
    sort a whole key in one task. Here the order is cut into blocks: a window
    inside each (key, block), plus the block sums before it, of which a key has at
    most *pieces*; starts meet these sums, not the rows.
    """
    blocked = df.withColumn("_block", _block(df, order, order_splitters(df, order, pieces)))
    sums = blocked.groupBy(*key, "_block").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(*key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    bases = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    if start is not None:
        sums = sums.join(start, key, "left")
        bases = bases + F.coalesce("start", F.lit(0))
    offsets = sums.select(*key, "_block", bases.alias("_base"))
    inside = W.partitionBy(*key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = blocked.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (local.join(offsets, [*key, "_block"])
            .withColumn(out, (F.col("_base") + F.col("_local")).cast("bigint"))
            .drop("_block", "_base", "_local"))
