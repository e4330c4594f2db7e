"""A stored inverted index for BM25: only the postings of asked terms are read, and of these only blocks that can matter.

A user's texts are cut into blocks by ``seq``, the same for all terms. A posting row holds the
texts of one block that have a term, the term's highest frequency among them and their least
length. From these follows an upper bound of what the term adds to a score in the block,
whatever the statistics of the store are by then, so parts of an index that were written apart
are read together: counts add up.

The best k are exact. The bound of a block is the sum over the terms of the question. The blocks
with the highest bounds are scored first and give k scores that the k-th best cannot be below;
blocks whose bound is below that are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql import types as T

from turnstore import settings as S
from turnstore.operators.lexical import tokens
from turnstore.runtime import cut_lineage, small_side
from turnstore.sources.store import USER_BUCKETS, Store, read_or_empty, user_bucket

# Values of ``seq`` in one block.
BLOCK_TEXTS = 128
# Text that one task indexes.
TASK_BYTES = 16 * 1024 * 1024
# Scores are summed in any order: bounds within so much of each other are equal.
SLACK = 1e-7

_BUCKET = T.StructField("user_bucket", T.IntegerType())
_ENTRY = T.StructType([T.StructField("id", T.StringType()), T.StructField("seq", T.LongType()),
                       T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())])
POSTINGS = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("term", T.StringType()), T.StructField("block", T.LongType()),
    T.StructField("size", T.IntegerType()), T.StructField("max_tf", T.IntegerType()), T.StructField("min_len", T.IntegerType()),
    T.StructField("entries", T.ArrayType(_ENTRY)), _BUCKET])
LENGTHS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("n", T.LongType()),
                        T.StructField("total", T.LongType()), _BUCKET])


def _part(tf: Column, length: Column, mean: Column) -> Column:
    """What a term of weight one adds to the score of a text."""
    tf = tf.cast("double")
    return tf * (S.BM25_K1 + 1) / (tf + S.BM25_K1 * (1 - S.BM25_B + S.BM25_B * length / F.when(mean > 0, mean).otherwise(1.0)))


@dataclass(frozen=True)
class LexicalIndex:
    """An index below *root*; several parts may have been added."""

    root: str
    buckets: int = USER_BUCKETS
    block_texts: int = BLOCK_TEXTS

    def add(self, memories: DataFrame, text: str = "content") -> None:
        """Index *memories* (user_id, id, seq and a text); ids must be new. A part that was not finished has no lengths and is not read.

        The texts of a block are brought together once, as texts; what is counted of them stays there.
        """
        part = uuid.uuid4().hex
        bucket = user_bucket(F.col("user_id"), self.buckets)
        block = ["user_bucket", "user_id", "block"]
        held = cut_lineage(memories.select(bucket.alias("user_bucket"), "user_id", F.expr(f"seq div {self.block_texts}").alias("block"),
                                           "id", "seq", F.col(text).alias("_text")))
        size = held.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        # Blocks of a user lie side by side, so a task's postings go to few folders.
        near = held.repartitionByRange(max(1, -(-size // TASK_BYTES)), *block)
        rows = near.withColumn("_tokens", tokens(F.col("_text"))).select(*block, "id", "seq", F.size("_tokens").alias("len"), "_tokens")
        counted = rows.select(*block, "id", "seq", "len", F.explode("_tokens").alias("term")).groupBy(
            *block, "id", "seq", "len", "term").agg(F.count("*").cast("int").alias("tf"))
        blocks = counted.groupBy(*block, "term").agg(
            F.count("*").cast("int").alias("size"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
            F.collect_list(F.struct("id", "seq", "tf", "len")).alias("entries"))
        self._write("postings", part, blocks, POSTINGS, ["user_id", "term", "block"], spread=False)
        lengths = (held.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("_text")))).alias("total"))
                   .withColumn("user_bucket", bucket))
        self._write("lengths", part, lengths, LENGTHS, ["user_id"])

    def _write(self, table: str, part: str, rows: DataFrame, schema: T.StructType, order: list[str], spread: bool = True) -> None:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        rows = rows.hint("rebalance", F.col("user_bucket")) if spread else rows
        rows.sortWithinPartitions("user_bucket", *order).write.partitionBy("user_bucket").parquet(f"{self.root}/{table}/part_id={part}")

    def _read(self, spark: SparkSession, table: str, schema: T.StructType, buckets: list[int]) -> DataFrame:
        named = T.StructType([*schema.fields, T.StructField("part_id", T.StringType())])
        return read_or_empty(spark, named, f"{self.root}/{table}").where(F.col("user_bucket").isin(buckets))

    def hits(self, questions: DataFrame, k: int = S.RRF_CANDIDATES, query: str = "query") -> DataFrame:
        """The best *k* memories of each question that share a term with it: query_id, id, seq, score, p."""
        spark = questions.sparkSession
        buckets = Store("", self.buckets).buckets_of(questions)
        lengths = cut_lineage(self._read(spark, "lengths", LENGTHS, buckets))
        parts = [r.part_id for r in lengths.select("part_id").distinct().collect()]
        asked = questions.select("query_id", "user_id", F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))
        users = lengths.groupBy("user_id").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
        asked = cut_lineage(asked.join(users, "user_id"))
        wanted = asked.select("user_id", "term").distinct()
        postings = self._read(spark, "postings", POSTINGS, buckets).where(F.col("part_id").isin(parts))
        postings = cut_lineage(postings.join(small_side(wanted), ["user_id", "term"], "left_semi").drop("user_bucket"))
        df = postings.groupBy("user_id", "term").agg(F.sum("size").alias("df"))
        idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(S.BM25_MIN_IDF))
        weighted = cut_lineage(asked.join(df, ["user_id", "term"]).select("query_id", "user_id", "term", "mean", idf.alias("idf")))
        # Bounds, without the entries.
        bound = F.col("idf") * _part(F.col("max_tf"), F.col("min_len"), F.col("mean"))
        block = ["user_id", "part_id", "block"]
        bounded = cut_lineage(postings.drop("entries").join(weighted, ["user_id", "term"]).groupBy("query_id", *block).agg(
            F.sum(bound).alias("bound"), F.max("size").alias("texts")))
        # The blocks of the highest bounds, k texts and so k scores at least.
        earlier = W.partitionBy("query_id").orderBy(F.desc("bound"), "part_id", "block").rowsBetween(W.unboundedPreceding, -1)
        first = bounded.withColumn("_before", F.coalesce(F.sum("texts").over(earlier), F.lit(0))).where(F.col("_before") < k)
        by_score = W.partitionBy("query_id").orderBy(F.desc("score"))
        least = (self._scores(postings, weighted, first).withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") == k)
                 .select("query_id", F.col("score").alias("least")))
        kept = (bounded.join(small_side(cut_lineage(least)), "query_id", "left")
                .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)))
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
        scored = self._scores(postings, weighted, kept).withColumn("score", F.round("score", S.SCORE_DECIMALS)).where("score > 0")
        return scored.withColumn("p", F.row_number().over(best)).where(F.col("p") <= k).select("query_id", "id", "seq", "score", "p")

    @staticmethod
    def _scores(postings: DataFrame, weighted: DataFrame, blocks: DataFrame) -> DataFrame:
        """(query_id, id, seq, score) of the texts in *blocks* (query_id, user_id, part_id, block)."""
        terms = blocks.select("query_id", "user_id", "part_id", "block").join(weighted, ["query_id", "user_id"])
        rows = terms.join(postings.select("user_id", "term", "part_id", "block", "entries"), ["user_id", "term", "part_id", "block"]).select(
            "query_id", "idf", "mean", F.inline("entries"))
        part = F.col("idf") * _part(F.col("tf"), F.col("len"), F.col("mean"))
        return rows.groupBy("query_id", "id", "seq").agg(F.sum(part).alias("score"))
