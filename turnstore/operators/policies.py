"""Other ways to fill or reshape the returned set, for comparison runs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window as W, functions as F

from turnstore import settings as S
from turnstore.functions import text as X
from turnstore.operators.scoring import DENSE, candidates
from turnstore.runtime import small_side


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The best *k* hits of each question, renumbered."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return hits.withColumn("p", F.row_number().over(best)).where(F.col("p") <= k)


def diversity_cap(hits: DataFrame, k: int, per_chunk: int = S.CHUNK_CAP) -> DataFrame:
    """Top *k* of the given hits with at most *per_chunk* memories of one source chunk."""
    chunk = W.partitionBy("query_id", "digest").orderBy(F.desc("score"), "seq")
    spread = hits.withColumn("digest", X.id_digest(F.col("id")))
    return top_k(spread.withColumn("_n", F.row_number().over(chunk)).where(F.col("_n") <= per_chunk).drop("_n"), k)


def diverse_hits(memories: DataFrame, queries: DataFrame, k: int, per_chunk: int = S.CHUNK_CAP, **plan) -> DataFrame:
    """:func:`diversity_cap` over whole stores.

    The cap already holds inside every scored block. That loses nothing: a memory
    that a block drops has *per_chunk* better ones of its chunk, or *k* better
    capped ones, and both stay true for the whole store.
    """
    capped = replace(DENSE, group="digest", per_group=per_chunk)
    marked = memories.withColumn("digest", X.id_digest(F.col("id")))
    return diversity_cap(candidates(marked, queries, k, capped, **plan), k, per_chunk)


def single_kind(memories: DataFrame, kind: str) -> DataFrame:
    """Only verbatim (``raw``) or only extracted (``fact``) memories."""
    return memories.where(F.col("kind") == kind)


def parent_chunks(ranked: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Distinct source chunks of a ranking, in the order they first appear.

    *ranked* has query_id, p and id; *transcripts* has digest and transcript, one row per
    digest. Chunks are numbered by their digests alone: a text meets the questions that found
    it once all of that is done, and is not shuffled again for any of them.
    """
    texts = transcripts.select("digest", F.col("transcript").alias("content"))
    first = (ranked.withColumn("digest", X.id_digest(F.col("id")))
             .groupBy("query_id", "digest").agg(F.min("p").alias("first_p"))
             .join(small_side(texts.select("digest")), "digest", "left_semi"))
    by_rank = W.partitionBy("query_id").orderBy("first_p")
    return first.withColumn("pos", F.row_number().over(by_rank) - 1).join(texts, "digest")


def within_budget(items: DataFrame, budget: int) -> DataFrame:
    """Walk each question's items by ``pos`` and keep those that still fit.

    An item that is too large is passed over and later ones may fit; the first one
    is always kept and nothing follows once the budget is used up. Input is a
    ranking, so a question has no more rows than the ranking's limit.
    """
    offer = F.struct("pos", F.length("content").cast("bigint").alias("n_chars"))
    walked = items.groupBy("query_id").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    start = F.struct(F.lit(budget).cast("bigint").alias("budget"), F.array().cast("array<int>").alias("kept"))

    def step(state, item):
        first = F.size(state["kept"]) == 0
        fits = first | ((state["budget"] > 0) & (item["n_chars"] <= state["budget"]))
        return F.when(fits, F.struct(
            (state["budget"] - item["n_chars"]).alias("budget"),
            F.concat(state["kept"], F.array(item["pos"].cast("int"))).alias("kept"))).otherwise(state)

    kept = walked.select("query_id", F.explode(F.aggregate("offers", start, step)["kept"]).alias("pos"))
    return items.join(kept, ["query_id", "pos"])


def footprint(results: DataFrame) -> DataFrame:
    """Size of each answer: items, characters, rough tokens, source chunks."""
    chars = F.sum(F.length("content"))
    return (results.groupBy("query_id").agg(
        F.count("*").alias("items"), chars.cast("bigint").alias("chars"),
        F.countDistinct(X.id_digest(F.col("id"))).alias("chunks"))
        .withColumn("kilotokens", F.col("chars") / 4000))


def footprint_summary(sizes: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Mean footprint next to accuracy and accuracy per thousand tokens.

    *accuracy* has one row with the column ``accuracy``.
    """
    mean = sizes.agg(F.avg("items").alias("items"), F.avg("chars").alias("chars"),
                     F.avg("kilotokens").alias("kilotokens"), F.avg("chunks").alias("chunks"))
    # Two one-row aggregates, put side by side without a join.
    both = mean.unionByName(accuracy.agg(F.max("accuracy").alias("accuracy")), allowMissingColumns=True)
    return (both.agg(*[F.max(c).alias(c) for c in both.columns])
            .withColumn("accuracy_per_kilotoken", F.col("accuracy") / F.col("kilotokens")))
