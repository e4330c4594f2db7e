"""Model prompts around a search, and the second retrieval round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from turnstore import settings as S
from turnstore.functions import replies as R, text as X
from turnstore.operators.models import Caller, ModelStage, call_model


def recall_prompts(queries: DataFrame) -> DataFrame:
    """One prompt per distinct (query, options)."""
    return (queries.select("query", "options").distinct()
            .withColumn("prompt", R.recall_prompt(F.col("query"), F.col("options"))))


def with_recall(queries: DataFrame, caller: Caller | ModelStage | None, max_calls: int | None = None) -> DataFrame:
    """Add ``recall``: the model's question in the user's voice, or null."""
    if caller is None:
        return queries.withColumn("recall", F.lit(None).cast("string"))
    prompted = queries.withColumn("_prompt", R.recall_prompt(F.col("query"), F.col("options")))
    replies = call_model(recall_prompts(queries).select("prompt").distinct(), caller, "prompt", max_calls)
    asked = replies.select(F.col("prompt").alias("_prompt"),
                           R.recall_question(R.strip_reasoning(F.col("reply"))).alias("recall"))
    return prompted.join(asked, "_prompt", "left").drop("_prompt")


def reflection_inputs(queries: DataFrame, results: DataFrame) -> DataFrame:
    """The prompt that asks whether the first results suffice, one per question."""
    shown = (results.where(F.col("pos") < S.REFLECT_ITEMS).groupBy("query_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("_top")))
    return (queries.join(shown, "query_id")
            .withColumn("prompt", R.reflection_prompt(F.col("query"), F.col("options"), F.col("_top.content")))
            .drop("_top"))


def follow_ups(reflected: DataFrame) -> DataFrame:
    """Questions that need a second round, with the question to ask."""
    question = R.follow_up_question(R.strip_reasoning(F.col("reply")))
    return reflected.withColumn("recall", question).where("recall is not null").drop("reply", "status", "prompt")


def merge_rounds(first: DataFrame, second: DataFrame, queries: DataFrame,
                 budget: int = S.RETURN_CHAR_BUDGET, return_limit: int = S.RETURN_LIMIT) -> DataFrame:
    """Merge two result lists (query_id, pos, id, kind, content, score, created_at).

    Per near-duplicate key the better score wins, the earlier one on a tie; the key
    keeps the place where it first appeared, which orders equal scores. The count
    cap and the budget are applied again: an item is kept while the budget is not
    yet used up, so the last one may exceed it.
    """
    both = (first.withColumn("turn", F.lit(0)).unionByName(second.withColumn("turn", F.lit(1)))
            .withColumn("key", X.dedupe_key(F.col("content"))))
    item = F.struct("id", "kind", "content", "score", "created_at")
    seen = F.struct("turn", "pos")
    merged = both.groupBy("query_id", "key").agg(
        F.min_by(item, F.struct(-F.col("score"), seen)).alias("item"), F.min(seen).alias("seen"))
    limits = queries.select("query_id", F.least(F.col("top_k"), F.lit(return_limit)).alias("limit"))
    order = W.partitionBy("query_id").orderBy(F.desc("item.score"), "seen")
    used = F.sum(F.length("item.content")).over(order.rowsBetween(W.unboundedPreceding, -1))
    return (merged.join(limits, "query_id")
            .withColumn("pos", F.row_number().over(order) - 1)
            .withColumn("used", F.coalesce(used, F.lit(0)))
            .where((F.col("pos") < F.col("limit")) & (F.col("used") < budget))
            .select("query_id", "pos", "item.*"))
