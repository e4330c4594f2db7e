"""Does retrieval find the evidence, and do answers come out right?

Provenance is joined by equality only. A verbatim hit stands for one turn, a fact
for every turn of its chunk, so facts meet the chunk map by digest and verbatim
hits by digest and position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnstore import settings as S
from turnstore.functions import text as X


def result_provenance(results: DataFrame, chunk_map: DataFrame) -> DataFrame:
    """Source turns of each result id: the turn itself, or the fact's whole chunk.

    Ids that are unknown or badly formed have none.
    """
    ids = results.select("id").distinct().select(
        "id", X.id_digest(F.col("id")).alias("digest"), X.id_kind(F.col("id")).alias("kind"),
        X.id_index(F.col("id")).alias("position")).where("digest is not null")
    turns = chunk_map.where("dia_id != ''").select("digest", "position", "dia_id")
    raws = ids.where("kind = 'raw'").join(turns, ["digest", "position"])
    facts = ids.where("kind = 'fact'").drop("position").join(turns.drop("position"), "digest")
    return raws.select("id", "dia_id").unionByName(facts.select("id", "dia_id")).distinct()


def check_join(retrieval: DataFrame, chunk_map: DataFrame) -> int:
    """Number of retrieved digests that exist in the chunk map.

    Raises when something was retrieved and nothing matches: then store and map
    belong to different runs, and a recall of zero would be a lie.
    """
    found = matching_digests(retrieval, chunk_map).count()
    if found == 0 and not retrieval.isEmpty():
        raise ValueError("no retrieved id belongs to a known chunk: store and chunk map do not match")
    return found


def matching_digests(retrieval: DataFrame, chunk_map: DataFrame) -> DataFrame:
    """Retrieved digests that exist in the chunk map."""
    retrieved = retrieval.select(F.substring("id", 1, 16).alias("digest")).distinct()
    return retrieved.join(chunk_map.select("digest"), "digest", "left_semi")


def with_evidence(questions: DataFrame) -> DataFrame:
    """Questions that can be scored."""
    return questions.where(F.size("evidence") > 0)


def evidence_hits(retrieval: DataFrame, questions: DataFrame, chunk_map: DataFrame) -> DataFrame:
    """Results that stand for an evidence turn: question_id, pos, kind.

    Turn ids repeat between conversations. Where both sides name the conversation
    (``conv``), evidence is located by (conv, turn), which is unique; otherwise it
    is looked up in the chunks each question retrieved. Verbatim hits must match
    the position too.
    """
    by_conv = "conv" in questions.columns and "conv" in chunk_map.columns
    conv = ["conv"] if by_conv else []
    gold = with_evidence(questions).select("question_id", *conv, F.explode(F.array_distinct("evidence")).alias("dia_id"))
    ranked = retrieval.select(
        "question_id", "pos", X.id_digest(F.col("id")).alias("digest"),
        X.id_kind(F.col("id")).alias("kind"), X.id_index(F.col("id")).alias("position"))
    turns = chunk_map.where("dia_id != ''").select("digest", "position", "dia_id", *conv)
    if by_conv:
        located = gold.join(turns, ["conv", "dia_id"])
    else:
        located = (ranked.select("question_id", "digest").distinct().join(turns, "digest")
                   .join(gold, ["question_id", "dia_id"], "left_semi"))
    by_chunk = located.groupBy("question_id", "digest").agg(F.collect_set("position").alias("positions"))
    proves = (F.col("kind") == "fact") | F.array_contains("positions", F.col("position"))
    return ranked.join(by_chunk, ["question_id", "digest"]).where(proves).select("question_id", "pos", "kind")


def first_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Every scorable question with the position of its first hit, null when missed."""
    first = hits.groupBy("question_id").agg(F.min("pos").alias("first_pos"))
    return with_evidence(questions).join(first, "question_id", "left")


def recall_at_k(found: DataFrame, cutoffs: Sequence[int] = S.RECALL_CUTOFFS) -> DataFrame:
    """Recall at every cutoff, from one pass over :func:`first_hits`."""
    counts = found.agg(F.count("*").alias("n"), *[
        F.count_if(F.col("first_pos") < k).alias(f"k{k}") for k in cutoffs])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hits")) for k in cutoffs])
    return (counts.select("n", F.inline(rows))
            .select("k", "hits", "n", (F.col("hits") / F.greatest("n", F.lit(1))).alias("recall")))


def recall_by_kind(retrieval: DataFrame, questions: DataFrame, chunk_map: DataFrame,
                   k: int = S.KIND_CUTOFF) -> DataFrame:
    """Recall of verbatim-only and fact-only rankings; the cut follows the filter."""
    kind = X.id_kind(F.col("id"))
    within = W.partitionBy("question_id", "kind").orderBy("pos")
    alone = (retrieval.withColumn("kind", kind).where("kind is not null")
             .withColumn("pos", F.row_number().over(within) - 1).where(F.col("pos") < k).drop("kind"))
    hits = evidence_hits(alone, questions, chunk_map).groupBy("kind").agg(
        F.countDistinct("question_id").alias("hits"))
    scored = with_evidence(questions).agg(F.count("*").alias("n"))
    kinds = scored.select("n", F.explode(F.array(F.lit("raw"), F.lit("fact"))).alias("kind"))
    return (kinds.join(hits, "kind", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
            .select("kind", "hits", "n", (F.col("hits") / F.greatest("n", F.lit(1))).alias("recall")))


def recall_by_category(found: DataFrame, k: int = S.KIND_CUTOFF) -> DataFrame:
    """Recall per category, and over all (category null, ``is_total`` 1)."""
    hit = F.coalesce(F.col("first_pos") < k, F.lit(False)).cast("int")
    return found.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"), F.count("*").alias("n"),
        F.sum(hit).alias("hits"), F.avg(hit).alias("recall"))


def answer_inputs(retrieval: DataFrame, questions: DataFrame, prefix: int) -> DataFrame:
    """Question and context (the first *prefix* results) of each answer call."""
    context = (retrieval.where(F.col("pos") < prefix).groupBy("question_id")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "content"))).alias("_top")))
    text = F.coalesce(F.array_join("_top.content", "\n"), F.lit(""))
    return questions.join(context, "question_id", "left").withColumn("context", text).drop("_top")


def kept_answers(previous: DataFrame) -> DataFrame:
    """Earlier answers that are not blank."""
    return previous.where(X.strip(F.coalesce("generated_answer", F.lit(""))) != "")


def unanswered(questions: DataFrame, previous: DataFrame) -> DataFrame:
    """Questions that still have to be answered."""
    return questions.join(kept_answers(previous).select("question_id"), "question_id", "left_anti")


def answer_state(questions: DataFrame, previous: DataFrame) -> DataFrame:
    """Every question with its kept answer, or an empty one and ``gap``."""
    kept = kept_answers(previous).select("question_id", "generated_answer")
    return (questions.join(kept, "question_id", "left")
            .withColumn("gap", F.col("generated_answer").isNull())
            .withColumn("generated_answer", F.coalesce("generated_answer", F.lit(""))))


def judged_rows(answers: DataFrame, label: Column, raw_chars: int | None = S.JUDGE_RAW_CHARS) -> DataFrame:
    """Judge replies with their label; a failed call is a missing label, not a wrong one.

    The first *raw_chars* code points of a reply are kept (None: all).
    """
    failed = F.col("status") == "failed"
    raw = F.coalesce("reply", F.lit("JUDGE_ERROR"))
    return (answers.withColumn("label", F.when(~failed, label))
            .withColumn("judge_raw", raw if raw_chars is None else F.substring(raw, 1, raw_chars)))


def judge_summary(judged: DataFrame) -> DataFrame:
    """Accuracy over valid labels per prefix, with the excluded count."""
    return judged.groupBy("prefix").agg(
        F.count("label").alias("valid"), F.count_if(F.col("label") == S.CORRECT).alias("correct"),
        F.count_if(F.col("label").isNull()).alias("excluded")).withColumn(
        "accuracy", F.col("correct") / F.greatest("valid", F.lit(1)))


def _ratio(top: str, bottom: str, name: str) -> Column:
    return (F.col(top) / F.greatest(bottom, F.lit(1))).alias(name)


def answer_sweep(judged: DataFrame, questions: DataFrame, retrieval: DataFrame, found: DataFrame) -> DataFrame:
    """Accuracy and coverage at every prefix, unrounded, one row per prefix.

    A judged row without a retrieval record or without evidence counts for the
    accuracy and for neither side of the coverage.
    """
    recorded = retrieval.select("question_id").distinct()
    gold = (with_evidence(questions).select("question_id").join(recorded, "question_id", "left_semi")
            .join(found.select("question_id", "first_pos"), "question_id", "left"))
    rows = (judged.where("label is not null")
            .join(gold.withColumn("has_gold", F.lit(True)), "question_id", "left"))
    right = F.col("label") == S.CORRECT
    hit = F.col("has_gold") & F.coalesce(F.col("first_pos") < F.col("prefix"), F.lit(False))
    miss = F.col("has_gold") & ~F.coalesce(F.col("first_pos") < F.col("prefix"), F.lit(False))
    counts = rows.groupBy("prefix").agg(
        F.count("*").alias("n"), F.count_if(right).alias("right"), F.count_if(hit).alias("hit"),
        F.count_if(miss).alias("miss"), F.count_if(hit & right).alias("hit_right"),
        F.count_if(miss & right).alias("miss_right")).withColumn("gold", F.col("hit") + F.col("miss"))
    return counts.select(
        "prefix", "n", _ratio("right", "n", "accuracy"), _ratio("hit", "gold", "coverage"),
        _ratio("hit_right", "hit", "accuracy_given_retrieved"),
        _ratio("miss_right", "miss", "accuracy_given_missed"))


def rounded_sweep(sweep: DataFrame, digits: int = 3) -> DataFrame:
    """The sweep as it is shown."""
    ratios = [c for c in sweep.columns if c not in ("prefix", "n")]
    return sweep.select("prefix", "n", *[F.round(c, digits).alias(c) for c in ratios])


def best_prefix(sweep: DataFrame) -> DataFrame:
    """The prefix with the best rounded accuracy, the smallest on a tie."""
    rank = F.struct(F.round("accuracy", 3), -F.col("prefix"))
    return sweep.agg(F.max_by("prefix", rank).alias("prefix"), F.max(F.round("accuracy", 3)).alias("accuracy"))


def paired_flips(judged: DataFrame, best: DataFrame) -> DataFrame:
    """Every other prefix against the best one over the questions both judged."""
    valid = judged.where("label is not null").select(
        "prefix", "question_id", (F.col("label") == S.CORRECT).alias("right"))
    chosen = F.broadcast(best.select(F.col("prefix").alias("best")).limit(1))  # one row
    is_best = valid["prefix"] == chosen["best"]
    base = valid.join(chosen, is_best).select("question_id", "best", F.col("right").alias("best_right"))
    pairs = valid.join(chosen, is_best, "left_anti").join(base, "question_id")
    return pairs.groupBy("prefix", "best").agg(
        F.count_if(F.col("right") & ~F.col("best_right")).alias("only_other"),
        F.count_if(~F.col("right") & F.col("best_right")).alias("only_best"),
        F.count("*").alias("shared")).withColumn("net", F.col("only_best") - F.col("only_other"))
