"""Evaluation of one run: replay a corpus, retrieve, and score the retrieval."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from turnstore import settings as S
from turnstore.operators import evaluation
from turnstore.operators.models import Caller, ModelStage, call_model
from turnstore.plans.search import SearchJob
from turnstore.sources import corpus as corpus_source


@dataclass(frozen=True)
class EvaluationJob:
    """One tag. ``store_tag`` evaluates against memories written under another tag."""

    search: SearchJob
    tag: str
    store_tag: str | None = None
    top_k: int = 100

    def search_requests(self, questions: DataFrame) -> DataFrame:
        user = F.concat(F.lit(f"local:{self.store_tag or self.tag}:locomo:conv-"), F.col("conv").cast("string"))
        return questions.select(
            F.col("question_id").alias("query_id"), F.col("question").alias("query"), user.alias("user_id"),
            F.lit(self.top_k).alias("top_k"), F.lit(None).cast("array<string>").alias("options"))

    def retrieve(self, memories: DataFrame, questions: DataFrame) -> DataFrame:
        """The ranking of every question: question_id, pos, id, content."""
        found = self.search.run(memories, self.search_requests(questions))
        return found.select(F.col("query_id").alias("question_id"), "pos", "id", "content")

    def chunk_map(self, corpus: DataFrame) -> DataFrame:
        return corpus_source.chunk_map(corpus_source.corpus_chunks(corpus, self.store_tag or self.tag))


def report(retrieval: DataFrame, questions: DataFrame, chunk_map: DataFrame) -> dict[str, DataFrame]:
    """Recall tables of a run; refuses to report on a store that does not match."""
    evaluation.check_join(retrieval, chunk_map)
    found = evaluation.first_hits(questions, evaluation.evidence_hits(retrieval, questions, chunk_map))
    return {
        "recall_at_k": evaluation.recall_at_k(found),
        "recall_by_kind": evaluation.recall_by_kind(retrieval, questions, chunk_map),
        "recall_by_category": evaluation.recall_by_category(found),
    }


# What the answering and the judging model are shown.
ANSWER_PROMPT = "{context}\n\nQuestion: {question}"
JUDGE_PROMPT = "Question: {question}\nReference answer: {gold_answer}\nAnswer: {generated_answer}\nReply CORRECT or WRONG."
JUDGE_LABEL = r"\b(CORRECT|WRONG)\b"


def filled(template: str) -> Column:
    """*template* with the columns it names, null ones as empty text."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def judge(answers: DataFrame, judger: Caller | ModelStage, max_calls: int | None = None, template: str = JUDGE_PROMPT,
          label: str = JUDGE_LABEL, raw_chars: int | None = S.JUDGE_RAW_CHARS) -> DataFrame:
    """Answers (question, gold_answer, generated_answer and more) with ``label`` and ``judge_raw``.

    The label is the first match of *label* in the reply. A failed call, or a reply without a
    label, is a missing measurement, never a wrong answer.
    """
    asked = call_model(answers.withColumn("prompt", filled(template)), judger, "prompt", max_calls)
    found = F.nullif(F.regexp_extract(F.coalesce("reply", F.lit("")), label, 1), F.lit(""))
    return evaluation.judged_rows(asked, found, raw_chars).drop("prompt", "reply", "status")


def answer(retrieval: DataFrame, questions: DataFrame, previous: DataFrame, prefix: int, answerer: Caller | ModelStage,
           max_calls: int | None = None, template: str = ANSWER_PROMPT) -> DataFrame:
    """Answers of all questions; only those without an earlier answer are asked."""
    todo = evaluation.unanswered(questions, previous)
    prompts = evaluation.answer_inputs(retrieval, todo, prefix).withColumn("prompt", filled(template))
    new = call_model(prompts, answerer, "prompt", max_calls).select(
        "question_id", F.coalesce("reply", F.lit("")).alias("generated_answer"))
    return evaluation.answer_state(
        questions, evaluation.kept_answers(previous).select("question_id", "generated_answer").unionByName(new))
