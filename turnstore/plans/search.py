"""Read path: a batch of questions over many users' memories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from turnstore.functions.vectors import Embedder, blend, embed
from turnstore.operators import ordering, rounds
from turnstore.operators.models import Caller, ModelStage, call_model
from turnstore.operators.selection import select_memories
from turnstore.runtime import cut_lineage
from turnstore.settings import SearchSettings
from turnstore.sources.requests import search_request_problem
from turnstore.sources.tables import of_askers

RESULT = ["query_id", "pos", "id", "kind", "content", "score", "created_at"]


@dataclass(frozen=True)
class SearchJob:
    """Models and knobs of a search. Without callers it runs degraded: dense only."""

    embedder: Embedder
    settings: SearchSettings = field(default_factory=SearchSettings)
    recaller: Caller | ModelStage | None = None
    reflector: Caller | ModelStage | None = None
    max_calls: int | None = None

    def embedded(self, queries: DataFrame) -> DataFrame:
        """Add the one vector each question is scored with; needs ``recall``."""
        question = embed(F.col("query"), self.embedder, is_query=True)
        # Without a recall question there is nothing to embed, and the blend is the question alone.
        recall = embed(F.col("recall"), self.embedder, is_query=True, skip_nulls=True)
        return (queries.withColumn("qv", question).withColumn("rv", recall)
                .withColumn("qvec", blend(F.col("qv"), F.col("rv"), self.settings.recall_weight)).drop("qv", "rv"))

    def one_round(self, memories: DataFrame, queries: DataFrame) -> DataFrame:
        """Results of questions that already have ``qvec``."""
        knobs = self.settings
        taken = select_memories(memories, queries, knobs.radius, knobs.char_budget, knobs.return_limit, knobs.hit_factor,
                                salts=knobs.salts)
        return ordering.ordered(taken, knobs.ordering).select(*RESULT)

    def run(self, memories: DataFrame, requests: DataFrame) -> DataFrame:
        """Results of all questions: query_id, pos, id, kind, content, score, created_at."""
        valid = requests.where(search_request_problem(requests).isNull()).where("top_k > 0")
        asked = cut_lineage(self.embedded(rounds.with_recall(valid, self.recaller, self.max_calls)))
        memories = of_askers(memories, asked)
        first = self.one_round(memories, asked)
        if not self.settings.second_round or self.reflector is None:
            return first
        first = cut_lineage(first)
        prompts = rounds.reflection_inputs(asked.drop("qvec", "recall"), first)
        more = rounds.follow_ups(call_model(prompts, self.reflector, "prompt", self.max_calls))
        again = cut_lineage(self.embedded(more))
        second = self.one_round(memories, again)
        reopened = first.join(again.select("query_id"), "query_id", "left_semi")
        merged = rounds.merge_rounds(reopened, second, again, self.settings.char_budget, self.settings.return_limit)
        unchanged = first.join(again.select("query_id"), "query_id", "left_anti")
        return unchanged.unionByName(merged.select(*RESULT))
