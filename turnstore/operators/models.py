"""Model calls as a batch stage over prompts.

A *caller* is a picklable callable built once per task that maps one prompt to a
reply. A failed call gives a null reply and the status ``failed``; it never fails
the job. A :class:`ModelStage` says more about the way there: prompts per call,
calls in flight in a task, tries of a failed call, and a table of earlier replies.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from turnstore.runtime import cut_lineage, small_side
from turnstore.sources.store import read_or_empty

Caller = Callable[[], Callable[[str], str | None]]
BatchCaller = Callable[[], Callable[[list[str]], list[str | None]]]

_REPLY = T.StructType([T.StructField("digest", T.StringType()), T.StructField("reply", T.StringType())])


@dataclass(frozen=True)
class ReplyTable:
    """Replies of one model by prompt digest; a prompt in it is not sent again.

    It only grows, and every row stands for itself, so a run that died has lost nothing
    it wrote. *model* names the model and all settings a reply depends on.
    """

    root: str
    model: str

    @property
    def path(self) -> str:
        return f"{self.root}/replies/model={self.model}"

    def known(self, digests: DataFrame) -> DataFrame:
        """Stored replies of the prompts in *digests*, one per prompt."""
        stored = read_or_empty(digests.sparkSession, _REPLY, self.path)
        return stored.join(small_side(digests.select("digest").distinct()), "digest", "left_semi").dropDuplicates(["digest"])

    def add(self, replies: DataFrame) -> None:
        replies.select(*_REPLY.fieldNames()).write.mode("append").parquet(self.path)


@dataclass(frozen=True)
class ModelStage:
    """A caller and how it is used.

    batch      prompts per call: the caller then builds a function of lists; None: one by one
    in_flight  calls a task has open at once
    retries    further tries of a failed call, after *backoff* seconds, twice as long each time
    replies    table of replies that are used again
    """

    caller: Caller | BatchCaller
    batch: int | None = None
    in_flight: int = 1
    retries: int = 0
    backoff: float = 0.0
    replies: ReplyTable | None = None

    def replier(self) -> Callable[[list[str]], list[str | None]]:
        """Replies to a list of prompts, null for those whose calls failed."""
        call = self.caller()
        ask = call if self.batch else lambda prompts: [call(prompts[0])]

        def tried(prompts: list[str]) -> list[str | None]:
            for n in range(self.retries + 1):
                try:
                    found = list(ask(prompts))
                    if len(found) == len(prompts):
                        return found
                except Exception:  # a provider may raise anything; the row records it
                    pass
                if n < self.retries and self.backoff:
                    time.sleep(self.backoff * 2 ** n)
            # One bad prompt must not fail those it was sent with.
            return [None] if len(prompts) == 1 else [reply for p in prompts for reply in tried([p])]

        def reply(prompts: list[str]) -> list[str | None]:
            size = self.batch or 1
            parts = [prompts[i:i + size] for i in range(0, len(prompts), size)]
            if self.in_flight < 2:
                return [r for part in parts for r in tried(part)]
            with ThreadPoolExecutor(self.in_flight) as pool:
                return [r for found in pool.map(tried, parts) for r in found]

        return reply


def _asked(prompts: DataFrame, stage: ModelStage, prompt: str, max_calls: int | None) -> DataFrame:
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType()),
                           T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = stage.replier()
        for batch in batches:
            replies = ask(batch.column(prompt).to_pylist())
            states = ["failed" if reply is None else "ok" for reply in replies]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(replies, pa.string()), pa.array(states, pa.string())],
                names=[*batch.schema.names, "reply", "status"])

    spread = prompts if max_calls is None else prompts.repartition(max_calls)
    return spread.mapInArrow(run, schema)


def call_model(prompts: DataFrame, caller: Caller | ModelStage | None, prompt: str = "prompt",
               max_calls: int | None = None) -> DataFrame:
    """Add ``reply`` and ``status`` (off, ok or failed) to every row of *prompts*.

    *max_calls* bounds the tasks, and so with ``in_flight`` the calls at once. With a table of
    replies each distinct prompt that is not in it is sent once, and its reply is stored before
    the result can be read; failed prompts are sent again next time.
    """
    if caller is None:
        return prompts.withColumn("reply", F.lit(None).cast("string")).withColumn("status", F.lit("off"))
    stage = caller if isinstance(caller, ModelStage) else ModelStage(caller)
    if stage.replies is None:
        return _asked(prompts, stage, prompt, max_calls)
    rows = cut_lineage(prompts.withColumn("digest", F.sha2(F.coalesce(prompt, F.lit("")), 256)))
    known = stage.replies.known(rows)
    new = rows.select("digest", prompt).dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    given = cut_lineage(_asked(new, stage, prompt, max_calls))
    found = cut_lineage(known.select("digest", "reply", F.lit("ok").alias("status")).unionByName(given.select("digest", "reply", "status")))
    stage.replies.add(given.where("status = 'ok'"))
    return rows.join(small_side(found), "digest", "left").drop("digest")


def stored_replies(spark: SparkSession, table: ReplyTable) -> DataFrame:
    """(digest, reply) of everything a model has answered."""
    return read_or_empty(spark, _REPLY, table.path).dropDuplicates(["digest"])
