"""Write path: Add requests to committed memories, once per (request_id, user_id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstore import settings as S
from turnstore.functions.vectors import Embedder, embed
from turnstore.operators import ingest
from turnstore.operators.models import Caller, ModelStage
from turnstore.runtime import cut_lineage, small_side
from turnstore.sources import requests as requests_source
from turnstore.sources import tables
from turnstore.sources.store import FAN_IN, USER_BUCKETS, Store


@dataclass(frozen=True)
class AddJob:
    """Where memories go and which models make them."""

    root: str
    embedder: Embedder
    extractor: Caller | ModelStage | None = None
    max_calls: int | None = None
    # Tasks that embed one batch. A model is slow for its bytes, so a small batch
    # that Spark would put in one task may be spread by hand.
    embed_tasks: int | None = None
    # Facts kept from one reply; None keeps all.
    max_facts: int | None = S.MAX_FACTS
    # Buckets of the store, live attempts that are merged at once, blocks a user's requests are numbered in.
    buckets: int = USER_BUCKETS
    fan_in: int = FAN_IN
    pieces: int = 64

    @property
    def store(self) -> Store:
        return Store(self.root, self.buckets, self.fan_in)

    def run(self, requests: DataFrame, batch: int) -> DataFrame:
        """Write one batch and return the status of every request in it.

        *requests* is read once, into the shared folder; everything else starts from there.
        Requests are told apart by small rows of keys, and only those that are new are read
        with their messages. The model's replies are pinned before anything is written, so a
        task that is run again cannot mix two extractions of one chunk. *batch* is a label
        only: a run adds what the store does not hold and never replaces anything, so a dead
        run is simply repeated. Rejected requests go to the quarantine.
        """
        spark = requests.sparkSession
        checked = cut_lineage(requests.withColumn("problem", requests_source.add_request_problem(requests))
                              .withColumn("_row", F.monotonically_increasing_id()))
        rejected = checked.where("problem is not null").drop("_row")
        if not rejected.isEmpty():
            tables.write_quarantine(self.root, batch, rejected)
        good = checked.where("problem is null").drop("problem", tables.CORRUPT)
        attempts = self.store.attempts(spark)
        fresh = cut_lineage(ingest.first_keys(good, "_row"))
        if attempts:
            fresh = fresh.join(self.store.stored_requests(fresh, attempts), ["request_id", "user_id"], "left_anti")
        fresh = good.join(small_side(fresh.select("_row")), "_row", "left_semi").drop("_row")
        read = ingest.extracted(ingest.prepared(fresh), self.extractor, self.max_calls, self.max_facts)
        pinned = cut_lineage(read.drop("messages", "reply", "transcript"))
        ledger = ingest.new_ledger(pinned)
        n_items = ledger.agg(F.sum("n_items")).first()[0]
        if n_items:
            starts = self.store.stored_counts(pinned, attempts)
            items = ingest.sequenced(ingest.with_bases(pinned, starts, self.pieces))
            if self.embed_tasks:
                items = items.repartition(self.embed_tasks, "id")
            self.store.append(batch, with_vectors(ingest.with_keys(items), self.embedder), ledger, n_items)
        return add_report(checked, pinned)


def with_vectors(memories: DataFrame, embedder: Embedder) -> DataFrame:
    return memories.withColumn("vec", embed(F.col("content"), embedder))


def add_report(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """One row per request: stored, duplicate, blank or rejected."""
    written = stored.select("request_id", "user_id", F.lit(True).alias("new")).distinct()
    problem = F.col("problem") if "problem" in requests.columns else requests_source.add_request_problem(requests)
    blank = F.size(ingest.numbered_messages()) == 0
    status = (F.when(problem.isNotNull(), "rejected").when(blank, "blank")
              .when(F.col("new"), "stored").otherwise("duplicate"))
    return (requests.join(written, ["request_id", "user_id"], "left")
            .select("request_id", "user_id", "session_id", problem.isNull().alias("success"), status.alias("status")))


def memories(spark: SparkSession, root: str) -> DataFrame:
    """Everything that can be searched."""
    return tables.read_memories(spark, root)
