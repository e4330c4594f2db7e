"""Which memories a question gets: expansion, near-duplicates, count and budget.

The rule walks a user's memories from the best score down. Every hit is offered,
then the turns around it in its chunk, all with the hit's score. An offer is taken
when its near-duplicate key is new and its text fits the character budget (the
first one always fits); the walk ends at the count cap or when the budget is used
up. A refused hit still offers its neighbours.

As a plan: the order of offers is the sort key (score desc, seq, slot), so the
walk is "first offer per key, then the first L of them" as long as the budget never
refuses anything. That is two windows over a bounded number of hits per question.
The few questions where it is not enough (so many copies that the ranked hits hold
fewer than L keys, or a budget that binds) are finished by :func:`_walk`. It keeps a
small state per question and ranks only hits that still have something to offer to
that state, so copies and oversized texts cost scoring time but no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnstore import settings as S
from turnstore.functions import text as X
from turnstore.operators.ingest import with_keys
from turnstore.operators.scoring import Channel, dot_products, top_hits
from turnstore.runtime import cut_lineage, join_few, small_side

OFFER_ORDER = ["down", "hit_seq", "slot"]
PAGE_HITS = 1_000   # useful hits of one question folded at a time


def offer_ids(hits: DataFrame, radius: int) -> DataFrame:
    """One row per (hit, slot): slot 0 is the hit, then the positions around it.

    Only verbatim turns have neighbours. Ids of positions that were never stored
    are produced too; the join with the memories drops them.
    """
    chunk, index = X.id_digest(F.col("id")), X.id_index(F.col("id"))
    around = [o for o in range(-radius, radius + 1) if o != 0]
    near = [X.memory_id(chunk, F.lit("raw"), index + o) for o in around]
    ids = F.when(X.id_kind(F.col("id")) == "raw", F.array("id", *near)).otherwise(F.array("id"))
    kept = [c for c in hits.columns if c not in ("id", "seq")]
    return hits.select(*kept, F.col("seq").alias("hit_seq"), F.posexplode(ids).alias("slot", "id"))


def keyed(memories: DataFrame) -> DataFrame:
    """Memories with key and length; stored tables have them already."""
    return memories if "dedupe_key" in memories.columns else with_keys(memories)


def offers(hits: DataFrame, memories: DataFrame, radius: int) -> DataFrame:
    """Hits and neighbours with their key and length, without their text.

    Ids are unique, so this is one equi-join. Only memories that are offered leave their
    place, see :func:`~turnstore.runtime.join_few`. *hits* are read several times.
    """
    stored = keyed(memories).select("id", "seq", "kind", F.col("dedupe_key").alias("key"), "n_chars")
    return join_few(stored, offer_ids(hits, radius), ["id"]).withColumn("down", -F.col("score"))


def neighbour_window(hits: DataFrame, memories: DataFrame, radius: int = S.WINDOW_RADIUS) -> DataFrame:
    """Every hit followed by the stored turns around it in its chunk."""
    return offers(cut_lineage(hits), memories, radius).select("query_id", "hit_seq", "slot", "id", "seq", "score")


def first_per_key(offered: DataFrame) -> DataFrame:
    """The first offer of each near-duplicate key."""
    by_key = W.partitionBy("query_id", "key").orderBy(*OFFER_ORDER)
    return offered.withColumn("_n", F.row_number().over(by_key)).where("_n = 1").drop("_n")


def _counted(hits: DataFrame) -> DataFrame:
    """Hits, written once, with their number per question as ``found``."""
    return cut_lineage(hits.withColumn("found", F.count("*").over(W.partitionBy("query_id"))))


def _limits(queries: DataFrame, return_limit: int) -> DataFrame:
    cap = F.least(F.col("top_k"), F.lit(return_limit))
    return queries.where("top_k > 0").select("query_id", cap.alias("limit"))


def _first_pass(hits: DataFrame, memories: DataFrame, limits: DataFrame, n_hits: int, radius: int,
                budget: int, most: int) -> DataFrame:
    """Taken offers per question, with ``exact`` telling whether they are final."""
    offered = offers(hits, memories, radius).join(limits, "query_id").repartition("query_id")
    ordered = W.partitionBy("query_id").orderBy(*OFFER_ORDER)
    capped = (first_per_key(offered).withColumn("take", F.row_number().over(ordered))
              .where((F.col("take") <= most) & (F.col("take") <= F.col("limit"))))
    whole = W.partitionBy("query_id")
    enough = (F.count("*").over(whole) == F.col("limit")) | (F.col("found") < n_hits)
    affordable = F.sum("n_chars").over(whole) <= budget
    return capped.withColumn("exact", enough & affordable)


def _fold(budget: Column, seen: Column, page: Column, limit: Column, taken: Column) -> Column:
    """Walk *page* (offers in order) from a state; returns the new state."""
    start = F.struct(budget.cast("bigint").alias("budget"), seen.alias("seen"), taken.alias("out"))

    def step(state: Column, offer: Column) -> Column:
        out = state["out"]
        full = (F.size(out) >= limit) | ((F.size(out) > 0) & (state["budget"] <= 0))
        fits = (offer["n_chars"] <= state["budget"]) | (F.size(out) == 0)
        take = ~full & fits & ~F.array_contains(state["seen"], offer["key"])
        grown = F.struct(
            (state["budget"] - offer["n_chars"]).cast("bigint").alias("budget"),
            F.concat(state["seen"], F.array(offer["key"])).alias("seen"),
            F.concat(out, F.array(F.struct(offer["id"].alias("id"), offer["score"].alias("score")))).alias("out"))
        return F.when(take, grown).otherwise(state)

    return F.aggregate(page, start, step)


def useful_scores(memories: pa.Table, questions: pa.Table) -> np.ndarray:
    """Dot products, minus infinity where a hit has nothing left to offer.

    A hit is useful when it or a neighbour has an unknown key and still fits.
    """
    scores = dot_products(memories, questions)
    near = memories.column("near_keys").combine_chunks()
    owner = np.repeat(np.arange(len(near)), pc.list_value_length(near).to_numpy(zero_copy_only=False))
    keys = near.flatten().to_numpy(zero_copy_only=False)
    sizes = memories.column("near_chars").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    budgets = questions.column("room").to_numpy()
    seen = questions.column("seen_keys").combine_chunks()
    for q in range(scores.shape[1]):
        known = seen[q].values.to_numpy(zero_copy_only=False)
        offered = (sizes <= budgets[q]) & ~np.isin(keys, known)
        useful = np.zeros(len(near), dtype=bool)
        useful[owner[offered]] = True
        scores[~useful, q] = -np.inf
    return scores


USEFUL = Channel(useful_scores, ("vec", "near_keys", "near_chars"), ("qvec", "room", "seen_keys"), floor=-np.inf)


def _with_near(memories: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """Memories of the asking users with key (hashed) and length of all they can offer."""
    users = small_side(queries.select("user_id").distinct())
    mine = (keyed(memories).join(users, "user_id", "left_semi")
            .select("user_id", "id", "seq", "vec", F.xxhash64("dedupe_key").alias("key"), "n_chars"))
    if radius <= 0:
        return mine.select("*", F.array("key").alias("near_keys"), F.array("n_chars").alias("near_chars"))
    probes = offer_ids(mine.select(F.col("id").alias("owner"), "id", "seq"), radius)
    near = (probes.join(mine.select("id", "key", "n_chars"), "id").groupBy(F.col("owner").alias("id"))
            .agg(F.collect_list(F.struct("key", "n_chars")).alias("near")))
    return mine.drop("key", "n_chars").join(near, "id").select(
        "*", F.col("near.key").alias("near_keys"), F.col("near.n_chars").alias("near_chars")).drop("near")


def _walk(pending: DataFrame, memories: DataFrame, queries: DataFrame, radius: int, budget: int,
          page_hits: int, **plan) -> DataFrame:
    """Exact walk for the questions in *pending* (query_id, limit): query_id, id, score, take.

    Budgets only shrink and keys only become known, so an offer that was refused
    once stays refused. Each pass ranks the best *page_hits* useful hits of every
    unfinished question and folds their offers in order. The first useful hit has
    an acceptable offer, so there are at most L passes; a question with fewer
    useful hits than a page is finished. Two are the rule.
    """
    asked = queries.select("query_id", "user_id", "qvec").join(pending.select("query_id"), "query_id", "left_semi")
    store = cut_lineage(_with_near(memories, asked, radius))
    no_keys = F.array().cast("array<string>")
    no_items = F.array().cast("array<struct<id:string,score:double>>")
    state = pending.select("query_id", "limit", F.lit(budget).cast("bigint").alias("budget"),
                           no_keys.alias("seen"), no_items.alias("out"))
    # The first item is taken whatever its length.
    room = F.when(F.size("out") == 0, F.lit(2**31 - 1).cast("bigint")).otherwise(F.col("budget"))
    order = F.struct(*OFFER_ORDER)
    finished = []
    while True:
        questions = asked.join(state.select(
            "query_id", room.alias("room"), F.transform("seen", lambda k: F.xxhash64(k)).alias("seen_keys")), "query_id")
        hits = _counted(top_hits(store, questions, page_hits, USEFUL, **plan))
        offered = offers(hits, memories, radius).join(state, "query_id")
        fresh = ~F.array_contains("seen", F.col("key")) & (F.col("n_chars") <= room)
        # Copies share key and length: they shrink to one row before the shuffle.
        distinct = offered.where(fresh).groupBy("query_id", "key", "n_chars").agg(
            F.min(F.struct(order.alias("order"), "id", "score")).alias("first"), F.max("found").alias("found"))
        page = distinct.groupBy("query_id").agg(F.max("found").alias("found"), F.array_sort(F.collect_list(F.struct(
            F.col("first.order").alias("order"), "key", "n_chars",
            F.col("first.id").alias("id"), F.col("first.score").alias("score")))).alias("page"))
        no_page = F.array().cast(page.schema["page"].dataType)
        folded = _fold(F.col("budget"), F.col("seen"), F.coalesce("page", no_page), F.col("limit"), F.col("out"))
        full = (F.size("new.out") >= F.col("limit")) | ((F.size("new.out") > 0) & (F.col("new.budget") <= 0))
        after = cut_lineage(
            state.join(page, "query_id", "left").withColumn("new", folded)
            .select("query_id", "limit", F.col("new.budget").alias("budget"), F.col("new.seen").alias("seen"),
                    F.col("new.out").alias("out"),
                    (full | (F.coalesce("found", F.lit(0)) < page_hits)).alias("done")))
        finished.append(after.where("done").select("query_id", "out"))
        state = after.where("not done").drop("done")
        if state.isEmpty():
            break
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    return (out.select("query_id", F.posexplode("out").alias("take", "item"))
            .select("query_id", (F.col("take") + 1).alias("take"), "item.id", "item.score"))


def select_memories(memories: DataFrame, queries: DataFrame, radius: int = S.WINDOW_RADIUS,
                    char_budget: int = S.RETURN_CHAR_BUDGET, return_limit: int = S.RETURN_LIMIT,
                    hit_factor: int = 2, page_hits: int = PAGE_HITS, **plan) -> DataFrame:
    """The memories each question gets, in the order they are taken.

    *queries* has query_id, user_id, qvec and top_k. Result: query_id, take (from
    1), id, score, kind, content, created_at; the text is read for the selected
    memories only. *plan* goes to the scoring operator.
    """
    limits = _limits(queries, return_limit)
    # The first pass ranks hit_factor times the largest answer asked for.
    most = limits.agg(F.max("limit").alias("most")).first()["most"] or 1
    n_hits = max(1, hit_factor * most)
    columns = ["query_id", "take", "id", "score"]
    hits = _counted(top_hits(memories, queries.where("top_k > 0"), n_hits, **plan))
    first = cut_lineage(_first_pass(hits, memories, limits, n_hits, radius, char_budget, most)
                        .select(*columns, "limit", "exact"))
    taken = first.where("exact").select(*columns)
    pending = first.where("not exact").select("query_id", "limit").distinct()
    if not pending.isEmpty():
        taken = taken.unionByName(_walk(pending, memories, queries, radius, char_budget, page_hits, **plan))
    return join_few(memories.select("id", "kind", "content", "created_at"), taken, ["id"])
