"""One query per operator of the library, over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnstore import settings as S
from turnstore.functions import replies as R, text as X
from turnstore.functions.vectors import blend, embed
from turnstore.operators import (evaluation, health, ingest, lexical, policies, replicates, rounds, selection)
from turnstore.operators.models import ModelStage, ReplyTable
from turnstore.operators.scoring import top_hits
from turnstore.plans.add import AddJob, with_vectors
from turnstore.plans.evaluate import judge
from turnstore.plans.search import SearchJob
from turnstore.runtime import cut_lineage, scratch_path
from turnstore.settings import SearchSettings
from turnstore.sources import corpus as corpus_source, requests as requests_source, tables
from turnstore.sources.store import Store
from turnstore.streaming.ingest import start_ingest
from workloads import callers, derive as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _score6(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


# --- write path ----------------------------------------------------------------------

@query
def ingest_messages(spark, sf):
    items = ingest.raw_memories(ingest.prepared(D.requests(spark, sf)))
    return items.select("id", "user_id", "session_id", "request_id", "kind", "content", "created_at")


@query
def item_ids(spark, sf):
    said = D.messages(spark, sf)
    chunk = X.digest(F.col("user_id"), F.col("request_id"))
    ids = said.select("request_id", "user_id", "position", X.memory_id(chunk, F.lit("raw"), F.col("position")).alias("id"))
    return ids.withColumn("digest", X.id_digest(F.col("id"))).withColumn("kind", X.id_kind(F.col("id")))


@query
def quarantine_requests(spark, sf):
    """Events become requests with one defect each, by their type."""
    events = D.table(spark, sf, "events")
    made = D.event_requests(events).join(events.select(D.text("event_id").alias("request_id"), "event_type"), "request_id")
    kind = F.col("event_type")
    broken = made.select(
        "request_id", F.when(kind != "click", F.col("user_id")).alias("user_id"), "session_id",
        F.when(kind == "view", F.array().cast(made.schema["messages"].dataType))
        .when(kind == "error", F.transform("messages", lambda m: m.withField("content", F.lit(None).cast("string"))))
        .otherwise(F.col("messages")).alias("messages"), "arrival")
    return requests_source.quarantined(broken).select("request_id", "problem")


@query
def chunk_transcript(spark, sf):
    return ingest.chunk_transcripts(D.requests(spark, sf)).select("request_id", "user_id", "digest", "transcript")


@query
def facts_from_replies(spark, sf):
    read = ingest.with_facts(D.replied(spark, sf))
    return read.select("request_id", "user_id", F.posexplode("facts").alias("position", "fact"))


@query
def extract_with_caller(spark, sf):
    """Facts a model finds in every chunk: lists of prompts, several calls at once, failures tried again, replies kept."""
    replies = ReplyTable(scratch_path(spark, "replies"), "workload")
    stage = ModelStage(callers.extractor, batch=8, in_flight=4, retries=1, replies=replies)
    asked = ingest.prepared(D.requests(spark, sf))
    ingest.extracted(asked, stage)
    # The second run sends only what failed before.
    read = ingest.extracted(asked, stage)
    return read.select("request_id", "user_id", "status", F.array_join("facts", "|").alias("facts"))


@query
def fact_memories(spark, sf):
    items = ingest.fact_memories(ingest.with_facts(D.replied(spark, sf)))
    return items.select("id", "user_id", "request_id", "kind", "content", "created_at")


@query
def build_memories(spark, sf):
    items = ingest.build_memories(ingest.with_facts(D.replied(spark, sf)))
    return items.select("id", "user_id", "session_id", "kind", "content", "created_at")


@query
def assign_seq(spark, sf):
    """Every conversation is new; the store already holds three memories per user."""
    asked = ingest.with_facts(D.replied(spark, sf))
    ledger = asked.select("user_id").distinct().select(
        F.lit("earlier").alias("request_id"), "user_id", F.lit(3).cast("bigint").alias("n_items"))
    return ingest.sequenced(ingest.assign_bases(asked, ledger)).select("id", "user_id", "kind", "seq")


@query
def embed_memories(spark, sf):
    """Unit vectors of all memories, as their non-zero entries."""
    made = D.with_vectors(D.chat_items(spark, sf), D.EMBEDDER)
    entries = made.select("id", F.posexplode("vec").alias("dim", "value")).where("value != 0")
    return entries.select("id", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def upsert_memories(spark, sf):
    """Every user message of a stored table is written again, twice; the last text wins, and the store is merged."""
    store = Store(scratch_path(spark, "upsert"), fan_in=0)
    items = cut_lineage(with_vectors(ingest.with_keys(D.chat_items(spark, sf)), D.EMBEDDER))
    store.append(0, items, items.groupBy("request_id", "user_id").agg(F.count("*").alias("n_items")))
    again = items.where("content like '%I: %' and kind = 'raw'")
    attempts = F.explode(F.array(F.lit(1), F.lit(2)))
    store.replace(again.withColumn("version", attempts).withColumn(
        "content", F.concat("content", F.lit(" v"), D.text("version"))), "version")
    store.merge(spark)
    return store.memories(spark).select("id", "user_id", "kind", "content", "seq")


@query
def ingest_exactly_once(spark, sf):
    """All requests arrive twice in two batches, once more under another user."""
    root = scratch_path(spark, "exactly-once")
    asked = D.requests(spark, sf)
    other = asked.withColumn("user_id", F.concat(F.lit("other-"), "user_id"))
    job = AddJob(root, D.EMBEDDER, embed_tasks=spark.sparkContext.defaultParallelism)
    job.run(asked.unionByName(asked), 0)
    job.run(asked.unionByName(other), 1)
    job.run(asked.unionByName(other), 1)
    return tables.read_memories(spark, root).select("id", "user_id", "request_id", "seq", "content", "batch")


@query
def seq_across_batches(spark, sf):
    """Three written batches of the same users; each goes on where the last one ended."""
    root = scratch_path(spark, "batches")
    asked = D.requests(spark, sf)
    job = AddJob(root, D.EMBEDDER, embed_tasks=spark.sparkContext.defaultParallelism)
    for batch in range(3):
        job.run(asked.where(F.col("arrival") % 3 == batch), batch)
    return tables.read_memories(spark, root).select("id", "user_id", "request_id", "seq", "batch")


@query
def stream_ingest(spark, sf):
    """All events stream in, then the whole stream is sent again by a new stream with the same numbers."""
    root = scratch_path(spark, "stream")
    events = D.table(spark, sf, "events")
    source = (spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    job = AddJob(root, D.EMBEDDER, embed_tasks=spark.sparkContext.defaultParallelism)
    for _ in range(2):
        run = start_ingest(D.event_requests(source), job, scratch_path(spark, "offsets"), available_now=True)
        run.awaitTermination()
    return tables.read_memories(spark, root).select("id", "user_id", "seq", "content", "created_at", "batch")


@query
def user_memories(spark, sf):
    """Every user's memories in written order."""
    memories = D.chat_memories(spark, sf)
    users = D.requests(spark, sf).select("user_id").distinct()
    return tables.user_memories(memories, users).select("user_id", "seq", "id", "kind", "content")


@query
def id_isolation(spark, sf):
    """Ids that two users share when both send the same requests: none."""
    asked = ingest.prepared(D.requests(spark, sf))
    other = ingest.prepared(D.requests(spark, sf).withColumn("user_id", F.concat(F.lit("other-"), "user_id")))
    mine, theirs = ingest.raw_memories(asked).select("id"), ingest.raw_memories(other).select("id")
    shared = mine.intersect(theirs).agg(F.count("*").alias("shared"))
    counted = mine.unionByName(theirs).agg(F.count("*").alias("stored"), F.countDistinct("id").alias("ids"))
    both = counted.unionByName(shared, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query
def store_stats(spark, sf):
    return health.store_stats(D.chat_memories(spark, sf))


@query
def channel_health(spark, sf):
    return health.channel_health(ingest.with_facts(D.replied(spark, sf)))


@query
def ingest_report(spark, sf):
    return ingest.ingest_report(D.requests(spark, sf))


# --- search --------------------------------------------------------------------------

@query
def search_scores(spark, sf):
    hits = top_hits(D.vector_memories(spark, sf), D.vector_questions(spark, sf), 10)
    return _score6(hits.select("query_id", "id", "score", "p"))


@query
def rank_memories(spark, sf):
    """All of a label's memories in rank order for each of its questions, as far as the return limit."""
    hits = top_hits(D.vector_memories(spark, sf), D.vector_questions(spark, sf), S.RETURN_LIMIT, strategy="grid")
    return _score6(hits.select("query_id", "seq", "score", "p"))


@query
def fused_scores(spark, sf):
    """The recall vector of a question is the next vector of the table, if there is one."""
    asked = D.vector_questions(spark, sf)
    recall = D.table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("rv"))
    fused = asked.join(recall, "vec_id", "left").withColumn("qvec", blend(F.col("qvec"), F.col("rv")))
    return _score6(top_hits(D.vector_memories(spark, sf), fused, 10).select("query_id", "id", "score", "p"))


@query
def embed_queries(spark, sf):
    asked = D.document_questions(spark, sf).withColumn("vec", embed(F.col("query"), D.EMBEDDER, is_query=True))
    entries = asked.select("query_id", F.posexplode("vec").alias("dim", "value")).where("value != 0")
    return entries.select("query_id", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@query
def recall_prompts(spark, sf):
    asked = D.chat_questions(spark, sf)
    first_line = F.concat(F.lit('"'), F.element_at(X.lines(F.col("query")), 1), F.lit('"\nsecond line'))
    return rounds.recall_prompts(asked).select(
        "query", "prompt", R.recall_question(R.strip_reasoning(first_line)).alias("recall"))


@query
def neighbour_window(spark, sf):
    memories = D.vector_memories(spark, sf)
    hits = top_hits(memories, D.vector_questions(spark, sf), 5)
    return selection.neighbour_window(hits, memories, 2).select("query_id", "hit_seq", "slot", "id")


def _embedded(asked: DataFrame) -> DataFrame:
    return cut_lineage(asked.withColumn("qvec", embed(F.col("query"), D.EMBEDDER, is_query=True)))


def _document_search(spark, sf, top_k=20, **knobs):
    settings = SearchSettings(**knobs)
    job = SearchJob(D.EMBEDDER, settings)
    return job.run(D.document_memories(spark, sf), D.document_questions(spark, sf, top_k))


def _shown(results: DataFrame) -> DataFrame:
    return _score6(results.select("query_id", "pos", "id", "kind", "score"))


@query
def search_memories(spark, sf):
    """Every user message asks its user's store: neighbours of radius 1, verbatim first."""
    job = SearchJob(D.EMBEDDER)
    found = job.run(D.chat_memories(spark, sf), D.chat_questions(spark, sf))
    return _score6(found.select("query_id", "pos", "id", "content", "score", "created_at"))


@query
def search_degraded(spark, sf):
    """No model at all: verbatim memories, dense scores, no neighbours."""
    job = SearchJob(D.EMBEDDER, SearchSettings(radius=0))
    raws = policies.single_kind(D.chat_memories(spark, sf), "raw")
    return _shown(job.run(raws, D.chat_questions(spark, sf, 10)))


@query
def search_edge_cases(spark, sf):
    """Unknown users and a top_k of zero give nothing; a huge top_k is capped."""
    asked = D.chat_questions(spark, sf)
    n = F.element_at(F.split("query_id", "#"), -1).cast("int")
    varied = asked.withColumn("top_k", F.when(n == 0, 0).when(n == 1, 7).otherwise(10_000)).withColumn(
        "user_id", F.when(n == 3, F.lit("nobody")).otherwise(F.col("user_id")))
    job = SearchJob(D.EMBEDDER, SearchSettings(return_limit=30))
    return job.run(D.chat_memories(spark, sf), varied).groupBy("query_id").agg(F.count("*").alias("items"))


@query
def search_isolation(spark, sf):
    """Results per question, and how many belong to another user."""
    found = D.stored(spark, sf, "isolation", lambda s, f: SearchJob(D.EMBEDDER).run(
        D.chat_memories(s, f), D.chat_questions(s, f)))
    owner = D.chat_memories(spark, sf).select("id", F.col("user_id").alias("owner"))
    asker = D.chat_questions(spark, sf).select("query_id", "user_id")
    return (found.join(owner, "id").join(asker, "query_id").groupBy("user_id")
            .agg(F.count("*").alias("results"), F.count_if(F.col("owner") != F.col("user_id")).alias("foreign")))


@query
def dedupe_results(spark, sf):
    """First offer of each near-duplicate key among the forty best documents."""
    memories = D.document_memories(spark, sf)
    hits = cut_lineage(_document_hits(spark, sf, memories, 40))
    return selection.first_per_key(selection.offers(hits, memories, 0)).select("query_id", "id", "n_chars", "key")


def _document_queries(spark, sf, top_k=20):
    return _embedded(D.document_questions(spark, sf, top_k))


def _document_hits(spark, sf, memories, k):
    return top_hits(memories, _document_queries(spark, sf), k)


@query
def budgeted_results(spark, sf):
    """A character budget that binds: longer documents are passed over."""
    return _shown(_document_search(spark, sf, 20, char_budget=6_000, ordering="relevance"))


@query
def order_raw_first(spark, sf):
    return _shown(_document_search(spark, sf))


@query
def order_fact_first(spark, sf):
    return _shown(_document_search(spark, sf, ordering="fact_first"))


@query
def order_relevance(spark, sf):
    return _shown(_document_search(spark, sf, ordering="relevance"))


@query
def order_sandwich(spark, sf):
    return _shown(_document_search(spark, sf, ordering="sandwich"))


@query
def random_control(spark, sf):
    return _shown(_document_search(spark, sf, ordering="random"))


@query
def single_kind_search(spark, sf):
    """The same questions to verbatim memories only and to facts only."""
    memories, asked = D.document_memories(spark, sf), _document_queries(spark, sf)
    arms = [top_hits(policies.single_kind(memories, kind), asked, 10).withColumn("arm", F.lit(kind))
            for kind in ("raw", "fact")]
    return _score6(arms[0].unionByName(arms[1]).select("arm", "query_id", "id", "score", "p"))


@query
def diversity_cap(spark, sf):
    found = policies.diverse_hits(D.vector_memories(spark, sf), D.vector_questions(spark, sf), 20)
    return _score6(found.select("query_id", "id", "score", "p"))


def _parents(spark, sf):
    """Chunks of four messages behind the twenty best memories of each question."""
    memories = D.chat_memories(spark, sf)
    asked = _embedded(D.chat_questions(spark, sf))
    # Written once: read for the digests, then for the texts.
    transcripts = cut_lineage(ingest.chunk_transcripts(D.requests(spark, sf)).select("digest", "transcript"))
    # Blocks of many questions: a user's memories are sent once per block.
    return policies.parent_chunks(top_hits(memories, asked, 20, query_block=16_384), transcripts)


@query
def parent_chunks(spark, sf):
    return _parents(spark, sf).select("query_id", "pos", "digest", "content")


@query
def parent_chunks_budget(spark, sf):
    return policies.within_budget(_parents(spark, sf), 3_000).select("query_id", "pos", "digest")


@query
def response_footprint(spark, sf):
    found = _document_search(spark, sf)
    sizes = policies.footprint(found)
    return sizes.select("query_id", "items", "chars", "chunks", F.round("kilotokens", 6).alias("kilotokens"))


@query
def footprint_summary(spark, sf):
    sizes = policies.footprint(_document_search(spark, sf))
    accuracy = evaluation.judge_summary(D.judged(spark, sf)).where(F.col("prefix") == 100)
    return policies.footprint_summary(sizes, accuracy).select(
        *[F.round(c, 6).alias(c) for c in ("items", "chars", "kilotokens", "chunks", "accuracy", "accuracy_per_kilotoken")])


# --- second round -----------------------------------------------------------------------

@query
def reflection_inputs(spark, sf):
    """What the reflection model sees, and whether its reply reopens the search."""
    found = D.retrieval(spark, sf).select(F.col("question_id").alias("query_id"), "pos", "content")
    asked = D.eval_questions(spark, sf).select(
        F.col("question_id").alias("query_id"), F.col("question").alias("query"),
        F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("yes"), F.lit("no"))).alias("options"), "vec_id")
    prompts = rounds.reflection_inputs(asked, found)
    reply = F.when(F.col("vec_id") % 3 == 0, '{"status": "COMPLETE"}').when(
        F.col("vec_id") % 3 == 1, F.concat(F.lit('Sure: {"status": "INCOMPLETE", "question": "Did I say '),
                                          D.text("vec_id"), F.lit('?"}'))).otherwise("no idea")
    return prompts.select("query_id", "prompt", R.follow_up_question(R.strip_reasoning(reply)).alias("follow_up"))


@query
def second_round(spark, sf):
    """Benchmark passages ask the documents; a model asks again for some of them, and both rounds are merged."""
    job = SearchJob(D.EMBEDDER, SearchSettings(radius=0, ordering="relevance", second_round=True), reflector=callers.reflector)
    return _shown(job.run(D.document_memories(spark, sf), D.document_questions(spark, sf, 10)))


@query
def merge_rounds(spark, sf):
    """First the dense ranking, then the lexical one, merged under a budget."""
    memories, asked = D.document_memories(spark, sf), D.document_questions(spark, sf, 15)
    body = memories.select("id", "kind", "content", "created_at")
    first = _document_hits(spark, sf, memories, 15)
    second = lexical.bm25_hits(memories, asked, 15).withColumn("score", F.col("score") / 100)
    parts = [h.join(body, "id").withColumn("pos", F.col("p") - 1).select(
        "query_id", "pos", "id", "kind", "content", "score", "created_at") for h in (first, second)]
    merged = rounds.merge_rounds(parts[0], parts[1], asked, budget=20_000)
    return _score6(merged.select("query_id", "pos", "id", "score"))


# --- lexical channel -----------------------------------------------------------------------

@query
def bm25_scores(spark, sf):
    """Out of the stored postings."""
    hits = D.document_index(spark, sf).hits(D.document_questions(spark, sf), 20)
    return _score6(hits.select("query_id", "id", "score", "p"))


@query
def bm25_scan(spark, sf):
    """The same without an index."""
    hits = lexical.bm25_hits(D.document_memories(spark, sf), D.document_questions(spark, sf), 20)
    return _score6(hits.select("query_id", "id", "score", "p"))


def _fused(spark, sf, weight, kind=None):
    memories, asked = D.document_memories(spark, sf), D.document_questions(spark, sf)
    searched = policies.single_kind(memories, kind) if kind else memories
    dense = _document_hits(spark, sf, memories, S.RRF_CANDIDATES)
    return _score6(lexical.fuse(dense, lexical.bm25_hits(searched, asked), 20, weight).select(
        "query_id", "id", "score", "p"))


@query
def rrf_fusion(spark, sf):
    return _fused(spark, sf, 1.0)


@query
def rrf_fusion_weighted(spark, sf):
    return _fused(spark, sf, 2.0)


@query
def rrf_fusion_raw_only(spark, sf):
    return _fused(spark, sf, 0.5, "raw")


# --- evaluation -----------------------------------------------------------------------------

@query
def corpus_turns(spark, sf):
    return corpus_source.corpus_turns(D.corpus(spark, sf))


@query
def corpus_requests(spark, sf):
    made = corpus_source.corpus_requests(D.corpus(spark, sf), "t", 3)
    return made.select("request_id", "user_id", "session_id", F.posexplode("messages").alias("position", "m")).select(
        "request_id", "user_id", "session_id", "position", "m.role", "m.content", "m.timestamp")


@query
def chunk_map(spark, sf):
    return corpus_source.chunk_map(corpus_source.corpus_chunks(D.corpus(spark, sf), "t", 3))


@query
def eval_questions(spark, sf):
    asked = corpus_source.corpus_questions(D.corpus(spark, sf))
    return asked.select("question_id", "conv", "question", "gold_answer", "category",
                        F.array_join("evidence", ",").alias("evidence"))


@query
def result_provenance(spark, sf):
    return evaluation.result_provenance(D.retrieval(spark, sf), D.eval_chunk_map(spark, sf))


@query
def join_guard(spark, sf):
    ranked, chunks = D.retrieval(spark, sf), D.eval_chunk_map(spark, sf)
    evaluation.check_join(ranked, chunks)
    return evaluation.matching_digests(ranked, chunks).agg(F.count("*").alias("matching"))


def _found(spark, sf):
    asked = D.eval_questions(spark, sf)
    return evaluation.first_hits(asked, evaluation.evidence_hits(
        D.retrieval(spark, sf), asked, D.eval_chunk_map(spark, sf)))


@query
def recall_at_k(spark, sf):
    return evaluation.recall_at_k(_found(spark, sf)).withColumn("recall", F.round("recall", 6))


@query
def recall_by_kind(spark, sf):
    return evaluation.recall_by_kind(D.retrieval(spark, sf), D.eval_questions(spark, sf), D.eval_chunk_map(
        spark, sf)).withColumn("recall", F.round("recall", 6))


@query
def recall_by_category(spark, sf):
    return evaluation.recall_by_category(_found(spark, sf)).withColumn("recall", F.round("recall", 6))


def _sweep(spark, sf):
    """The sweep over the stored tables of the run ``base``."""
    return D.results(spark, sf).sweep(spark, "base", D.eval_questions(spark, sf))


@query
def judged_prefixes(spark, sf):
    """Prefixes as the folders of the judged answers name them, in numerical order, and their rows."""
    results = D.results(spark, sf)
    rows = results.read(spark, "judged", "base").groupBy("prefix").agg(F.count("*").alias("rows"))
    return results.prefixes(spark, "base").join(rows, "prefix")


@query
def store_tag_recall(spark, sf):
    """Recall of a run that searched the memories of another run and is scored by that run's chunk map."""
    found = D.results(spark, sf).found(spark, "late", D.eval_questions(spark, sf), "base")
    return evaluation.recall_at_k(found).withColumn("recall", F.round("recall", 6))


@query
def answer_sweep(spark, sf):
    return evaluation.rounded_sweep(_sweep(spark, sf), 6)


@query
def best_prefix(spark, sf):
    return evaluation.best_prefix(_sweep(spark, sf))


@query
def paired_flips(spark, sf):
    judged = D.judged(spark, sf)
    return evaluation.paired_flips(judged, evaluation.best_prefix(_sweep(spark, sf)))


@query
def judge_summary(spark, sf):
    """Judge replies longer than what is kept, labels from the stored judgements."""
    rows = D.judged(spark, sf).withColumn("reply", F.repeat(F.concat("question_id", F.lit(" is ")), 100)).withColumn(
        "status", F.when(F.col("label").isNull(), "failed").otherwise("ok"))
    read = evaluation.judged_rows(rows, F.col("label"))
    longest = read.groupBy("prefix").agg(F.max(F.length("judge_raw")).alias("longest_raw"))
    return evaluation.judge_summary(read).join(longest, "prefix").withColumn("accuracy", F.round("accuracy", 6))


@query
def judge_with_caller(spark, sf):
    """A judge model on one answer per question; calls that fail or evade are missing labels."""
    number = F.col("vec_id")
    answers = D.eval_questions(spark, sf).withColumn("gold_answer", F.concat(F.lit("answer "), (number - number % 3).cast("string"))).withColumn(
        "generated_answer", F.concat(F.lit("answer "), D.text("vec_id")))
    judged = judge(answers, ModelStage(callers.judger, in_flight=4))
    return judged.select("question_id", "label", "judge_raw")


@query
def answer_inputs(spark, sf):
    return evaluation.answer_inputs(D.retrieval(spark, sf), D.eval_questions(spark, sf), 5).select(
        "question_id", "question", "context")


def _previous_answers(spark, sf):
    """Answers of an interrupted run: none, a blank one or a real one."""
    asked = D.eval_questions(spark, sf)
    given = (F.when(F.col("vec_id") % 3 == 0, " \n")
             .when(F.col("vec_id") % 5 != 0, F.concat(F.lit("answer "), D.text("vec_id"))))
    return asked.select("question_id", given.alias("generated_answer"))


@query
def resume_answers(spark, sf):
    state = evaluation.answer_state(D.eval_questions(spark, sf), _previous_answers(spark, sf))
    todo = evaluation.unanswered(D.eval_questions(spark, sf), _previous_answers(spark, sf)).select(
        "question_id", F.lit(True).alias("todo"))
    return state.join(todo, "question_id", "left").select(
        "question_id", "generated_answer", "gap", F.coalesce("todo", F.lit(False)).alias("todo"))


# --- replicates -------------------------------------------------------------------------------

def _arm(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("arm") == name)


@query
def run_spread(spark, sf):
    spread = replicates.run_spread(D.replicates(spark, sf))
    return spread.select("arm", "runs", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "worst", "best")])


@query
def paired_sign_test(spark, sf):
    """First run of each arm, question by question, overall and per category."""
    runs = D.replicates(spark, sf).where("run = 1")
    control, hybrid = _arm(runs, "control"), _arm(runs, "hybrid")
    overall = replicates.arm_flips(control, hybrid).withColumn("category", F.lit(0).cast("bigint"))
    each = replicates.arm_flips(control, hybrid, ["category"])
    tested = replicates.sign_test(overall.unionByName(each.select(overall.columns)))
    return tested.select("category", "fixes", "breaks", "n", "net", F.round("p_value", 6).alias("p_value"))


@query
def replicate_majority(spark, sf):
    """Flips of the majority label: all questions, and those that are stable in both arms."""
    voted = replicates.majority(D.replicates(spark, sf))
    stable = voted.join(replicates.stable_questions(voted), "question_id", "left_semi")
    parts = []
    for name, rows in (("all", voted), ("stable", stable), ("no category 2", voted.where("category != 2"))):
        flips = replicates.arm_flips(_arm(rows, "control"), _arm(rows, "hybrid"))
        parts.append(flips.withColumn("subset", F.lit(name)))
    flips = parts[0].unionByName(parts[1]).unionByName(parts[2])
    tested = replicates.sign_test(flips)
    return tested.select("subset", "fixes", "breaks", "n", "net", F.round("p_value", 6).alias("p_value"))
