"""Inputs of the library, derived from the driver's tables.

``conversations``  messages, Add requests, a corpus in nested JSON
``documents``      a text store with copies; ``benchmark`` asks it questions
``embeddings``     a vector store; every vector asks its own label's store
``events``         a stream of Add requests
``labels``         judged answers

Stores that a real deployment keeps as tables are written once per session and
data folder and read back from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnstore import settings as S
from turnstore.functions import text as X
from turnstore.functions.vectors import hashed_embedder
from turnstore.operators import ingest
from turnstore.operators.postings import LexicalIndex
from turnstore.operators.scoring import top_hits
from turnstore.plans.add import with_vectors
from turnstore.runtime import cut_lineage, prepare, scratch_path
from turnstore.schemas import MEMORY
from turnstore.sources import tables
from turnstore.sources.requests import requests_from_messages
from turnstore.sources.results import Results
from turnstore.sources.store import Store

EMBEDDER = hashed_embedder(64)
_stored: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """The table *name*, written on first use."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        # The driver's small files are one split each: spread the rows, as the many
        # files of a real table are.
        rows = build(spark, sf)
        rows = rows.repartition(spark.sparkContext.defaultParallelism, rows.columns[0])
        rows.write.mode("overwrite").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def text(column: str) -> Column:
    return F.col(column).cast("string")


def store(spark: SparkSession, sf: str, name: str, build, merged: bool = True) -> DataFrame:
    """The memories of a store that was written in two batches on first use.

    A store that is not *merged* is read as its two attempts, which saves a shuffle and a copy of
    every text.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        rows = cut_lineage(build(spark, sf))
        missing = [f for f in MEMORY if f.name not in rows.columns]
        rows = rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
        made = Store(path, fan_in=0, flat_items=0)
        for batch in range(2):
            part = rows.where(F.pmod(F.xxhash64("request_id"), F.lit(2)) == batch)
            made.append(batch, part, part.groupBy("request_id", "user_id").agg(F.count("*").alias("n_items")))
        if merged:
            made.merge(spark)
        _stored[key] = path
    return tables.read_memories(spark, _stored[key])


# --- conversations ---------------------------------------------------------------

def messages(spark: SparkSession, sf: str) -> DataFrame:
    chunk = F.expr("turn div 4")
    conv = F.concat(F.lit("conv-"), text("conv_id"))
    return table(spark, sf, "conversations").select(
        F.concat(conv, F.lit(":chunk-"), chunk.cast("string")).alias("request_id"),
        F.concat(F.lit("u"), (F.col("conv_id") % 20).cast("string")).alias("user_id"),
        conv.alias("session_id"), (F.col("turn") % 4).alias("position"), "role",
        F.col("text").alias("content"),
        (1_700_000_000_000 + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000).alias("timestamp"),
        (F.col("conv_id") * 100 + chunk).alias("arrival"), "conv_id")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return requests_from_messages(messages(spark, sf))


def replied(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared requests with a reply in every shape a model may answer in.

    The shape depends on the conversation: JSON, bullets after prose, a numbered
    list, an unfinished reasoning block, or a failed call.
    """
    shape = F.regexp_extract("session_id", "([0-9]+)$", 1).cast("bigint") % 5
    said = F.flatten(F.transform("turns", lambda m: X.lines(m["content"])))
    said = F.filter(F.transform(said, X.strip), lambda line: line != "")
    numbered = F.transform(said, lambda line, i: F.concat((i + 1).cast("string"), F.lit(") "), line))
    reply = (F.when(shape == 0, F.concat(F.lit("<think>list them</think>\n"),
                                         F.to_json(F.struct(said.alias("facts")))))
             .when(shape == 1, F.concat(F.lit("Here is what I found:\n- "), F.array_join(said, "\n- ")))
             .when(shape == 2, F.array_join(numbered, "\r\n"))
             .when(shape == 3, F.concat(F.lit("<think>still thinking about "), F.element_at(said, 1))))
    return (ingest.prepared(requests(spark, sf)).withColumn("reply", reply)
            .withColumn("status", F.when(reply.isNull(), "failed").otherwise("ok")))


def no_ledger(spark: SparkSession) -> DataFrame:
    return tables.read_ledger(spark, scratch_path(spark, "none"))


def chat_items(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and fact memories with ``seq``, no vectors."""
    return ingest.sequenced(ingest.assign_bases(ingest.with_facts(replied(spark, sf)), no_ledger(spark)))


def chat_memories(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf, "chat", lambda s, f: with_vectors(ingest.with_keys(chat_items(s, f)), EMBEDDER))


def chat_questions(spark: SparkSession, sf: str, top_k: int = 20) -> DataFrame:
    """Every message of a user is a question to that user's store."""
    asked = messages(spark, sf).where("role = 'user'")
    return asked.select(
        F.concat("request_id", F.lit("#"), text("position")).alias("query_id"), F.col("content").alias("query"),
        "user_id", F.lit(top_k).alias("top_k"), F.split("content", r"\n").alias("options"))


# --- documents --------------------------------------------------------------------

def document_items(spark: SparkSession, sf: str) -> DataFrame:
    chunk = F.expr("doc_id div 20")
    user = F.concat(F.lit("d"), (chunk % 20).cast("string"))
    kind = F.when(F.col("doc_id") % 4 == 3, "fact").otherwise("raw")
    request = F.concat(F.lit("docs-"), chunk.cast("string"))
    return table(spark, sf, "documents").select(
        X.memory_id(X.digest(user, request), kind, F.col("doc_id") % 20).alias("id"),
        user.alias("user_id"), request.alias("request_id"), kind.alias("kind"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("created_at"), F.col("doc_id").alias("seq"))


def document_memories(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf, "documents", lambda s, f: with_vectors(
        ingest.with_keys(document_items(s, f)), EMBEDDER), merged=False)


def document_questions(spark: SparkSession, sf: str, top_k: int = 20) -> DataFrame:
    """Every benchmark passage asks one user's documents."""
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), text("item_id")).alias("query_id"), F.col("text").alias("query"),
        F.concat(F.lit("d"), (F.col("item_id") % 20).cast("string")).alias("user_id"),
        F.lit(top_k).alias("top_k"), F.lit(None).cast("array<string>").alias("options"))


def document_index(spark: SparkSession, sf: str) -> LexicalIndex:
    """The stored postings of the documents, added in two parts."""
    key = (spark.sparkContext.applicationId, sf, "postings")
    if key not in _stored:
        made = LexicalIndex(scratch_path(spark, "postings"))
        items = document_items(spark, sf).select("user_id", "id", "seq", "content")
        for part in range(2):
            made.add(items.where(F.col("seq") % 2 == part))
        _stored[key] = made.root
    return LexicalIndex(_stored[key])


# --- embeddings -------------------------------------------------------------------

def vector_memories(spark: SparkSession, sf: str) -> DataFrame:
    user = F.concat(F.lit("u"), text("label"))
    chunk = F.concat(F.lit("chunk-"), F.expr("vec_id div 20").cast("string"))
    kind = F.when(F.col("vec_id") % 4 == 3, "fact").otherwise("raw")
    return table(spark, sf, "embeddings").select(
        X.memory_id(X.digest(user, chunk), kind, F.col("vec_id") % 20).alias("id"), user.alias("user_id"),
        kind.alias("kind"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vec"), "vec_id",
        F.concat(F.lit("memory "), text("vec_id")).alias("content"),
        F.lit(None).cast("string").alias("created_at"))


def vector_questions(spark: SparkSession, sf: str, top_k: int = 10) -> DataFrame:
    """Every vector is a question to its own label's store."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("q"), text("vec_id")).alias("query_id"), F.concat(F.lit("u"), text("label")).alias("user_id"),
        F.col("embedding").alias("qvec"), "vec_id", "label", F.lit(top_k).alias("top_k"))


def eval_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence: two later vectors; every seventh question has none."""
    later = F.array(*[F.concat(F.lit("v"), (F.col("vec_id") + n).cast("string")) for n in (1, 10)])
    none = F.array().cast("array<string>")
    return vector_questions(spark, sf).select(
        F.col("query_id").alias("question_id"), F.col("label").alias("category"),
        F.col("label").alias("conv"),
        F.concat(F.lit("Which one is "), text("vec_id"), F.lit("?")).alias("question"), "vec_id",
        F.when(F.col("vec_id") % 7 == 0, none).otherwise(later).alias("evidence"))


def eval_chunk_map(spark: SparkSession, sf: str) -> DataFrame:
    memories = vector_memories(spark, sf)
    return memories.select(
        X.id_digest(F.col("id")).alias("digest"), (F.col("vec_id") % 20).cast("int").alias("position"),
        F.concat(F.lit("v"), text("vec_id")).alias("dia_id"), F.substring("user_id", 2, 20).cast("int").alias("conv"))


def retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The stored ranking of every question: its best hundred memories."""

    def build(s: SparkSession, f: str) -> DataFrame:
        memories = vector_memories(s, f)
        hits = top_hits(memories, vector_questions(s, f), S.RETURN_LIMIT)
        content = memories.select("id", "content")
        return hits.join(content, "id").select(
            F.col("query_id").alias("question_id"), (F.col("p") - 1).alias("pos"), "id", "content", "score", "seq")

    return stored(spark, sf, "retrieval", build)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """A label per question and prefix; unlabelled documents are failed judge calls."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    rows = eval_questions(spark, sf).join(labels, "vec_id", "left").withColumn(
        "prefix", F.explode(F.array(*[F.lit(k) for k in S.RECALL_CUTOFFS])))
    good = (F.col("quality") == 1) & (F.col("prefix") >= F.col("vec_id") % 60)
    label = F.when(F.col("quality").isNull(), None).when(good, S.CORRECT).otherwise("WRONG")
    return rows.select("prefix", "question_id", "category", label.alias("label"))


def results(spark: SparkSession, sf: str) -> Results:
    """Stored tables of two runs: ``base``, and ``late``, which lacks the first two memories of every ranking.

    ``late`` searched the memories of ``base``; a chunk map of its own would lead elsewhere.
    """
    key = (spark.sparkContext.applicationId, sf, "results")
    if key not in _stored:
        made = Results(scratch_path(spark, "results"))
        ranked, chunks = retrieval(spark, sf), eval_chunk_map(spark, sf)
        made.write("retrieval", ranked, "base")
        made.write("retrieval", ranked.where("pos >= 2").withColumn("pos", F.col("pos") - 2), "late")
        made.write("chunks", chunks, "base")
        made.write("chunks", chunks.withColumn("dia_id", F.lit("elsewhere")), "late")
        made.write("judged", judged(spark, sf), "base")
        _stored[key] = made.root
    return Results(_stored[key])


def replicates(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms, three runs each, over every labelled document."""
    runs = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(n).alias("arm_no"), F.lit(r).alias("run"))
                     for n, a in enumerate(("control", "hybrid")) for r in (1, 2, 3)])
    noisy = (F.col("doc_id") * 7 + F.col("run") * 3 + F.col("arm_no") * 5) % 11 == 0
    return table(spark, sf, "labels").select("doc_id", "quality", F.inline(runs)).select(
        "arm", "run", F.concat(F.lit("q"), text("doc_id")).alias("question_id"),
        (F.col("doc_id") % 4 + 1).alias("category"), ((F.col("quality") == 1) != noisy).alias("right"))


# --- corpus ------------------------------------------------------------------------

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as nested JSON samples: sessions of four turns, dated, with questions."""
    said = table(spark, sf, "conversations")
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    dia = F.concat(F.lit("D"), F.expr("turn div 4 + 1").cast("string"), F.lit(":"), (F.col("turn") % 4).cast("string"))
    turn = F.to_json(F.struct(F.col("role").alias("speaker"), dia.alias("dia_id"), "text"))
    answer = F.when(F.col("turn") % 6 != 5, F.concat(F.lit(',"answer":"a'), text("turn"), F.lit('"'))).otherwise("")
    qa = F.concat(F.lit('{"question":'), quoted(F.col("text")), answer,
                  F.lit(',"category":'), (F.col("turn") % 5 + 1).cast("string"),
                  F.lit(',"evidence":['), quoted(dia), F.lit(","), text("turn"), F.lit("]}"))
    entries = said.select("conv_id", F.expr("turn div 4 + 1").alias("session"), "turn",
                          turn.alias("turn_json"), qa.alias("qa_json"))
    in_order = lambda name: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", name))), lambda e: e[name]), ",")
    sessions = entries.groupBy("conv_id", "session").agg(
        in_order("turn_json").alias("turns"), in_order("qa_json").alias("qa"))
    key = F.concat(F.lit('"session_'), text("session"))
    # The second session's date is in the short form, the third has none.
    date = F.when(F.col("session") == 1, "1:56 pm on 8 May, 2023").when(F.col("session") == 2, "10:05 AM on 21 Sep, 2023")
    dated = F.coalesce(F.concat(F.lit(","), key, F.lit('_date_time":"'), date, F.lit('"')), F.lit(""))
    part = F.concat(key, F.lit('":['), F.col("turns"), F.lit("]"), dated)
    joined = lambda name: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("session", name))), lambda e: e[name]), ",")
    samples = sessions.withColumn("part", part).groupBy("conv_id").agg(joined("part").alias("parts"), joined("qa").alias("qa"))
    conversation = F.concat(F.lit('{"speaker_a":"user","speaker_b":"assistant","session_x":"no list",'),
                            F.col("parts"), F.lit("}"))
    return samples.select(F.col("conv_id").cast("int").alias("sample"), conversation.alias("conversation"),
                          F.concat(F.lit("["), F.col("qa"), F.lit("]")).alias("qa"))


# --- events ------------------------------------------------------------------------

def event_requests(events: DataFrame) -> DataFrame:
    """Every event is an Add request with one message."""
    message = F.struct(F.col("event_type").alias("role"), F.col("props").alias("content"),
                       F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    return events.select(
        text("event_id").alias("request_id"), F.concat(F.lit("u"), text("user_id")).alias("user_id"),
        F.concat(F.lit("s"), text("user_id")).alias("session_id"), F.array(message).alias("messages"),
        F.col("event_id").alias("arrival"))
