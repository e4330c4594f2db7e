"""Add requests to memory rows.

A request row carries its whole message array, so everything that looks at the
messages of one chunk (transcript, date prefix, first stamp) is a higher-order
function on that row, and memories come out of two explodes: no shuffle until
``seq`` is assigned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnstore import settings as S
from turnstore.functions import replies as R, text as X
from turnstore.operators.models import Caller, ModelStage, call_model
from turnstore.runtime import running_total, small_side

ITEM_COLUMNS = ["id", "user_id", "session_id", "request_id", "kind", "parent_id", "content", "created_at"]


def numbered_messages() -> Column:
    """Non-blank messages with the position they had in the request."""
    placed = F.transform("messages", lambda m, i: F.struct(
        i.alias("position"), m["role"].alias("role"),
        X.strip(F.coalesce(m["content"], F.lit(""))).alias("content"), m["timestamp"].alias("timestamp")))
    return F.filter(placed, lambda m: m["content"] != "")


def prepared(requests: DataFrame) -> DataFrame:
    """Requests with digest, non-blank turns, transcript and chunk prefix."""
    stamped = F.filter("messages", lambda m: m["timestamp"].isNotNull())
    line = lambda m: F.concat(
        X.stamp_prefix(m["timestamp"]), F.coalesce(m["role"], F.lit("")), F.lit(": "), m["content"])
    return (requests
            .withColumn("digest", X.digest(F.col("user_id"), F.col("request_id")))
            .withColumn("turns", numbered_messages())
            # The prefix is that of the first stamped message, blank or not.
            .withColumn("chunk_prefix", X.stamp_prefix(F.try_element_at(stamped, F.lit(1))["timestamp"]))
            .withColumn("transcript", F.array_join(F.transform("turns", line), "\n")))


def chunk_transcripts(requests: DataFrame) -> DataFrame:
    """The text handed to the extraction model, one row per request with text."""
    return (prepared(requests).where(F.size("turns") > 0)
            .select("request_id", "user_id", "digest", "chunk_prefix", "transcript"))


def extracted(requests: DataFrame, caller: Caller | ModelStage | None, max_calls: int | None = None,
              max_facts: int | None = S.MAX_FACTS) -> DataFrame:
    """Add the model's reply, its status and the facts read from it to each request with text.

    *requests* come from :func:`prepared`. Requests without text have nothing to say and
    are left out.
    """
    spoken = requests.where(F.size("turns") > 0)
    called = call_model(spoken, caller, "transcript", max_calls)
    return with_facts(called, max_facts)


def with_facts(replied: DataFrame, max_facts: int | None = S.MAX_FACTS) -> DataFrame:
    """Read ``facts`` (at most *max_facts*, None: all) and the final ``status`` (off, failed, empty or ok) from ``reply``."""
    read = R.add_facts(replied, max_facts=max_facts)
    off = F.col("status") == "off"
    return read.withColumn("status", F.when(off, "off").otherwise(F.col("_outcome"))).drop("_outcome")


def _turn_items() -> Column:
    return F.transform("turns", lambda m: F.struct(
        F.lit("raw").alias("kind"), m["position"].alias("position"), m["role"].alias("role"),
        m["content"].alias("text"), m["timestamp"].alias("timestamp")))


def _fact_items() -> Column:
    """Facts carry the timestamp of the first turn with text, whatever it is."""
    first = F.try_element_at("turns", F.lit(1))["timestamp"]
    return F.transform("facts", lambda f, i: F.struct(
        F.lit("fact").alias("kind"), i.alias("position"), F.lit(None).cast("string").alias("role"),
        f.alias("text"), first.alias("timestamp")))


def _memories(requests: DataFrame, items: Column) -> DataFrame:
    """Explode *items* into rows shaped like a memory without vector.

    ``ordinal`` counts a request's items; ``base`` is passed on once it is assigned.
    """
    passed = [c for c in ("user_id", "session_id", "request_id", "base") if c in requests.columns]
    rows = requests.select("digest", "chunk_prefix", *passed, F.posexplode(items).alias("ordinal", "item"))
    item = {name: F.col(f"item.{name}") for name in ("kind", "position", "role", "text", "timestamp")}
    turn = F.concat(X.stamp_prefix(item["timestamp"]), X.speaker(item["role"]), F.lit(": "), item["text"])
    fact = F.when(item["text"].startswith("["), item["text"]).otherwise(F.concat("chunk_prefix", item["text"]))
    return rows.select(
        X.memory_id(F.col("digest"), item["kind"], item["position"]).alias("id"), *passed, "item.kind",
        F.lit(None).cast("string").alias("parent_id"),
        F.when(item["kind"] == "raw", turn).otherwise(fact).alias("content"),
        X.created_at(item["timestamp"]).alias("created_at"), "item.position", "ordinal")


def raw_memories(requests: DataFrame) -> DataFrame:
    """One verbatim memory per non-blank message of :func:`prepared` requests."""
    return _memories(requests, _turn_items())


def fact_memories(requests: DataFrame) -> DataFrame:
    """One memory per extracted fact; dated like the chunk, stamped like its first turn."""
    return _memories(requests, _fact_items())


def build_memories(requests: DataFrame) -> DataFrame:
    """Verbatim memories, then facts, of :func:`with_facts` requests, in one explode."""
    return _memories(requests, F.concat(_turn_items(), _fact_items()))


def first_arrivals(requests: DataFrame) -> DataFrame:
    """One row per (request_id, user_id): the earliest attempt of this batch."""
    attempts = W.partitionBy("request_id", "user_id").orderBy("arrival", F.xxhash64("messages"))
    return requests.withColumn("_n", F.row_number().over(attempts)).where("_n = 1").drop("_n")


def first_keys(requests: DataFrame, row: str) -> DataFrame:
    """(request_id, user_id, *row*) of what :func:`first_arrivals` keeps; only keys and a hash of the messages are shuffled."""
    keys = requests.select("request_id", "user_id", "arrival", F.xxhash64("messages").alias("_hash"), row)
    attempts = W.partitionBy("request_id", "user_id").orderBy("arrival", "_hash", row)
    return keys.withColumn("_n", F.row_number().over(attempts)).where("_n = 1").select("request_id", "user_id", row)


def unseen(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requests whose (request_id, user_id) is not in the ledger yet, once each.

    The ledger is cut down to the batch's keys first: for a batch of ordinary size
    that is a map-side filter, and the ledger is not shuffled.
    """
    key = ["request_id", "user_id"]
    seen = ledger.select(*key).join(small_side(requests.select(*key)), key, "left_semi")
    return first_arrivals(requests).join(seen, key, "left_anti")


def new_ledger(requests: DataFrame) -> DataFrame:
    """Ledger rows of the requests that store something."""
    n_items = (F.size("turns") + F.size("facts")).cast("bigint")
    return (requests.select("request_id", "user_id", n_items.alias("n_items"))
            .where("n_items > 0"))


def assign_bases(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``base``: how many memories the user has before this request.

    Works on one row per request: the stored count comes from the ledger, the
    batch's own from a running total that splits hot users.
    """
    sized = requests.withColumn("n_items", (F.size("turns") + F.size("facts")).cast("bigint"))
    users = sized.select("user_id").distinct()
    stored = (ledger.join(small_side(users), "user_id", "left_semi")
              .groupBy("user_id").agg(F.sum("n_items").alias("start")))
    return running_total(sized, ["user_id"], ["arrival", "request_id"], "n_items", "base", stored)


def with_bases(requests: DataFrame, start: DataFrame, pieces: int = 64) -> DataFrame:
    """Add ``base`` to requests that are stored somewhere; *start* (user_id, ``start``) is what users have already.

    Only keys and sizes are sorted and shuffled; the requests meet their base in one join.
    """
    n_items = (F.size("turns") + F.size("facts")).cast("bigint")
    sized = requests.select("user_id", "request_id", "arrival", n_items.alias("n_items"))
    bases = running_total(sized, ["user_id"], ["arrival", "request_id"], "n_items", "base", start, pieces)
    return requests.join(small_side(bases.select("user_id", "request_id", "base")), ["user_id", "request_id"])


def sequenced(requests: DataFrame) -> DataFrame:
    """Memories with ``seq``: verbatim rows by position, then facts, after ``base``."""
    items = build_memories(requests)
    return items.withColumn("seq", (F.col("base") + F.col("ordinal")).cast("bigint")).select(*ITEM_COLUMNS, "seq")


def with_keys(memories: DataFrame) -> DataFrame:
    """Add what a search compares, so that it need not read every text: key and length."""
    return (memories.withColumn("dedupe_key", X.dedupe_key(F.col("content")))
            .withColumn("n_chars", F.length("content")))


def ingest_report(requests: DataFrame) -> DataFrame:
    """Messages per request and requests per user."""
    return requests.groupBy("user_id").agg(
        F.count("*").alias("chunks"), F.sum(F.size("messages")).cast("bigint").alias("messages"),
        F.max(F.size("messages")).alias("largest_chunk"))
