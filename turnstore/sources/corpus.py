"""Conversation corpora: nested JSON with one dynamic key per session.

The corpus is read as one row per sample (``sample, conversation string, qa
string``, the latter two JSON texts), so samples spread over tasks and every step
below is a narrow, per-row expression: a sample is expanded to session, chunk and
turn rows without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from turnstore import settings as S
from turnstore.functions import text as X
from turnstore.schemas import CORPUS_QA, CORPUS_TURN

# The key and date formats of the corpus.
SESSION_KEY = r"^session_([0-9]+)$"
SESSION_DATE_FORMATS = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMM, yyyy")


_SAMPLE = "conversation string, qa string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a file that holds one JSON array, numbered by their place in it.

    One array is one split to any reader: it is streamed by one task. Store large
    corpora one sample per line and use :func:`read_corpus_lines`.
    """
    samples = spark.read.schema(_SAMPLE).option("multiLine", True).json(path)
    return samples.select(F.monotonically_increasing_id().alias("sample"), "conversation", "qa")


def read_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Samples stored one per line, with their number in ``sample``."""
    return spark.read.schema("sample bigint, " + _SAMPLE).json(path)


def session_millis(text: Column) -> Column:
    """Start of a session from its written date, or a fixed default."""
    # The zone is written out, so the session's own does not matter.
    zoned = F.concat(X.strip(text), F.lit(" +0000"))
    parsed = [F.unix_millis(F.try_to_timestamp(zoned, F.lit(f"{f} xx"))) for f in SESSION_DATE_FORMATS]
    return F.coalesce(*parsed, F.lit(S.CORPUS_DEFAULT_MILLIS))


def _sessions(corpus: DataFrame) -> DataFrame:
    """One row per session that holds a list of turns."""
    conversation = F.from_json("conversation", "map<string,string>")
    keyed = (corpus.select("sample", conversation.alias("conversation"))
             .select("sample", "conversation", F.explode("conversation").alias("key", "value"))
             .where(F.col("key").rlike(SESSION_KEY) & F.col("value").startswith("[")))
    number = F.regexp_extract("key", SESSION_KEY, 1).cast("int")
    date = F.col("conversation")[F.concat(F.col("key"), F.lit("_date_time"))]
    turns = F.from_json("value", T.ArrayType(CORPUS_TURN))
    return keyed.select(
        F.col("sample").alias("conv"), number.alias("session"),
        F.col("conversation")["speaker_a"].alias("speaker_a"),
        session_millis(date).alias("base"), turns.alias("turns")).where("turns is not null")


def corpus_turns(corpus: DataFrame) -> DataFrame:
    """Every turn: conv, session, pos, dia_id, speaker, text."""
    return (_sessions(corpus)
            .select("conv", "session", F.posexplode("turns").alias("pos", "turn"))
            .select("conv", "session", "pos", "turn.dia_id", "turn.speaker", "turn.text"))


def corpus_chunks(corpus: DataFrame, tag: str, chunk_turns: int = S.CORPUS_CHUNK_TURNS) -> DataFrame:
    """Add requests of at most *chunk_turns* turns, with the turn id of each message.

    Blank turns are left out before positions are given, their time slot is kept;
    chunks without text vanish.
    """
    size = F.size("turns")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(chunk_turns)))
    blocks = _sessions(corpus).withColumn("offset", F.explode(starts))
    stamped = F.transform(
        F.slice("turns", F.col("offset") + 1, chunk_turns),
        lambda t, i: F.struct(
            F.when(t["speaker"].eqNullSafe(F.col("speaker_a")), "user").otherwise("assistant").alias("role"),
            X.strip(F.coalesce(t["text"], F.lit(""))).alias("content"),
            (F.col("base") + (F.col("offset") + i) * S.CORPUS_TURN_MILLIS).alias("timestamp"),
            F.coalesce(t["dia_id"], F.lit("")).alias("dia_id")))
    kept = blocks.withColumn("spoken", F.filter(stamped, lambda m: m["content"] != "")).where(F.size("spoken") > 0)
    conv = F.col("conv").cast("string")
    session = F.col("session").cast("string")
    chunk = (F.col("offset") / chunk_turns).cast("int").cast("string")
    messages = F.transform("spoken", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"), m["timestamp"].alias("timestamp")))
    return kept.select(
        F.concat(F.lit(f"local:{tag}:locomo:conv-"), conv, F.lit(":s"), session,
                 F.lit(":chunk-"), chunk).alias("request_id"),
        F.concat(F.lit(f"local:{tag}:locomo:conv-"), conv).alias("user_id"),
        F.concat(F.lit(f"local:{tag}:conv-"), conv, F.lit(":s"), session).alias("session_id"),
        messages.alias("messages"),
        F.col("base").alias("arrival"),
        F.col("conv"),
        F.transform("spoken", lambda m: m["dia_id"]).alias("dias"))


def corpus_requests(corpus: DataFrame, tag: str, chunk_turns: int = S.CORPUS_CHUNK_TURNS) -> DataFrame:
    """The Add requests that replay a corpus."""
    return corpus_chunks(corpus, tag, chunk_turns).drop("conv", "dias")


def chunk_map(chunks: DataFrame) -> DataFrame:
    """Which turn each stored message came from: digest, conv, position, dia_id.

    A pure function of the corpus, so it can be rebuilt without another ingest.
    """
    return chunks.select(
        X.digest(F.col("user_id"), F.col("request_id")).alias("digest"), "conv",
        F.posexplode("dias").alias("position", "dia_id"))


def corpus_questions(corpus: DataFrame) -> DataFrame:
    """Questions that can be scored; the id counts the skipped ones too."""
    pairs = F.from_json("qa", T.ArrayType(T.StringType()))
    numbered = corpus.select(F.col("sample").alias("conv"), F.posexplode(pairs).alias("position", "raw"))
    return eval_questions(numbered.select(
        "conv", "position", F.from_json("raw", CORPUS_QA).alias("qa"),
        F.array_contains(F.json_object_keys("raw"), "answer").alias("answered"))
        .select("conv", "position", "qa.*", "answered"))


def string_entries(json_list: Column) -> Column:
    """The entries of a JSON list that are strings; null when it is not a list."""
    entries = F.from_json(json_list, T.ArrayType(T.VariantType()))
    strings = F.filter(entries, lambda e: F.schema_of_variant(e) == "STRING")
    return F.transform(strings, lambda e: F.variant_get(e, "$", "string"))


def eval_questions(pairs: DataFrame) -> DataFrame:
    """Scorable rows of conv, position, question, answer, category, evidence, answered."""
    none = F.array().cast("array<string>")
    kept = pairs.where((F.coalesce("category", F.lit(-1)) != S.EXCLUDED_CATEGORY) & F.col("answered"))
    return kept.select(
        F.format_string("conv%d-q%d", "conv", "position").alias("question_id"), "conv", "question",
        F.col("answer").alias("gold_answer"), "category",
        F.coalesce(string_entries(F.col("evidence")), none).alias("evidence"))
