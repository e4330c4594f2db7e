"""Explicit schemas of the tables; readers never infer."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("timestamp", T.LongType()),
])

ADD_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("arrival", T.LongType()),
])

SEARCH_REQUEST = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("options", T.ArrayType(T.StringType())),
])

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

MEMORY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("dedupe_key", T.StringType()),
    T.StructField("n_chars", T.IntegerType()),
    T.StructField("vec", VECTOR),
])

LEDGER = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("n_items", T.LongType()),
])

# One question-answer pair of a corpus sample. Answers and evidence entries may
# be any JSON value, so both are read as text.
CORPUS_QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("category", T.IntegerType()),
    T.StructField("evidence", T.StringType()),
])

CORPUS_TURN = T.StructType([
    T.StructField("speaker", T.StringType()),
    T.StructField("dia_id", T.StringType()),
    T.StructField("text", T.StringType()),
])
