"""Large texts are moved once where once is enough."""

import os

import pytest
from pyspark.sql import functions as F

from turnstore.operators import policies, postings
from turnstore.operators.postings import LexicalIndex
from workloads import derive as D
from workloads.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_texts_of_an_index_are_shuffled_once(spark, tmp_path, monkeypatch):
    rows = [(f"u{n % 3}", f"m{n}", n, f"w{n % 7} w{n % 7} w{n % 11}") for n in range(400)]
    memories = spark.createDataFrame(rows, "user_id string, id string, seq bigint, content string")
    plans, real = {}, LexicalIndex._write

    def write(self, table, part, rows, *args, **kwargs):
        plans[table] = rows._jdf.queryExecution().executedPlan().toString()
        return real(self, table, part, rows, *args, **kwargs)

    monkeypatch.setattr(LexicalIndex, "_write", write)
    monkeypatch.setattr(postings, "TASK_BYTES", 1_000)
    LexicalIndex(str(tmp_path / "i"), block_texts=20).add(memories)
    assert plans["postings"].count("Exchange ") == 1 and "rangepartitioning" in plans["postings"]
    read = spark.read.parquet(str(tmp_path / "i" / "postings"))
    counted = read.select("user_id", "term", F.inline("entries")).select("user_id", "term", "id", "tf").collect()
    assert len(counted) == read.agg(F.sum("size")).first()[0]
    words = {(u, w, i, t.split().count(w)) for u, i, _, t in rows for w in t.split()}
    assert {tuple(r) for r in counted} == words and len(counted) == len(words)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data is not here")
def test_documents_are_stored_once(spark, monkeypatch):
    monkeypatch.setattr(D, "_stored", {})
    documents = D.table(spark, SF, "documents").count()
    assert D.document_memories(spark, SF).count() == documents
    path = D._stored[spark.sparkContext.applicationId, SF, "documents"]
    assert spark.read.parquet(f"{path}/memories").count() == documents


def _above_the_texts(df):
    """What a plan does with rows that hold a text already: all that is above its last join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    return plan[:plan.index("Join")]


def test_parents_are_numbered_before_texts_are_joined(spark):
    a, b, c = (d * 16 for d in "abc")
    ranked = spark.createDataFrame(
        [("q", 1, f"{b}-r0"), ("q", 2, f"{c}-f1"), ("q", 3, f"{a}-r2"), ("q", 4, f"{b}-r1"), ("r", 1, f"{c}-r0")],
        "query_id string, p int, id string")
    transcripts = spark.createDataFrame([(a, "said a"), (b, "said b")], "digest string, transcript string")
    found = policies.parent_chunks(ranked, transcripts)
    # A chunk without a transcript takes no place.
    rows = sorted(tuple(r) for r in found.select("query_id", "pos", "digest", "content").collect())
    assert rows == [("q", 0, b, "said b"), ("q", 1, a, "said a")]
    above = _above_the_texts(found)
    assert "Window" not in above and "Exchange" not in above


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data is not here")
def test_texts_of_parents_are_not_shuffled_by_question(spark):
    above = _above_the_texts(QUERIES["parent_chunks"](spark, SF))
    assert "Window" not in above and "Exchange" not in above
