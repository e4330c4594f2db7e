"""The stored index against the scan, on hot terms, ties, several parts and unknown users."""

import random

import pytest
from pyspark.sql import functions as F

from turnstore.operators import lexical
from turnstore.operators.postings import LexicalIndex

RND = random.Random(4)


@pytest.fixture(scope="module")
def memories(spark):
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(700):
        user = f"u{0 if n % 2 else n % 9}"
        text = " ".join(RND.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=RND.choice([0, 1, 3, 8, 30])))
        rows.append((user, f"m{n}", n, text if n % 50 else None))
    rows += [("u0", f"c{n}", 1000 + n, "w0 w1 w2 common copy") for n in range(60)]
    return spark.createDataFrame(rows, "user_id string, id string, seq bigint, content string").coalesce(2)


@pytest.fixture(scope="module")
def questions(spark):
    asked = [(f"q{n}", f"u{n % 11}", " ".join(RND.choices([f"w{i}" for i in range(70)], k=RND.choice([1, 2, 5])))) for n in range(60)]
    return spark.createDataFrame([*asked, ("none", "u0", ""), ("copy", "u0", "common COPY w59"), ("all", "u0", "w0")], "query_id string, user_id string, query string")


@pytest.mark.parametrize("k,limits", [(5, {"block_texts": 4}), (40, {"block_texts": 50}), (1, {"block_texts": 1}), (2000, {})])
def test_index_equals_scan(spark, memories, questions, tmp_path, k, limits):
    index = LexicalIndex(str(tmp_path / "i"), buckets=3, **limits)
    assert index.hits(questions, k).count() == 0
    for part in range(3):
        index.add(memories.where(F.col("seq") % 3 == part))
    expected = {(r.query_id, r.p): (r.id, r.score) for r in lexical.bm25_hits(memories, questions, k).collect()}
    found = {(r.query_id, r.p): (r.id, r.score) for r in index.hits(questions, k).collect()}
    assert found.keys() == expected.keys() and len(found) > 40
    for place, (id_, score) in expected.items():
        assert found[place] == (id_, pytest.approx(score, abs=2e-9)), place


def test_blocks_that_cannot_matter_are_left_out(spark, tmp_path, monkeypatch):
    rows = [("u", f"m{n}", n, "rare " * (n < 10) + "often " + "pad " * (n % 40)) for n in range(2000)]
    memories = spark.createDataFrame(rows, "user_id string, id string, seq bigint, content string")
    index = LexicalIndex(str(tmp_path / "i"), block_texts=20)
    index.add(memories)
    read, real = [], LexicalIndex._scores
    monkeypatch.setattr(LexicalIndex, "_scores", staticmethod(lambda p, w, blocks: (read.append(blocks.count()), real(p, w, blocks))[1]))
    asked = spark.createDataFrame([("q", "u", "rare often")], "query_id string, user_id string, query string")
    found = index.hits(asked, 5).collect()
    assert sorted(int(r.id[1:]) for r in found) == [0, 1, 2, 3, 4]
    # A hundred blocks hold the frequent term; the rare one decides.
    assert read == [1, 1]
