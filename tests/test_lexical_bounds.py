"""Token lists are scored in bounded blocks, whichever way they meet the questions."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("strategy", ["scan", "grid"])
def test_a_block_of_long_texts_is_bounded_in_bytes(spark, monkeypatch, strategy):
    from turnstore.operators import lexical, scoring
    # One user in one partition: 2,500 texts of 1,000 words, about 23 MB as token lists.
    n = F.col("id")
    words = F.concat(F.repeat(F.lit("alpha "), F.greatest(n % 7 - 3, F.lit(0)).cast("int")), F.repeat(F.lit("other "), 1_000))
    memories = spark.range(0, 2_500, 1, 1).select(
        F.lit("u").alias("user_id"), n.cast("string").alias("id"), n.alias("seq"), words.alias("content"))
    asked = spark.createDataFrame([("q", "u", "alpha")], "query_id string, user_id string, query string")
    limit, channel = 1.2 * scoring.BLOCK_BYTES, lexical.bm25_channel()

    def watched(held, questions):
        if held.nbytes > limit:
            raise ValueError(f"{held.nbytes} bytes are scored at once")
        return channel.scorer(held, questions)

    monkeypatch.setattr(lexical, "bm25_channel", lambda: replace(channel, scorer=watched))
    hits = lexical.bm25_hits(memories, asked, 5, strategy=strategy).orderBy("p").collect()
    assert [h.seq for h in hits] == [6, 13, 20, 27, 34]


def test_a_block_of_many_users_is_copied_user_by_user(spark):
    import pyarrow as pa
    from turnstore.operators import lexical, scoring
    # Twenty users in one partition, about 12 MB as token lists; questions of every other user.
    n = F.col("id")
    memories = spark.range(0, 1_200, 1, 1).select(
        F.concat(F.lit("u"), n % 20).alias("user_id"), n.cast("string").alias("id"), n.alias("seq"),
        F.concat(F.repeat(F.lit("alpha "), (n % 7).cast("int")), F.repeat(F.lit("other "), 1_000)).alias("content"))
    asked = spark.createDataFrame([(f"q{u}", f"u{u}", "alpha") for u in range(0, 20, 2)], "query_id string, user_id string, query string")
    channel = lexical.bm25_channel()

    def watched(held, questions):
        # What came from the JVM is not in Arrow's own pool, its copies are.
        if held.nbytes > 1_000_000 or pa.total_allocated_bytes() > 4_000_000:
            raise ValueError(f"{pa.total_allocated_bytes()} bytes are held for {held.nbytes}")
        return channel.scorer(held, questions)

    weighted = lexical.weighted_questions(lexical.tokenised(memories), asked)
    hits = scoring.top_hits(lexical.tokenised(memories), weighted, 2, replace(channel, scorer=watched), strategy="scan").collect()
    sixes = lambda u: [i for i in range(u, 1_200, 20) if i % 7 == 6][:2]
    assert sorted((h.query_id, h.p, h.seq) for h in hits) == sorted((f"q{u}", p, i) for u in range(0, 20, 2) for p, i in enumerate(sixes(u), 1))


def test_arrow_batches_of_long_texts_are_bounded(spark):
    import pyarrow as pa
    from turnstore.runtime import prepare
    texts = spark.range(0, 3_000, 1, 1).select(F.repeat(F.lit("word "), 2_000).alias("t"))

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    prepare(spark)
    sizes = texts.mapInArrow(measured, "n bigint").collect()
    assert sum(s.n for s in sizes) > 30_000_000 and max(s.n for s in sizes) <= 9 * 1024 * 1024


def test_scores_of_many_rare_terms_are_right_and_bounded():
    import tracemalloc
    import numpy as np
    import pyarrow as pa
    from turnstore.operators import lexical
    rng = np.random.default_rng(5)
    words = [[f"w{w}" for w in rng.integers(0, 40_000, 60)] for _ in range(150)] + [[]]
    memories = pa.concat_tables([pa.table({"tokens": pa.array(part, pa.list_(pa.string()))}) for part in (words[:70], words[70:])])
    asked = [[f"w{w}" for w in range(q * 100, q * 100 + 120)] for q in range(300)] + [["none"]]
    idfs = [[1.0 + i / 100 for i in range(len(terms))] for terms in asked]
    questions = pa.table({"terms": asked, "idfs": idfs, "avg_len": [50.0] * len(asked)})
    tracemalloc.start()
    got = lexical.bm25_channel().scorer(memories, questions)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = np.zeros(got.shape)
    for row, held in enumerate(words):
        for q, (terms, weights) in enumerate(zip(asked, idfs)):
            for term in set(held) & {*terms}:
                tf = held.count(term)
                expected[row, q] += weights[terms.index(term)] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(held) / 50))
    assert np.allclose(got, expected, atol=1e-12) and got.any()
    # All weights at once would take 72 MB.
    assert peak < 40_000_000


def test_rows_without_user_belong_to_nobody():
    import pyarrow as pa
    from turnstore.operators import scoring
    users = ["a", None, "b", "a", "c", None, "b"]
    block = pa.concat_tables([pa.table({"user_id": users[i:i + 3], "seq": list(range(i, i + len(users[i:i + 3])))}) for i in (0, 3, 6)])
    found = {user: rows.column("seq").to_pylist() for user, rows in scoring._each_user(block, {"a", "b", "z"})}
    assert found == {"a": [0, 3], "b": [2, 6]}
