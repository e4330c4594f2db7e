"""The registered lexical queries hold bounded blocks of long texts, and return the right rows."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """2,800 texts of one user, 53 MB as token lists, and one question to them."""
    sf = str(tmp_path_factory.mktemp("long"))
    n = F.col("id")
    words = F.concat(F.repeat(F.lit("alpha "), (n % 7).cast("int")), F.repeat(F.lit("o" * 90 + " "), 200))
    docs = spark.range(0, 2_800, 1, 1).select((F.expr("id div 20") * 400 + 20 + n % 20).alias("doc_id"), words.alias("text"))
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, "alpha")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def _best(lists):
    """The first 20 by summed reciprocal ranks."""
    scores = {}
    for weight, ranked in lists:
        for p, seq in enumerate(ranked[:200], 1):
            scores[seq] = scores.get(seq, 0) + weight / (60 + p)
    return sorted(scores, key=lambda seq: (-round(scores[seq], 9), seq))[:20]


# Weight of the lexical ranking (None: it stands alone), and whether it has raw memories only.
@pytest.mark.parametrize("name, weight, raw", [("rrf_fusion", 1.0, False), ("rrf_fusion_raw_only", 0.5, True), ("bm25_scan", None, False)])
def test_registered_queries_hold_bounded_blocks(spark, monkeypatch, long_texts, name, weight, raw):
    from turnstore.operators import lexical
    from workloads import derive
    from workloads.catalog import QUERIES
    channel = lexical.bm25_channel()

    def watched(held, questions):
        if held.nbytes > 20_000_000:
            raise ValueError(f"{held.nbytes} bytes are scored at once")
        return channel.scorer(held, questions)

    monkeypatch.setattr(lexical, "bm25_channel", lambda: replace(channel, scorer=watched))
    hits = QUERIES[name](spark, long_texts).orderBy("p").collect()
    seqs = dict(derive.document_memories(spark, long_texts).select("id", "seq").collect())
    # The more often a text says it, the better on both channels; equal ones in the order they came.
    ranked = sorted(range(2_800), key=lambda n: (-(n % 7), n))
    ranked = [n // 20 * 400 + 20 + n % 20 for n in ranked]
    lists = [(1.0, ranked)] if weight is None else [(1.0, ranked), (weight, [seq for seq in ranked if not raw or seq % 4 != 3])]
    assert [seqs[h.id] for h in hits] == _best(lists) and [h.p for h in hits] == list(range(1, 21))
