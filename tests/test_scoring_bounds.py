"""What a scoring task holds is bounded, and the bounds change no rank."""

import numpy as np
import pyarrow as pa


def test_blocks_are_bounded_in_rows_and_bytes():
    from turnstore.operators.scoring import _blocks
    batches = [pa.RecordBatch.from_pydict({"n": list(range(i, i + 10)), "t": [[f"word{i}"] * 100] * 10}) for i in range(0, 50, 10)]
    for rows, size in ((7, 1 << 30), (1_000, 3_000), (1_000, 1 << 30), (1, 1)):
        blocks = list(_blocks(iter(batches), rows, size))
        assert [n for b in blocks for n in b.column("n").to_pylist()] == list(range(50))
        # One batch that is not cut, or one row, is the least.
        assert all(b.nbytes <= size or b.num_rows == 1 or b.nbytes <= 1.2 * size for b in blocks)
        assert all(b.num_rows <= max(rows, 10) for b in blocks)


def test_scores_and_hits_held_at_once_are_bounded():
    from turnstore.operators import scoring
    rng = np.random.default_rng(3)
    table = lambda name, n, **more: pa.table({name: [f"{name}{i}" for i in range(n)], **more})
    # Few different scores, many ties, and scores that are only equal once they are rounded.
    vectors = [[float(v) + 1e-12 * i] for i, v in enumerate(rng.integers(-3, 4, 500))]
    memories = table("id", 500, seq=rng.permutation(500), vec=vectors)
    questions = table("query_id", 300, qvec=[[1.0]] * 300)
    shapes = []

    def watched(m, q):
        shapes.append((m.num_rows, q.num_rows))
        return scoring.dot_products(m, q)

    k = 400
    batches = list(scoring._best(memories, questions, scoring.Channel(watched, ("vec",), ("qvec",)), k, 9, scoring.SCORE_CELLS))
    assert max(b.num_rows for b in batches) <= scoring.HIT_ROWS and sum(b.num_rows for b in batches) == 300 * k
    assert all(m * q <= scoring.SCORE_CELLS for m, q in shapes) and scoring.SCORE_CELLS * 8 <= 1 << 24
    best = sorted(zip([-round(v[0], 9) + 0.0 for v in vectors], memories.column("seq").to_pylist()))[:k]
    got = pa.Table.from_batches(batches).to_pylist()
    assert [(-r["score"], r["seq"]) for r in got[:k]] == best and [(-r["score"], r["seq"]) for r in got[-k:]] == best


def test_a_grid_cell_is_bounded_in_hits_and_bytes(spark, monkeypatch):
    from turnstore.operators import scoring
    rows = [(f"u{n % 3}", f"i{n}", n, [float(n % 7), float(n % 11)]) for n in range(300)]
    memories = spark.createDataFrame(rows, "user_id string, id string, seq bigint, vec array<float>")
    asked = spark.createDataFrame([(f"q{n}", f"u{n % 3}", [1.0, float(n % 5)]) for n in range(90)],
                                  "query_id string, user_id string, qvec array<float>")
    expected = sorted(map(tuple, scoring.top_hits(memories, asked, 5, strategy="grid").collect()))
    monkeypatch.setattr(scoring, "CELL_HITS", 50)
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 2_000)
    most = []
    real = scoring.cut_lineage
    monkeypatch.setattr(scoring, "cut_lineage", lambda df: most.append(real(df)) or most[-1])
    assert sorted(map(tuple, scoring.top_hits(memories, asked, 5, strategy="grid").collect())) == expected
    assert all(r.blocks == 3 and r.slices > 1 for r in most[0].collect())
