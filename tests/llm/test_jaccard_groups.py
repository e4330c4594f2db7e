"""Groups of near copies under frequent passages, hot unmarked words and repeated ids."""

import random

import pytest

from turnstore.llm import jaccard_join

RND = random.Random(11)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: least[find(i)] if sets[i] else doc for i, (doc, _) in enumerate(rows)}


def words(n, of=10**6):
    return [f"w{RND.randrange(of)}" for _ in range(n)]


def near_copies():
    """A cluster around one passage, some of it just below the similarity, and texts that share the passage only."""
    passage, rows = words(60), []
    for i in range(90):
        text = passage.copy()
        for _ in range(RND.choice([0, 1, 1, 2, 2, 3])):
            text[RND.randrange(60)] = f"x{RND.randrange(40)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(words(RND.randrange(5, 80)) + passage + words(RND.randrange(5, 80)))) for i in range(40)]
    return rows + [(300 + i, " ".join(passage[:RND.randrange(30, 60)])) for i in range(30)]


@pytest.mark.parametrize("few,block_rows,frequent", [(64, 1000, 3), (2, 7, 3), (2, 7, 10**9), (0, 25, 10**9)])
def test_groups_equal_brute_force(spark, monkeypatch, few, block_rows, frequent):
    # frequent = 10**9: no word is marked, so hot words are found by their holders alone.
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join._block_pairs, "__defaults__", (block_rows,))
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in jaccard_join.similarity_groups(docs, few=few).collect()}
    assert found == components(rows)


def test_pairs_are_given_out_once(spark):
    # Forty documents that share many frequent words: each plausible pair leaves one cell only.
    rows = [(k, n, n, 100, 0, bytes(32)) for k in range(-9, 0) for n in range(40)]
    frame = spark.createDataFrame(rows, "key long, node long, root long, n_shingles long, n_rare long, parity binary").selectExpr("*", "node AS doc_id")
    for block_rows in (1000, 6):
        pairs = [tuple(r) for r in jaccard_join._block_pairs(frame, 80, block_rows).collect()]
        assert len(pairs) == len(set(pairs)) == 40 * 39 // 2


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, c, d, e = (" ".join(words(30)) for _ in range(4))
    rows = [(1, a, "x"), (2, a, "x"), (2, c, "x"), (3, d, "x"), (3, e, "x"), (3, e, "y"), (None, a, "x"), (None, " ".join(words(9)), "x"),
            (None, None, "x"), (5, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_first(docs).collect()), key=str)
    expected = [(1, a), (2, c), (3, d), (3, e), rows[7][:2], (None, None), (5, ""), (5, "")]
    assert kept == sorted(expected, key=str)
    assert jaccard_join.keep_first(docs).columns == docs.columns
    assert jaccard_join.keep_first(docs.limit(0)).count() == 0
