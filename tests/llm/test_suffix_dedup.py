"""Repeated byte strings against a brute-force search, on awkward texts."""

import collections
import hashlib
import random

import numpy as np
import pytest

from turnstore.llm import suffix_dedup

RND = random.Random(3)


def some(n):
    return "".join(RND.choice("abcdefgh é") for _ in range(n))


PASSAGE, SECOND, LINE = some(700), some(260), some(50)
TEXTS = [None, "", "short", PASSAGE, PASSAGE, some(100) + PASSAGE[100:400] + some(50), "a" * 1000, some(33) + "a" * 450 + some(300),
         "ab" * 500, some(100) + "ba" * 120, SECOND[:199], SECOND[3:203], LINE * 20, some(20_000) + PASSAGE[200:420],
         some(100) + PASSAGE[50:500] + some(40) + PASSAGE[300:690]]
TEXTS += [some(RND.randrange(300)) + PASSAGE[RND.randrange(100):RND.randrange(300, 700)] + some(RND.randrange(300)) for _ in range(60)]
TEXTS += [some(RND.randrange(30)) + "=" * RND.randrange(100, 400) + some(RND.randrange(30)) + "=-" * RND.randrange(100, 140) for _ in range(40)]
ROWS = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, some(300) + SECOND, "x", 1), (None, some(9) + SECOND, "x", 1), (7, TEXTS[20], "y", 2)]


def brute(rows, size):
    seen, found = collections.Counter(), collections.Counter()
    raws = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, raw in raws:
        seen.update(raw[i:i + size] for i in range(len(raw) - size + 1))
    for i, raw in raws:
        gone = bytearray(len(raw))
        for at in range(len(raw) - size + 1):
            if seen[raw[at:at + size]] > 1:
                gone[at:at + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        found[i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return found


@pytest.mark.parametrize("limits", [
    {}, {"most_runs": 3}, {"filter_bits": 1}, {"most_runs": 5, "filter_bits": 1, "block_bytes": 2000}, {"min_bytes": 77}])
def test_repeats(spark, limits):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, run string, key int").repartition(5)
    found = suffix_dedup.find_repeats(docs, **limits).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256")
    assert collections.Counter(map(tuple, found.collect())) == brute(ROWS, limits.get("min_bytes", 200))


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, PASSAGE + "left"), (2, "right" + PASSAGE)], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.find_repeats(docs, with_kept=True).collect()}
    assert kept == {1: b"left", 2: b"right"}
    assert suffix_dedup.find_repeats(docs.limit(0)).collect() == []


def test_runs_cover_every_suffix_once_across_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 500)
    raws = [t.encode() for t in TEXTS if t]
    runs = suffix_dedup.Runs(raws)
    places = sorted((t, p) for t, s, n in zip(runs.text, runs.start, runs.size) for p in range(s, s + n))
    assert places == [(t, p) for t, raw in enumerate(raws) for p in range(len(raw) - 199)]


def test_ties_of_different_residues():
    # Periodic strings: suffixes that agree on far more than a period, at many residues.
    contents = [b"x" * k + b"ab" * 130 + bytes([65 + k]) * (200 - k) for k in range(9)]
    found = suffix_dedup.repeated_suffixes(np.zeros(9, np.int64), contents, np.ones(9, np.int64))
    seen = collections.Counter(c[i:i + 200] for c in contents for i in range(len(c) - 199))
    for content, marks in zip(contents, found):
        assert marks.tolist() == [seen[content[i:i + 200]] > 1 for i in range(len(content) - 199)]
    assert {(i - j) % suffix_dedup.PERIOD for i in suffix_dedup.COVER for j in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
