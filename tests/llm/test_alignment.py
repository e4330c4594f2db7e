"""Alignment of two tokenizers against token-by-token comparison of byte ranges."""

import bisect
import collections
import hashlib
import re

import pytest

from turnstore.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

PATHS = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = [None, "", " ", "   two  spaces ", "plain words, and more words.", "plain words, and more words.", "Übergrößen déjà vu 日本語 \U0001f600!",
         "tabs\tand\nlines\r\n\n  indented", "<|endoftext|> </s> <s> <0x0A> is text", "mark ▁ within", "é ﬁ   nbsp　wide",
         "1234567 12.5% #$%&", "x" * 300, "a b " * 500, "\x00 null \x1f", " leading", "trailing ", "don't can't I'll"]
ROWS = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "no id words", "x", 1), (3, "repeated id", "y", 2)]


def expected(rows):
    a = tokenizers.Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    symbols = alignment.byte_of_symbol()

    def bytes_a(i):
        return bytes(symbols[c] for c in a.id_to_token(i))

    def bytes_b(i):
        known = re.fullmatch("<0x(..)>", b.id_to_piece(i))
        return bytes([int(known[1], 16)]) if known else b.id_to_piece(i).replace("▁", " ").encode()

    def ranges(ids, raw_of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(raw_of(i)), i))
            at = out[-1][1]
        return out

    linked, counts, best, found = [], collections.Counter(), collections.Counter(), collections.Counter()
    for _, text, *_ in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        sides = ranges(ids[0], bytes_a), ranges(ids[1], bytes_b)
        if not text or any(b"".join(map(f, i)) != (" " + text).encode() for f, i in zip((bytes_a, bytes_b), ids)):
            linked.append(None)
            continue
        pairs = [(x, y) for s, e, x in sides[0] for t, f, y in sides[1] if s < f and t < e]
        counts.update(set(pairs))
        cuts = sorted({r[1] for r in sides[0]} & {r[1] for r in sides[1]})
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            for _, end, i in sides[side]:
                groups[bisect.bisect_left(cuts, end)][side].append(str(i))
        joined = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        linked.append((len(ids[0]), len(ids[1]), len(cuts), pairs, hashlib.sha256(joined.encode()).hexdigest()))
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    for (i, *_), own in zip(rows, linked):
        if own is None:
            found[i, 0, 0, 0, 0, "", 0, 0] += 1
        else:
            n_a, n_b, n_groups, pairs, digest = own
            found[i, n_a, n_b, n_groups, len(pairs), digest, sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs)] += 1
    return found


@pytest.mark.parametrize("sent_pairs", [alignment.SENT_PAIRS, 3])
def test_links(spark, sent_pairs):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, pairs string, row int").repartition(3)
    found = alignment.link_scores(docs, *PATHS, sent_pairs=sent_pairs).drop("row")
    got = expected(ROWS)
    assert collections.Counter(map(tuple, found.collect())) == got
    # Texts that hold B's space mark do not come back.
    assert got[9, 0, 0, 0, 0, "", 0, 0] == 1


def test_empty_table(spark):
    assert alignment.link_scores(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_pieces_and_small_caches_change_nothing(monkeypatch):
    known = alignment.Tokenizers(*PATHS)
    assert known.cuts
    whole = alignment.Aligner(known).align(TEXTS)
    for name, value in {"PIECE_CHARS": 9, "SET_CHARS": 20, "CACHE_STRETCHES": 3, "LEARN_STRETCHES": 2}.items():
        monkeypatch.setattr(alignment, name, value)
    aligner = alignment.Aligner(known)
    for text, one, other in zip(TEXTS, whole, aligner.align(TEXTS)):
        assert one.counts.tolist() == other.counts.tolist() and one.groups_sha256 == other.groups_sha256, text
        assert one.codes.tolist() == other.codes.tolist() and one.times.tolist() == other.times.tolist()
        if text and one.groups_sha256:
            alone = aligner._whole(text)
            assert alone.groups_sha256 == one.groups_sha256 and alone.codes.tolist() == one.codes.tolist()
