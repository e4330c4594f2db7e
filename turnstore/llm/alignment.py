"""Token alignment of two tokenizers over a corpus, with an identity map for equal tokens.

Byte offsets at which tokens of A and B both end cut a text into groups; a pair of
tokens is linked where their byte ranges overlap. Most groups are one A token and the B
token of the same bytes. For these an array over A's vocabulary, built once, names the B
id, so a text holds them as A ids alone and the corpus counts them in a vector of
vocabulary length. Only other (irregular) pairs are counted by a shuffle.

Both tokenizers cut before a single space between two other characters: the byte-level
pattern binds such a space to what follows, and no piece of B holds its space mark after
another character (checked on loading). Stretches between such cuts are encoded and
aligned once and remembered. A text with a stretch that does not come back byte by byte
is encoded as a whole, and has no tokens if that does not come back either.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from turnstore.llm.words import list_array
from turnstore.runtime import cut_lineage

# Beyond so many stretches or characters of them a task forgets those that are rare.
CACHE_STRETCHES, CACHE_CHARS = 150_000, 1 << 23
# Stretches that are encoded at once.
LEARN_STRETCHES = 1 << 13
# Characters of one text that are held as stretches at once.
PIECE_CHARS = 1 << 20
# Characters of texts that are aligned together.
SET_CHARS = 1 << 19
# Most irregular pairs of the corpus that are sent to every task; more meet the texts in a shuffle.
SENT_PAIRS = 1 << 20

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_MARK = "▁"
_ROW_BITS = 36


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable bytes stand for themselves, the others are the symbols from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """A (byte-level, ``tokenizers`` file) and B (pieces, ``sentencepiece`` model), and A's identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        symbols = byte_of_symbol()
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, number in entries.items():
            self.bytes_a[number] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else b""
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.cuts = not any(_MARK in p.lstrip(_MARK) for p in pieces)
        known = [_BYTE.fullmatch(p) for p in pieces]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace(_MARK, " ").encode() for p, m in zip(pieces, known)]
        # Whole pieces win over the bytes B falls back to.
        id_of = {raw: i for i, raw in enumerate(self.bytes_b) if known[i]}
        id_of |= {raw: i for i, raw in enumerate(self.bytes_b) if not known[i] and not self.b.is_control(i)}
        self.identity = np.array([id_of.get(raw, -1) if raw else -1 for raw in self.bytes_a], np.int64)

    @property
    def size_b(self) -> int:
        return len(self.bytes_b)

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A for a space and each part, and of B, which adds the space itself."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]
        return a, self.b.encode(parts, num_threads=1)


def links(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the A token, place of the B token) of every linked pair, in order.

    Boundaries of either side cut the bytes into stretches, and each linked pair
    overlaps in exactly one of them.
    """
    starts_a = np.cumsum(sizes_a[a]) - sizes_a[a]
    starts_b = np.cumsum(sizes_b[b]) - sizes_b[b]
    cuts = np.union1d(starts_a, starts_b)
    return np.searchsorted(starts_a, cuts, "right") - 1, np.searchsorted(starts_b, cuts, "right") - 1


class _Table:
    """Alignments of stretches: counts, group texts, and the pair codes of all of them in one pool."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.texts: list[str | None] = []  # None: does not come back
        self.counts = np.empty((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.starts = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)
        self.pool = np.empty(0, np.int64)
        self.n_codes = self.n_chars = 0

    def full(self) -> bool:
        return len(self.texts) > CACHE_STRETCHES or self.n_chars > CACHE_CHARS

    def of_use(self) -> _Table:
        """A table of the stretches that were asked for again, the most frequent ones if there are too many."""
        uses, sizes = self.uses[:len(self.texts)], np.fromiter(map(len, self.place), np.int64, len(self.texts))
        order = np.argsort(-uses, kind="stable")
        room = (np.arange(len(order)) < CACHE_STRETCHES // 2) & (np.cumsum(sizes[order]) < CACHE_CHARS // 2)
        at = np.sort(order[room & (uses[order] > 1)])
        parts, kept = list(self.place), _Table()
        kept.add([parts[i] for i in at], [self.texts[i] for i in at], self.counts[at], self.codes(at))
        return kept

    def add(self, parts: list[str], texts: list[str | None], counts: np.ndarray, codes: np.ndarray) -> None:
        old = len(self.texts)
        self.place.update(zip(parts, range(old, old + len(parts))))
        self.texts += texts
        self.counts = _room(self.counts, old, len(parts))
        self.starts = _room(self.starts, old, len(parts))
        self.uses = _room(self.uses, old, len(parts))
        self.uses[old:old + len(parts)] = 0
        self.counts[old:old + len(parts)] = counts
        self.starts[old:old + len(parts)] = self.n_codes + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.pool = _room(self.pool, self.n_codes, len(codes))
        self.pool[self.n_codes:self.n_codes + len(codes)] = codes
        self.n_codes += len(codes)
        self.n_chars += sum(map(len, parts))

    def codes(self, at: np.ndarray) -> np.ndarray:
        """The pair codes of the stretches *at*, one after the other."""
        lengths = self.counts[at, 3]
        shift = self.starts[at] - (np.cumsum(lengths) - lengths)
        return self.pool[np.repeat(shift, lengths) + np.arange(lengths.sum())]


def _room(values: np.ndarray, used: int, more: int) -> np.ndarray:
    """*values*, enlarged if *more* rows do not fit behind the *used* ones."""
    if used + more <= len(values):
        return values
    larger = np.empty((2 * (used + more), *values.shape[1:]), values.dtype)
    larger[:used] = values[:used]
    return larger


@dataclass
class Alignment:
    """One text: counts, digest of its groups, distinct pair codes and how often each occurs."""

    counts: np.ndarray
    groups_sha256: str
    codes: np.ndarray
    times: np.ndarray


_NONE = Alignment(np.zeros(4, np.int64), "", np.empty(0, np.int64), np.empty(0, np.int64))


class Aligner:
    """Alignments of texts, remembering those of stretches."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self._sizes = [np.array([len(x) for x in side], np.int64) for side in (tokenizers.bytes_a, tokenizers.bytes_b)]
        # What is written after an id: inside a side of a group, and after its last token.
        self._written = [[[f"{i}{end}" for i in range(len(size))] for end in ends]
                         for size, ends in zip(self._sizes, ((",", "|"), (",", ";")))]
        self._known = _Table()

    def _learn(self, known: _Table, parts: list[str]) -> None:
        """Align *parts* and add them to *known*."""
        ids = self.tokenizers.encode(parts)
        good = self._come_back(parts, ids)
        if not all(good):
            ids = [[i if ok else [] for i, ok in zip(side, good)] for side in ids]
        lengths = [np.fromiter(map(len, side), np.int64, len(parts)) for side in ids]
        a, b = (np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in zip(ids, lengths))
        counts = np.zeros((len(parts), 4), np.int64)
        counts[:, 0], counts[:, 1] = lengths
        codes, texts = np.empty(0, np.int64), [""] * len(parts)
        if len(a):
            at_a, at_b = links(a, b, *self._sizes)
            codes = a[at_a] * self.tokenizers.size_b + b[at_b]
            counts[:, 3] = np.bincount(np.repeat(np.arange(len(parts)), lengths[0])[at_a], minlength=len(parts))
            # A group of n and m tokens, without a common cut inside, has n + m - 1 links.
            counts[:, 2] = counts[:, 0] + counts[:, 1] - counts[:, 3]
            texts = self._group_texts(a, b, lengths)
        known.add(parts, [t if ok else None for t, ok in zip(texts, good)], counts, codes)

    def _come_back(self, parts: list[str], ids: tuple[list[list[int]], list[list[int]]]) -> list[bool]:
        """Whether the tokens of both sides are the bytes of a space and the part."""
        raw = [(" " + p).encode() for p in parts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        tables, whole = (self.tokenizers.bytes_a, self.tokenizers.bytes_b), b"".join(raw)
        lossless = True
        for table, size, side in zip(tables, self._sizes, ids):
            flat = list(chain.from_iterable(side))
            of_part = np.repeat(np.arange(len(parts)), np.fromiter(map(len, side), np.int64, len(side)))
            lossless &= b"".join(map(table.__getitem__, flat)) == whole and bool(
                (np.bincount(of_part, size[flat], len(parts)) == sizes).all() if flat else not sizes.any())
        # A part is looked at alone only if something is wrong.
        return [True] * len(parts) if lossless else [
            all(b"".join(map(table.__getitem__, side[i])) == raw[i] for table, side in zip(tables, ids)) for i in range(len(parts))]

    def _group_texts(self, a: np.ndarray, b: np.ndarray, lengths: list[np.ndarray]) -> list[str]:
        """``a1,a2|b1;a3|b2`` for each part: the ids of its groups."""
        ends = [np.cumsum(size[side]) for side, size in zip((a, b), self._sizes)]
        common = np.intersect1d(*ends, assume_unique=True)
        groups = [np.searchsorted(common, end) for end in ends]
        last = [np.append(g[1:] != g[:-1], True) for g in groups]
        written = [list(map(self._written[side][0].__getitem__, x.tolist())) for side, x in enumerate((a, b))]
        for side, x in enumerate((a, b)):
            for place in np.flatnonzero(last[side]).tolist():
                written[side][place] = self._written[side][1][x[place]]
        order = np.argsort(np.concatenate([2 * groups[0], 2 * groups[1] + 1]), kind="stable")
        every = written[0] + written[1]
        flat = [every[i] for i in order.tolist()]
        bounds = np.concatenate(([0], np.cumsum(lengths[0] + lengths[1]))).tolist()
        return ["".join(flat[i:j])[:-1] for i, j in zip(bounds, bounds[1:])]

    @staticmethod
    def _pieces(text: str) -> Iterator[list[str]]:
        """Stretches of *text*, a bounded number of characters at a time."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            cut = _CUT.search(text, start + PIECE_CHARS)
            if cut is None:
                break
            yield _CUT.split(text[start:cut.start()])
            start = cut.end()
        yield _CUT.split(text[start:] if start else text)

    def align(self, texts: Iterable[str | None]) -> list[Alignment]:
        """The alignment of each text; null, empty and altered ones have none."""
        texts = list(texts)
        open_, done = {}, {}
        waiting, chars = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            for parts in self._pieces(text) if self.tokenizers.cuts else [[text]]:
                waiting.append((i, parts))
                chars += sum(map(len, parts)) + len(parts)
                if chars > SET_CHARS:
                    self._take(waiting, open_)
                    waiting, chars = [], 0
        self._take(waiting, open_)
        for i, pieces in open_.items():
            done[i] = self._whole(texts[i]) if None in pieces else _joined(pieces)
        return [done.get(i, _NONE) for i in range(len(texts))]

    def _whole(self, text: str) -> Alignment:
        single, pieces = _Table(), {}
        self._learn(single, [text])
        self._sum([(0, [text])], single, pieces)
        return _NONE if None in pieces[0] else _joined(pieces[0])

    def _take(self, waiting: list[tuple[int, list[str]]], pieces: dict) -> None:
        """Align the pieces of texts in *waiting* and add them to *pieces*, by text."""
        if self._known.full():
            self._known = self._known.of_use()
        new = set().union(*(parts for _, parts in waiting)).difference(self._known.place)
        parts = sorted(new)
        for low in range(0, len(parts), LEARN_STRETCHES):
            self._learn(self._known, parts[low:low + LEARN_STRETCHES])
        self._sum(waiting, self._known, pieces)

    @staticmethod
    def _sum(waiting: list[tuple[int, list[str]]], known: _Table, pieces: dict) -> None:
        if not waiting:
            return
        lengths = np.array([len(parts) for _, parts in waiting])
        at = np.fromiter(map(known.place.__getitem__, chain.from_iterable(parts for _, parts in waiting)), np.int64, lengths.sum())
        known.uses[:len(known.texts)] += np.bincount(at, minlength=len(known.texts))
        starts = np.cumsum(lengths) - lengths
        totals = np.add.reduceat(known.counts[at], starts, axis=0)
        codes = known.codes(at)
        texts = list(map(known.texts.__getitem__, at.tolist()))
        bounds = np.concatenate(([0], np.cumsum(totals[:, 3])))
        for (i, parts), first, total, low, high in zip(waiting, starts.tolist(), totals, bounds[:-1], bounds[1:]):
            own = texts[first:first + len(parts)]
            pieces.setdefault(i, []).append(
                None if None in own else (total, ";".join(own), *np.unique(codes[low:high], return_counts=True)))


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker, so that tasks share its tables and what it remembers."""
    return Aligner(Tokenizers(path_a, path_b))


def _joined(pieces: list[tuple]) -> Alignment:
    """One alignment out of those of the pieces of a text."""
    if len(pieces) == 1:
        total, text, codes, times = pieces[0]
        return Alignment(total, hashlib.sha256(text.encode()).hexdigest(), codes, times)
    digest = hashlib.sha256()
    for n, piece in enumerate(pieces):
        digest.update(((";" if n else "") + piece[1]).encode())
    codes, inverse = np.unique(np.concatenate([p[2] for p in pieces]), return_inverse=True)
    times = np.bincount(inverse, np.concatenate([p[3] for p in pieces])).astype(np.int64)
    return Alignment(sum(p[0] for p in pieces), digest.hexdigest(), codes, times)


_ALIGNED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")], T.StructField("groups_sha256", T.StringType()),
    T.StructField("same", T.ArrayType(T.IntegerType())), T.StructField("same_times", T.ArrayType(T.IntegerType())),
    T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("pair_times", T.ArrayType(T.IntegerType()))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """*batches* in parts of bounded size, a long text being a part of its own."""
    for batch in batches:
        low = held = 0
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > SET_CHARS:
                yield batch.slice(low, i - low)
                low, held = i, 0
            held += size
        yield batch.slice(low)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of *docs* (doc_id, text): its counts, the digest of its groups, and its distinct linked pairs.

    ``same`` holds A ids linked with the B id of the same bytes, ``pairs`` the other pairs as
    a * (size of B's vocabulary) + b; ``same_times`` and ``pair_times`` say how often. Texts that
    are null, empty, or do not come back byte by byte have no tokens: zeros, empty lists and ''.
    Rows that repeat are separate documents. ``row`` is unique once the result is written.
    Other columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        size_b, identity = aligner.tokenizers.size_b, aligner.tokenizers.identity
        row = TaskContext.get().partitionId() << _ROW_BITS
        for batch in _slices(batches):
            found = aligner.align(batch.column("text").to_pylist())
            same, same_times, pairs, pair_times = [], [], [], []
            for x in found:
                regular = identity[x.codes // size_b] == x.codes % size_b
                same.append((x.codes[regular] // size_b).astype(np.int32))
                same_times.append(x.times[regular].astype(np.int32))
                pairs.append(x.codes[~regular])
                pair_times.append(x.times[~regular].astype(np.int32))
            table = np.array([x.counts for x in found], np.int64).reshape(-1, 4)
            digests = [x.groups_sha256 for x in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(found))), batch.column("doc_id").cast(pa.int64()),
                *[pa.array(table[:, i]) for i in range(4)], pa.array(digests, pa.string()), list_array(same, pa.int32()),
                list_array(same_times, pa.int32()), list_array(pairs, pa.int64()), list_array(pair_times, pa.int32())],
                [f.name for f in _ALIGNED])
            row += len(found)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _ALIGNED)


def same_counts(aligned: DataFrame, size_a: int) -> np.ndarray:
    """How many documents hold each A id linked with its identity: one vector of vocabulary length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size_a, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("same").flatten().to_numpy(zero_copy_only=False), minlength=size_a)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"a": pa.array(held), "n": pa.array(total[held])})

    rows = aligned.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).toArrow()
    vector = np.zeros(size_a, np.int64)
    vector[rows.column("a").to_numpy()] = rows.column("n").to_numpy()
    return vector


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n) for the irregular pairs: how many documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(codes.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


_SCORES = "n_best long, count_sum long"


def _scored(table: pa.RecordBatch, name: str, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of *table*: links of the list *name* that are the best of their A id, and the sum of their counts."""
    lists = table.column(name)
    lengths = np.diff(lists.offsets.to_numpy())
    times = table.column("same_times" if name == "same" else "pair_times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(lengths)))
    sums = [np.concatenate(([0], np.cumsum(x))) for x in (times * (counts == best), times * counts)]
    return tuple(s[ends[1:]] - s[ends[:-1]] for s in sums)


def link_scores(docs: DataFrame, path_a: str, path_b: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """:func:`align` with, per document, ``n_best`` and ``count_sum`` over its links.

    A pair's count is the number of documents of the corpus that hold it linked. ``n_best``
    counts links whose count is the highest of their A id (ties included), ``count_sum`` adds
    up the counts. Vectors of vocabulary length go to every task; up to *sent_pairs* irregular
    pairs do as well, more meet the documents in a shuffle, with equal results.
    """
    spark = docs.sparkSession
    aligned = cut_lineage(align(docs, path_a, path_b))
    known = Tokenizers(path_a, path_b)
    size_a, size_b = len(known.bytes_a), known.size_b
    vector = same_counts(aligned, size_a)
    pairs = cut_lineage(pair_counts(aligned))
    top = pairs.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("n")).toArrow()
    best = vector.copy()
    np.maximum.at(best, top.column("a").to_numpy(), top.column("n").to_numpy())
    sent = spark.sparkContext.broadcast((vector, best))
    if pairs.count() > sent_pairs:
        return _scores_by_join(aligned, pairs, sent, size_b)
    table = pairs.orderBy("pair").toArrow()
    all_pairs = spark.sparkContext.broadcast((table.column("pair").to_numpy(), table.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best = sent.value
        codes, n = all_pairs.value
        for batch in batches:
            a = batch.column("same").flatten().to_numpy(zero_copy_only=False)
            held = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            one = _scored(batch, "same", vector[a], best[a])
            counts = n[np.searchsorted(codes, held)] if len(held) else np.empty(0, np.int64)
            two = _scored(batch, "pairs", counts, best[held // size_b])
            yield _with_scores(batch, [x + y for x, y in zip(one, two)])

    return aligned.mapInArrow(run, f"{_RESULT}, {_SCORES}")


_RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _with_scores(batch: pa.RecordBatch, scores: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in _KEPT], *map(pa.array, scores)], [*_KEPT, "n_best", "count_sum"])


def _scores_by_join(aligned: DataFrame, pairs: DataFrame, sent, size_b: int) -> DataFrame:
    """Scores when the irregular pairs are too many to send: each document's pairs meet the counts in a shuffle."""

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best = sent.value
        for batch in batches:
            a = batch.column("same").flatten().to_numpy(zero_copy_only=False)
            yield _with_scores(batch, list(_scored(batch, "same", vector[a], best[a])))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = sent.value[1]
        for batch in batches:
            a = batch.column("pair").to_numpy() // size_b
            yield batch.append_column("best", pa.array(best[a]))

    counted = pairs.mapInArrow(best_of, "pair long, n long, best long")
    held = aligned.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("p")).select("row", "p.pairs", "p.pair_times")
    found = held.join(counted, held["pairs"] == counted["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("pair_times")).otherwise(0)).alias("_best"),
        F.sum(F.col("n") * F.col("pair_times")).alias("_sum"))
    return (aligned.mapInArrow(regular, f"{_RESULT}, {_SCORES}").join(found, "row", "left")
            .select(*_KEPT, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum")))
