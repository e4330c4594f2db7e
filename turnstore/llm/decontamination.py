"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all normalised items is built once per block of items, whose size
is bounded, and goes to every task. A task streams the words of its documents
through it: the state after a word names the longest run of words ending there that
occurs in an item, so runs of at least ``window`` words (or a whole shorter item) are
hits. Words that cannot belong to a hit, because their word pairs occur in no item,
are skipped before the automaton is asked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField, StructType)

from turnstore.llm.words import alnum_words, raw_texts

WINDOW_WORDS = 13
# A document is contaminated if at least 1 / COVERAGE_PARTS of its words are hit.
COVERAGE_PARTS = 20
# Text of the items that one automaton, and so one broadcast, may hold.
BLOCK_BYTES = 1 << 20

# Words before lower-casing.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])


class ItemAutomaton:
    """A generalised suffix automaton over words, with the items each window occurs in.

    An item of fewer than ``window`` words is one window; an item without words has none.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW_WORDS):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[str]] = [set()]
        whole: dict[int, set[str]] = {}
        pairs, shortest = [], window
        for name, raw in items:
            words = [w for piece in alnum_words(raw) for w in piece]
            if not words:
                continue
            shortest = min(shortest, len(words))
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            pairs += zip(ids, ids[1:])
            at = 0
            for word in ids:
                at = self._extend(at, word)
                own += [set() for _ in range(len(self.link) - len(own))]
                own[at].add(name)
            if len(ids) < window:
                whole.setdefault(at, set()).add(name)
        self.shortest = shortest
        self._index(own, whole)
        # Word pairs of the items as a bit table; a chance hit only costs time.
        size = 1 << max(12, (16 * len(pairs)).bit_length())
        self.pair_mask = size - 1
        self.pair_table = np.zeros(size, bool)
        if pairs:
            found = np.array(pairs, np.int64)
            self.pair_table[self._slots(found[:, 0], found[:, 1])] = True

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x2545F491 + right * 0x9E3779B1) >> 3) & self.pair_mask

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, parent: int, word: int, child: int) -> int:
        """The state for the shorter strings of *child* that end after *parent*."""
        clone = self._state(self.length[parent] + 1, dict(self.step[child]), self.link[child])
        while parent >= 0 and self.step[parent].get(word) == child:
            self.step[parent][word] = clone
            parent = self.link[parent]
        self.link[child] = clone
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.step[at]:
            self.step[at][word] = new
            at = self.link[at]
        if at >= 0:
            child = self.step[at][word]
            self.link[new] = child if self.length[child] == self.length[at] + 1 else self._split(at, word, child)
        return new

    def _index(self, own: list[set[str]], whole: dict[int, set[str]]) -> None:
        own += [set() for _ in range(len(self.link) - len(own))]
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(by_length):
            parent = self.link[state]
            if self.length[parent] >= self.window:
                own[parent] |= own[state]
        # window_of: the state of the last `window` words; short_of: whole items that end here.
        self.window_of = [0] * len(self.link)
        self.short_of: list[tuple] = [()] * len(self.link)
        for state in by_length:
            parent = self.link[state]
            if self.length[state] >= self.window:
                self.window_of[state] = self.window_of[parent] or state
            here = ((self.length[state], frozenset(whole[state])),) if state in whole else ()
            self.short_of[state] = self.short_of[parent] + here
        self.items = {s: frozenset(own[s]) for s in set(self.window_of) if s}

    def scan(self, raw: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans of words (disjoint, in order), names of the items."""
        parts = [np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
                 for words in alnum_words(raw or b"")]
        ids = np.concatenate(parts)
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.vocabulary:
            return len(ids), spans, found
        for start, end in self._stretches(ids):
            self._stream(ids[start:end].tolist(), start, spans, found)
        return len(ids), spans, found

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Maximal stretches of words in which every word pair occurs in an item."""
        if self.shortest == 1:
            good, extra = ids >= 0, 0
        else:
            left, right = ids[:-1], ids[1:]
            good, extra = (left >= 0) & (right >= 0), 1
            good &= self.pair_table[self._slots(left, right)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if end - start + extra >= self.shortest:
                yield start, end + extra

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        state = matched = 0
        step, link, length, window = self.step, self.link, self.length, self.window
        for place, word in enumerate(ids, base + 1):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word not in step[state]:
                continue
            state = step[state][word]
            matched += 1
            back = 0
            if matched >= window:
                back = window
                found |= self.items[self.window_of[state]]
            if self.short_of[state]:
                for size, names in self.short_of[state]:
                    if size <= matched:
                        back = max(back, size)
                        found |= names
            if back:
                start = place - back
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, place))


def _blocks(items: DataFrame, window: int, block_bytes: int) -> list[ItemAutomaton]:
    """One automaton per block of items; a block's text is bounded, one item at least."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         F.col("text").cast("string").alias("text")).where("text is not null")
    blocks, held, size = [], [], 0
    for row in named.toLocalIterator():
        raw = row["text"].encode()
        if held and size + len(raw) > block_bytes:
            blocks.append(ItemAutomaton(held, window))
            held, size = [], 0
        held.append((row["item"], raw))
        size += len(raw)
    return [*blocks, ItemAutomaton(held, window)]


_SCANNED = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)),
                       StructField("items", ArrayType(StringType()))])


def _scan(docs: DataFrame, automaton: ItemAutomaton, keys: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(automaton)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            counts, spans, items = [], [], []
            for raw in raw_texts(batch, "_text"):
                n, hit, names = own.scan(raw)
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted(names))
            kept = {k: batch.column(k) for k in keys}
            yield pa.RecordBatch.from_pydict(kept | {
                "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span),
                "items": pa.array(items, pa.list_(pa.string()))})

    schema = StructType([docs.schema[k] for k in keys] + _SCANNED.fields)
    return docs.select(*keys, "_text").mapInArrow(scan, schema)


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"),
                              (a["sum"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("sum")),
        lambda a: a["sum"])


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                       coverage_parts: int = COVERAGE_PARTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of *docs* (doc_id, text): doc_id, n_words, n_hit, spans (of words), items, contaminated.

    Null texts have no words. Items without text or words are ignored, an item
    without id is named by the empty string, equal ids are one item. No items: nothing
    is hit. Repeated documents are judged one by one; other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    blocks = _blocks(items, window, block_bytes)
    if len(blocks) == 1:
        found = _scan(rows, blocks[0], ["doc_id"])
    else:
        # Items in blocks: each passes all rows, the few hits meet by document and text.
        rows = rows.withColumn("_key", F.sha2(F.coalesce("_text", F.lit("")), 256)).groupBy("doc_id", "_key").agg(
            F.count("*").cast("int").alias("_copies"), F.first("_text").alias("_text"))
        parts = [_scan(rows, b, ["doc_id", "_key", "_copies"]) for b in blocks]
        merged = parts[0]
        for part in parts[1:]:
            merged = merged.unionByName(part)
        found = merged.groupBy("doc_id", "_key").agg(
            F.max("_copies").alias("_copies"), F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        ).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    n_hit = _covered(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (coverage_parts * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS,
                        coverage_parts: int = COVERAGE_PARTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """*docs* without the documents over the coverage limit; all columns and other rows stay.

    With one block of items the scan runs beside the columns of the row, without a
    join; with several, the rows of contaminated texts are taken out, whatever their
    ids. Spans in documents below the limit are left alone; see :func:`remove_spans`.
    """
    blocks = _blocks(items, window, block_bytes)
    if len(blocks) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(blocks[0])
        return docs.mapInArrow(_dropper(sent, coverage_parts), docs.schema)
    text = F.col("text").cast("string")
    key = F.sha2(text, 256)
    # A text is contaminated or not, so its digest is the key; null texts have none and stay.
    texts = docs.select(key.alias("doc_id"), text.alias("text")).where("text is not null").dropDuplicates(["doc_id"])
    bad = (find_contamination(texts, items, window, coverage_parts, block_bytes)
           .where("contaminated").select(F.col("doc_id").alias("_key")))
    return docs.withColumn("_key", key).join(bad, "_key", "left_anti").select(*docs.columns)


def _dropper(sent, coverage_parts: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = []
            for raw in raw_texts(batch):
                n, spans, _ = sent.value.scan(raw)
                hit = sum(b - a for a, b in spans)
                stays.append(not (hit and coverage_parts * hit >= n))
            yield batch.filter(pa.array(stays, pa.bool_()))

    return drop


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """*text* without the words of *spans* and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """*docs* (doc_id, text) with every hit span of words removed from the text, as ``clean_text``.

    This is the length limit alone: a span of ``window`` words or a whole shorter item
    goes, whatever its share of the document. Items must fit one block.
    """
    blocks = _blocks(items, window, BLOCK_BYTES)
    if len(blocks) > 1:
        raise ValueError(f"items of more than {BLOCK_BYTES} bytes: cut them in several calls")
    sent = docs.sparkSession.sparkContext.broadcast(blocks[0])
    schema = StructType([docs.schema["doc_id"], StructField("n_cut", IntegerType()), StructField("clean_text", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, texts = [], []
            for raw in raw_texts(batch):
                spans = sent.value.scan(raw)[1]
                counts.append(len(spans))
                texts.append(None if raw is None else cut_spans(raw.decode(), spans))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_cut": pa.array(counts, pa.int32()),
                                              "clean_text": pa.array(texts, pa.string())})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)
