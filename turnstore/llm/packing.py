"""Best-fit packing of documents into sequences by linear grouping.

Lengths are at most the capacity, so their histogram is small whatever the corpus. The
plan is made on it: large lengths are cut into groups of equal cardinality and rounded
up to the largest of their group; the few rounded sizes are filled into configurations
that leave least room; actual documents replace the rounded ones; the small ones, in
falling length, go where they fit best. The plan is a list of runs (so many documents
of one length from a given rank on go to consecutive sequences), so its size follows
the number of lengths and not of documents. Documents find their run by the rank they
have among those of equal length.
"""

from __future__ import annotations

import bisect
import gc
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from turnstore.llm.words import raw_texts, spaced_words
from turnstore.runtime import cut_lineage

CAPACITY = 4096
END_ID = 1
# Lengths above this share of the capacity are large; they are rounded in so many groups.
LARGE_PARTS = 6
GROUPS = 12
# Words whose ids a task remembers.
CACHE_WORDS = 500_000
# Rows of one bucket when documents of a length are ranked.
BUCKET_ROWS = 50_000


# Words whose splitting is plain: ASCII without apostrophes, and the Latin-1 letters.
_SIMPLE = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write Latin-1 letters: a printable character per UTF-8 byte.

    Bytes that are not printable in Latin-1 are numbered on from 256, in order.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    names = [chr(b) if b in printable else chr(next(extra)) for b in range(256)]
    return {code: "".join(names[b] for b in chr(code).encode()) for code in range(192, 256)}


class Encoder(dict):
    """Ids of words, from a vocabulary file, as little-endian unsigned 32-bit integers.

    The vocabulary's patterns never join characters across ASCII white space, so words
    between it are encoded once and remembered, up to a bound. It is lower case; texts
    that may hold a special token are not lowered before.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}

    def encode(self, raw: bytes) -> bytes:
        """The ids of a text, word by word; long texts in pieces that end at white space."""
        if b"<|" not in raw:
            raw = raw.lower()
        return b"".join([ids for words in spaced_words(raw) for ids in map(self.__getitem__, words)])

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        word = raw.decode()
        if _SIMPLE.fullmatch(word) and "<|" not in word:
            ids = b"".join([self.runs.get(run) or self._run(run) for run in _RUNS.findall(word.lower())])
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        self[raw] = ids
        return ids

    def _run(self, run: str) -> bytes:
        if len(self.runs) >= CACHE_WORDS:
            self.runs.clear()
        tokens = self.merge(run if run.isascii() else run.translate(self.letters))
        ids = self.runs[run] = array("I", [t.id for t in tokens]).tobytes()
        return ids


_PIECES = [StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()),
           StructField("ids_crc32", LongType())]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of a document (doc_id, text): doc_id, piece, start, length, ids_crc32.

    A document is its ids and the end id; only longer ones are cut, into full pieces
    and a last one. A null text is an empty one: the end id alone.
    """
    end = array("I", [END_ID]).tobytes()

    def pieces(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        for place, raw in enumerate(raw_texts(batch)):
            whole = encoder.encode(raw or b"") + end
            for piece, start in enumerate(range(0, len(whole) // 4, capacity)):
                own = whole[4 * start:4 * (start + capacity)]
                rows.append((place, piece, start, len(own) // 4, zlib.crc32(own)))
        columns = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
            "piece": pa.array(columns[1], pa.int32()), "start": pa.array(columns[2], pa.int64()),
            "length": pa.array(columns[3], pa.int64()), "ids_crc32": pa.array(columns[4], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        # Hundreds of thousands of remembered words, none in a cycle; the worker lives on after this task.
        gc.disable()
        try:
            for batch in batches:
                yield pieces(encoder, batch)
        finally:
            gc.enable()

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, StructType([docs.schema["doc_id"], *_PIECES]))


@dataclass
class Run:
    """*count* documents of *length* from *rank* on: *each* per sequence, from *sequence* and *offset* on."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


@dataclass
class Planner:
    """Packs a histogram of lengths; bins that look alike are kept as one entry."""

    counts: dict[int, int]
    capacity: int = CAPACITY
    runs: list[Run] = field(default_factory=list)
    bins: int = 0

    def __post_init__(self):
        self.used = dict.fromkeys(self.counts, 0)
        # Free room -> [(first bin, number of bins)]; the sorted list of rooms.
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def plan(self) -> list[Run]:
        large = self._large()
        while configuration := self._fullest(large):
            self._substitute(configuration, large)
        for length in sorted((x for x in self.counts if self.counts[x] > self.used[x]), reverse=True):
            self._best_fit(length)
        return self.runs

    def _large(self) -> list[list[list[int]]]:
        """Groups of equal cardinality, largest lengths first, as lists of [length, left]."""
        lengths = sorted((x for x in self.counts if x * LARGE_PARTS > self.capacity), reverse=True)
        total = sum(self.counts[x] for x in lengths)
        size = max(1, -(-total // GROUPS))
        groups: list[list[list[int]]] = [[]]
        room = size
        for length in lengths:
            left = self.counts[length]
            while left:
                if not room:
                    groups.append([])
                    room = size
                taken = min(left, room)
                groups[-1].append([length, taken])
                left, room = left - taken, room - taken
        return [g for g in groups if g]

    def _fullest(self, groups: list[list[list[int]]]) -> list[int] | None:
        """The multiset of rounded sizes that fills a sequence best, as counts per group.

        Every configuration holds one of the largest size left, so that none of the
        large documents, which are the hardest to place, remains for the end.
        """
        left = [sum(n for _, n in g) for g in groups]
        first = next((i for i, n in enumerate(left) if n), None)
        if first is None:
            return None
        sizes = [g[0][0] if g else 0 for g in groups]
        best: tuple[int, list[int]] = (self.capacity + 1, [])
        counts = [0] * len(groups)

        def fill(at: int, room: int) -> None:
            nonlocal best
            if room < best[0]:
                best = (room, counts.copy())
            for i in range(at, len(groups)):
                if sizes[i] and sizes[i] <= room and counts[i] < left[i]:
                    counts[i] += 1
                    fill(i, room - sizes[i])
                    counts[i] -= 1

        counts[first] = 1
        fill(first, self.capacity - sizes[first])
        return best[1]

    def _substitute(self, configuration: list[int], groups: list[list[list[int]]]) -> None:
        """As many sequences of a configuration as its groups allow, with actual lengths."""
        slots = [i for i, n in enumerate(configuration) for _ in range(n)]
        left = [sum(n for _, n in g) for g in groups]
        times = min(left[i] // n for i, n in enumerate(configuration) if n)
        # A group's rounded size falls as its largest documents go: choose anew then.
        for i, n in enumerate(configuration):
            if n:
                times = min(times, max(1, groups[i][0][1] // n))
        entries = [(self.bins, times, 0)]
        for i in slots:
            made = []
            for first, many, used in entries:
                while many:
                    length, there = groups[i][0]
                    taken = min(many, there)
                    self._take(length, taken, first, 1, used)
                    made.append((first, taken, used + length))
                    groups[i][0][1] -= taken
                    if not groups[i][0][1]:
                        groups[i].pop(0)
                    first, many = first + taken, many - taken
            entries = made
        for first, many, used in entries:
            self._free(self.capacity - used, first, many)
        self.bins += times

    def _best_fit(self, length: int) -> None:
        """Documents of one length, each into the sequence with least sufficient room."""
        left = self.counts[length] - self.used[length]
        while left:
            at = bisect.bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, many = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room]
                    self.rooms.pop(at)
            else:
                room, first = self.capacity, self.bins
                many = -(-left // (self.capacity // length))
                self.bins += many
            each = room // length
            full = min(many, left // each)
            if full:
                self._take(length, full * each, first, each, self.capacity - room)
                self._free(room - each * length, first, full)
                left -= full * each
            if full < many:
                if left:
                    self._take(length, left, first + full, left, self.capacity - room)
                    self._free(room - left * length, first + full, 1)
                    full += 1
                    left = 0
                self._free(room, first + full, many - full)

    def _take(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, self.used[length], count, sequence, each, offset))
        self.used[length] += count

    def _free(self, room: int, first: int, many: int) -> None:
        if room and many:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((first, many))


def pack_lengths(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """*pieces* (doc_id, piece, length, ids_crc32, ...) with sequence_id and offset.

    Lengths are 1 to *capacity*. Pieces of one length are ranked in buckets of a hash
    with the counts of the buckets before them, so no length meets in one task; pieces
    equal in everything may change places. No pieces, no sequences.
    """
    pieces = cut_lineage(pieces)
    n = pieces.count()
    buckets = max(1, n // bucket_rows)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = cut_lineage(sums.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = Planner(counts, capacity).plan()
    spark = pieces.sparkSession
    # One row per length with its runs; both numbers follow the capacity, not the corpus.
    by_length: dict[int, list[tuple]] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append((r.rank, r.count, r.sequence, r.each, r.offset))
    table = spark.createDataFrame(
        [(k, v) for k, v in by_length.items()],
        "length long, _runs array<struct<rank:long,count:long,sequence:long,each:long,offset:long>>")
    order = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_place", F.row_number().over(order) - 1).join(sums.drop("_n"), ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_place") + F.col("_before")).join(F.broadcast(table), "length")
    own = F.filter("_runs", lambda r: (r["rank"] <= F.col("_rank")) & (F.col("_rank") < r["rank"] + r["count"]))[0]
    found = ranked.withColumn("_run", own)
    beyond = F.col("_rank") - F.col("_run.rank")
    each = F.col("_run.each")
    return found.select(
        *pieces.columns,
        (F.col("_run.sequence") + F.floor(beyond / each)).cast("long").alias("sequence_id"),
        (F.col("_run.offset") + (beyond % each) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of *docs* (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_lengths(cut_pieces(docs, tokenizer_path, capacity), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
