"""Repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of L bytes that covers it starts anywhere else as well, that is if
the suffix at the start of that string shares its first L bytes with another one. Suffixes
are sorted bucket by bucket, and neighbours in the order are compared. Inside a bucket
suffixes are ordered by their first bytes. Ties are settled by ranks of a difference cover:
of any two suffixes some common offset below the cover's period leads to two sampled
positions, whose ranks were computed before, so no comparison is longer than a period.

Buckets have to hold every suffix with the same first L bytes and must not hold the whole
corpus. Among the hashes of all K-byte strings of the L bytes the least one, the anchor,
names the bucket. Neighbouring suffixes mostly have the same anchor: they are one run, kept
as one string. Only runs whose anchor occurs again are ever sent, equal runs once with their
number. An anchor with a single run has nothing to sort. Anchors that very many different
runs hold are taken apart into buckets of one suffix's first L bytes each.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from turnstore.llm.words import mix, raw_texts
from turnstore.runtime import cut_lineage

# Length of a string whose repetition removes it.
MIN_BYTES = 200
# Length of the strings among which anchors are chosen, a power of two.
ANCHOR_BYTES = 32
# A perfect difference set: every difference modulo PERIOD is one of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
# Text that is hashed at once, and text whose suffixes are sorted at once.
PIECE_BYTES, BLOCK_BYTES = 1 << 18, 1 << 22
# Most classes of a tie that are all compared with each other.
ALL_PAIRS = 64
# Most different runs of an anchor that are sorted in one task.
MOST_RUNS = 8192
# Most bits of the filter that tells a scan which runs are wanted, and bits per run. If more
# runs are wanted than it holds, texts meet them in a shuffle instead.
FILTER_BITS, BITS_PER_RUN, PROBES = 1 << 29, 16, 3
_SEGMENT_BITS = 1 << 20
_PLACE_BITS = 20

_U = np.uint64
_RND = np.random.default_rng(2)
_BYTE_HASHES = _RND.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_LEVELS = _RND.integers(0, 1 << 63, 8, dtype=_U) * _U(2) + _U(1)


class Runs:
    """Runs of the texts of a batch: arrays ``text`` (its place), ``start``, ``size`` (suffixes), ``anchor``, its offset ``at``, ``run``."""

    def __init__(self, raws: list[bytes | None], min_bytes: int = MIN_BYTES):
        self.raws, self.min_bytes = raws, min_bytes
        parts = [self._of(places, starts, pieces) for places, starts, pieces in self._pieces()]
        columns = list(zip(*parts)) or [[]] * 5
        self.text, self.start, self.size, self.at = (np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64) for c in columns[:4])
        self.anchor = np.concatenate([*columns[4], np.empty(0, _U)]).view(np.int64)
        digest, rest = xxhash.xxh3_64_intdigest, min_bytes - 1
        self.run = np.fromiter((digest(raws[t][s:s + n + rest]) for t, s, n in zip(
            self.text.tolist(), self.start.tolist(), self.size.tolist())), _U, len(self.text)).view(np.int64)

    def _pieces(self) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Stretches (text, start, bytes) of bounded total size; those of one text overlap so that no suffix is lost."""
        places, starts, pieces, held = [], [], [], 0
        for place, raw in enumerate(self.raws):
            for start in range(0, len(raw or b"") - self.min_bytes + 1, PIECE_BYTES):
                piece = raw[start:start + PIECE_BYTES + self.min_bytes - 1]
                places.append(place)
                starts.append(start)
                pieces.append(piece)
                held += len(piece)
                if held >= PIECE_BYTES:
                    yield places, starts, pieces
                    places, starts, pieces, held = [], [], [], 0
        if pieces:
            yield places, starts, pieces

    def _of(self, places: list[int], starts: list[int], pieces: list[bytes]):
        window = self.min_bytes - ANCHOR_BYTES + 1
        h = _BYTE_HASHES[np.frombuffer(b"".join(pieces), np.uint8)]
        size, level = 1, 0
        while size < ANCHOR_BYTES:
            h = h[:-size] * _LEVELS[level] + h[size:]
            h ^= h >> _U(29)
            size, level = 2 * size, level + 1
        h = mix(h)
        # The place in the low bits: the least hash of a window also tells its place, the leftmost of equal ones.
        places_ = _U((1 << _PLACE_BITS) - 1)
        least, width = (h & ~places_) | np.arange(len(h), dtype=_U), 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(h) - window + 1
        chosen = (np.minimum(least[:n], least[window - width:][:n]) & places_).astype(np.int64)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        first = ends - lengths
        fits = np.zeros(n + 1, np.int32)
        np.add.at(fits, first, 1)
        np.add.at(fits, ends - self.min_bytes + 1, -1)
        fits = np.cumsum(fits[:-1]).astype(bool)
        begins = np.empty(n, bool)
        begins[0] = True
        begins[1:] = chosen[1:] != chosen[:-1]
        begins[first] = True
        at = np.flatnonzero(begins & fits)
        piece = np.searchsorted(first, at, "right") - 1
        until = np.minimum(np.append(at[1:], n), ends[piece] - self.min_bytes + 1)
        return np.array(places)[piece], at - first[piece] + np.array(starts)[piece], until - at, chosen[at] - at, h[chosen[at]]

    def content(self, i: int) -> bytes:
        raw, start = self.raws[self.text[i]], int(self.start[i])
        return raw[start:start + int(self.size[i]) + self.min_bytes - 1]


def repeated_suffixes(bucket: np.ndarray, contents: list[bytes], times: np.ndarray, min_bytes: int = MIN_BYTES,
                      at: np.ndarray | int = 0) -> list[np.ndarray]:
    """For each run (a string, how often it occurs, its bucket): which of its suffixes share their first bytes with another.

    The suffixes of a run start at its first bytes and end within it; runs of one bucket are
    compared with each other, each suffix counting as often as its run occurs. *at* is where
    each run holds the anchor.
    """
    sizes = np.array([len(c) for c in contents])
    # Anchors lie on multiples of the period, so that equal suffixes have equal residues.
    shift = -np.asarray(at) % PERIOD
    room = -(-(sizes + shift) // PERIOD) * PERIOD
    first = np.cumsum(room) - room + shift
    n_suffixes = sizes - min_bytes + 1
    rows = int(room.sum()) // PERIOD
    depth_rows = -(-min_bytes // PERIOD) + 2
    text = np.zeros((rows + 2 * depth_rows) * PERIOD + 64, np.uint8)
    for at, content in zip(first.tolist(), contents):
        text[at:at + len(content)] = np.frombuffer(content, np.uint8)
    word = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    rank = _cover_ranks(word, rows + depth_rows, min_bytes)
    owner = np.repeat(np.arange(len(contents)), n_suffixes)
    place = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n_suffixes) - n_suffixes, n_suffixes)
    heads = [word[place + 8 * i].astype(_U) for i in range(4)]
    residue = place % PERIOD
    following = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    settled = _rank_at(rank, place + following[residue])
    order = np.lexsort((settled, residue, *heads[::-1], bucket[owner]))
    same = np.ones(max(0, len(order) - 1), bool)
    for key in (bucket[owner], *heads):
        sorted_key = key[order]
        same &= sorted_key[1:] == sorted_key[:-1]
    _settle_mixed(order, same, place, residue, settled, rank)
    # Neighbours that agree on the first words: compare the rest of the first min_bytes.
    left, right = place[order[:-1]], place[order[1:]]
    equal = np.flatnonzero(same)
    for offset in [*range(32, min_bytes - 8, 8), min_bytes - 8]:
        equal = equal[word[left[equal] + offset] == word[right[equal] + offset]]
    joined = np.zeros(len(order), bool)
    joined[equal + 1] = True
    group = np.cumsum(~joined) - 1
    total = np.bincount(group, times[owner[order]])
    found = np.empty(len(order), bool)
    found[order] = total[group] >= 2
    return np.split(found, np.cumsum(n_suffixes)[:-1])


def _cover_ranks(word: np.ndarray, rows: int, min_bytes: int) -> np.ndarray:
    """Rank of every sampled position by its next bytes (at least *min_bytes*), as a table (row, member of the cover).

    Positions of one column are a period apart, so a rank over twice the length is made of two ranks.
    """
    at = np.arange(rows)[:, None] * PERIOD + np.array(COVER)
    keys = [word[at + 8 * i].astype(_U).ravel() for i in range(4)]
    known, shift = 32, 1
    rank = _dense(keys)
    while known < min_bytes:
        table = rank.reshape(rows, len(COVER))
        later = np.vstack([table[shift:], np.zeros((shift, len(COVER)), table.dtype)])
        rank = _dense([rank, later.ravel()])
        known += PERIOD * shift
        shift *= 2
    return rank.reshape(rows, len(COVER))


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


_COLUMN = np.full(PERIOD, -1)
_COLUMN[list(COVER)] = np.arange(len(COVER))


def _rank_at(rank: np.ndarray, positions):
    return rank[positions // PERIOD, _COLUMN[positions % PERIOD]]


def _common_offsets() -> np.ndarray:
    """For two residues, the least offset that leads both into the cover."""
    cover = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    ahead = np.stack([cover[r:r + PERIOD] for r in range(PERIOD)])
    return np.argmax(ahead[:, None, :] & ahead[None, :, :], axis=2)


_OFFSET = _common_offsets()


def _before(x: np.ndarray, y: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sign of the order of the suffixes at places *x* and *y*, which tie on a period: by their ranks at a common offset."""
    k = _OFFSET[x % PERIOD, y % PERIOD]
    return np.sign(_rank_at(rank, x + k) - _rank_at(rank, y + k))


def _settle_mixed(order: np.ndarray, same: np.ndarray, place: np.ndarray, residue: np.ndarray, settled: np.ndarray,
                  rank: np.ndarray) -> None:
    """Put ties of different residues in order, in place.

    Suffixes with equal residue and rank are one class, already together. A class goes
    behind those classes of its tie that are before it; ties of many classes are sorted
    by comparison instead of counting all pairs.
    """
    mixed = same & (residue[order[1:]] != residue[order[:-1]])
    if not mixed.any():
        return
    tie = np.cumsum(np.concatenate(([False], ~same)))
    at = np.flatnonzero(np.isin(tie, tie[1:][mixed]))
    members, tie = order[at], tie[at]
    begins = np.ones(len(at), bool)
    for key in (tie, residue[members], settled[members]):
        begins[1:] &= key[1:] == key[:-1]
    begins[1:] = ~begins[1:]
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(at)))
    head, of = place[members[first]], tie[first]
    lowest = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    n_classes = np.diff(np.append(lowest, len(of)))
    low, count = np.repeat(lowest, n_classes), np.repeat(n_classes, n_classes)
    behind = np.zeros(len(first), np.int64)
    few = np.flatnonzero(count <= ALL_PAIRS)
    x = np.repeat(few, count[few])
    y = low[x] + np.arange(len(x)) - np.repeat(np.cumsum(count[few]) - count[few], count[few])
    sign = _before(head[y], head[x], rank)
    np.add.at(behind, x, (sign < 0) | ((sign == 0) & (y < x)))
    compare = functools.cmp_to_key(lambda i, j: int(_before(head[i:i + 1], head[j:j + 1], rank)[0]) or i - j)
    for group in np.flatnonzero(n_classes > ALL_PAIRS):
        own = range(lowest[group], lowest[group] + n_classes[group])
        behind[sorted(own, key=compare)] = np.arange(n_classes[group])
    arranged = np.lexsort((behind, of))
    ends = np.cumsum(size[arranged])
    order[at] = members[np.repeat(first[arranged] - (ends - size[arranged]), size[arranged]) + np.arange(len(at))]


def _probes(anchor: np.ndarray, run: np.ndarray, key: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of (anchor, run, key) in a filter of *bits* (a power of two) bits."""
    base = mix(anchor.view(_U) + mix(run.view(_U) + mix(key.view(_U))))
    step = mix(base) | _U(1)
    return [((base + _U(i) * step) & _U(bits - 1)).astype(np.int64) for i in range(PROBES)]


def _filter_of(wanted: DataFrame, bits: int) -> np.ndarray:
    """The filter that holds all (anchor, run, key) of *wanted*, put together by segments in tasks."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _probes(*(b.column(c).to_numpy() for c in ("anchor", "run", "key")), bits):
                yield pa.RecordBatch.from_pydict({"segment": pa.array(at // _SEGMENT_BITS), "at": pa.array(at % _SEGMENT_BITS)})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, np.ndarray] = {}
        for b in batches:
            segments, at = b.column("segment").to_numpy(), b.column("at").to_numpy()
            for s in np.unique(segments).tolist():
                marks.setdefault(s, np.zeros(min(bits, _SEGMENT_BITS), bool))[at[segments == s]] = True
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(marks), pa.int64()),
                                          "marks": pa.array([np.packbits(m).tobytes() for m in marks.values()], pa.binary())})

    rows = (wanted.mapInArrow(places, "segment long, at long").repartition("segment")
            .mapInArrow(packed, "segment long, marks binary").toArrow())
    whole = np.zeros(bits // 8, np.uint8)
    width = min(bits, _SEGMENT_BITS) // 8
    for segment, marks in zip(rows.column("segment").to_pylist(), rows.column("marks").to_pylist()):
        whole[segment * width:(segment + 1) * width] = np.frombuffer(marks, np.uint8)
    return whole


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the hash of their text, which only brings results back: runs are looked up in the text itself."""
    return docs.where(F.octet_length("text") >= F.lit(1)).select(F.xxhash64("text").alias("key"), "text")


def _all_runs(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(anchor, run, key, n): the distinct runs of each row's text, and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for low, raws in _bounded(raw_texts(batch)):
                r = Runs(raws, min_bytes)
                table = np.stack([r.text, r.anchor, r.run])
                order = np.lexsort(table[::-1])
                table = table[:, order]
                begins = np.flatnonzero(np.concatenate(([True], (table[:, 1:] != table[:, :-1]).any(axis=0)))[:table.shape[1]])
                n = np.diff(np.append(begins, table.shape[1]))
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(table[1, begins]), "run": pa.array(table[2, begins]),
                    "key": pa.array(keys[low + table[0, begins]]), "n": pa.array(n.astype(np.int64))})

    return _keyed(docs).mapInArrow(run, "anchor long, run long, key long, n long")


def _bounded(raws: list[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    """*raws* in sets of bounded size, each with the place of its first one."""
    low = held = 0
    for i, raw in enumerate(raws):
        held += len(raw or b"")
        if held > BLOCK_BYTES:
            yield low, raws[low:i + 1]
            low, held = i + 1, 0
    if low < len(raws):
        yield low, raws[low:]


_CONTENT = "anchor long, run long, offset int, content binary"


def _give_out(runs: Runs, chosen: Iterable[int], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Chosen runs: their string (with -1 - the anchor's place in it), or, for a hot anchor, each suffix's offset and the digest of its first bytes."""
    anchors, digests, offsets, contents, held = [], [], [], [], 0
    for i in chosen:
        content, anchor, run = runs.content(i), runs.anchor[i], runs.run[i]
        if len(hot) and hot[min(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor:
            n = len(content) - runs.min_bytes + 1
            some = [xxhash.xxh3_128_digest(content[o:o + runs.min_bytes]) for o in range(n)]
            at = range(n)
        else:
            some, at = [content], [-1 - runs.at[i]]
        anchors += [anchor] * len(some)
        digests += [run] * len(some)
        offsets += at
        contents += some
        held += len(content) + 16 * len(some)
        if held > BLOCK_BYTES:
            yield _content_batch(anchors, digests, offsets, contents)
            anchors, digests, offsets, contents, held = [], [], [], [], 0
    yield _content_batch(anchors, digests, offsets, contents)


def _content_batch(anchors, digests, offsets, contents) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"anchor": pa.array(anchors, pa.int64()), "run": pa.array(digests, pa.int64()),
                                       "offset": pa.array(offsets, pa.int32()), "content": pa.array(contents, pa.binary())})


def _contents(docs: DataFrame, wanted: DataFrame, hot: np.ndarray, min_bytes: int, filter_bits: int) -> DataFrame:
    """Rows of :data:`_CONTENT` for the runs of *wanted* (anchor, run, key); a few others and repeated rows may be among them."""
    spark = docs.sparkSession
    bits = 1 << max(14, (wanted.count() * BITS_PER_RUN - 1).bit_length())
    if bits <= filter_bits:
        marks = spark.sparkContext.broadcast(_filter_of(wanted, bits))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column("key").to_numpy()
                for low, raws in _bounded(raw_texts(batch)):
                    r = Runs(raws, min_bytes)
                    chosen = np.ones(len(r.text), bool)
                    for at in _probes(r.anchor, r.run, keys[low + r.text], bits):
                        chosen &= (marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                    yield from _give_out(r, np.flatnonzero(chosen), hot)

        return _keyed(docs).mapInArrow(scan, _CONTENT)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, runs in zip(raw_texts(batch), batch.column("runs").to_pylist()):
                r = Runs([raw], min_bytes)
                asked = {(x["anchor"], x["run"]) for x in runs}
                yield from _give_out(r, [i for i, x in enumerate(zip(r.anchor.tolist(), r.run.tolist())) if x in asked], hot)

    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "run")).alias("runs"))
    return _keyed(docs).dropDuplicates(["key", "text"]).join(lists, "key").select("text", "runs").mapInArrow(look, _CONTENT)


_MARKED = "anchor long, run long, marks binary"


def _sorted_buckets(contents: DataFrame, several: DataFrame, min_bytes: int, block_bytes: int) -> DataFrame:
    """(anchor, run, marks) for runs of anchors that are sorted whole: one bit per suffix that is repeated."""
    counts = several.select("anchor", "run", "n", F.lit(None).cast("int").alias("offset"), F.lit(None).cast("binary").alias("content"))
    strings = contents.where("offset < 0").select("anchor", "run", F.lit(None).cast("long").alias("n"), "offset", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, anchor, current, n = [], 0, None, None, None
        for batch in batches:
            for a, r, times, at, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "run", "n", "offset", "content"))):
                if a != anchor:
                    if held > block_bytes:
                        yield _marks(block, min_bytes)
                        block, held = [], 0
                    anchor = a
                if times is not None:
                    current, n = (a, r), times
                elif current == (a, r) and n is not None:
                    # The first string of a wanted run; copies and runs that are not wanted pass by.
                    block.append((a, r, n, -1 - at, content))
                    held += len(content)
                    n = None
        if block:
            yield _marks(block, min_bytes)

    rows = counts.unionByName(strings).repartition("anchor").sortWithinPartitions("anchor", "run", F.col("n").asc_nulls_last())
    return rows.mapInArrow(run, _MARKED)


def _marks(block: list[tuple], min_bytes: int) -> pa.RecordBatch:
    anchors, runs, times, at, contents = zip(*block)
    found = repeated_suffixes(np.array(anchors), list(contents), np.array(times), min_bytes, np.array(at))
    return pa.RecordBatch.from_pydict({"anchor": pa.array(anchors, pa.int64()), "run": pa.array(runs, pa.int64()),
                                       "marks": pa.array([np.packbits(f).tobytes() for f in found], pa.binary())})


def _hot_buckets(contents: DataFrame, several: DataFrame) -> DataFrame:
    """(anchor, run, marks) for runs of hot anchors, one bucket for each string of the first bytes."""
    rows = (contents.where("offset >= 0").dropDuplicates(["anchor", "run", "offset"])
            .join(several.select("anchor", "run", "n"), ["anchor", "run"]))
    repeated = rows.groupBy("content").agg(F.sum("n").alias("_n")).where("_n >= 2").select("content")
    found = rows.join(repeated, "content", "left_semi").groupBy("anchor", "run").agg(F.collect_list("offset").alias("offsets"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for offsets in b.column("offsets").to_pylist():
                bits = np.zeros(max(offsets) + 1, bool)
                bits[offsets] = True
                marks.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_pydict({"anchor": b.column("anchor"), "run": b.column("run"), "marks": pa.array(marks, pa.binary())})

    return found.mapInArrow(pack, _MARKED)


def repeated_runs(docs: DataFrame, min_bytes: int = MIN_BYTES, most_runs: int = MOST_RUNS,
                  filter_bits: int = FILTER_BITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, runs): for the hash of each text with repeated suffixes, its runs (anchor, run, marks) that hold some.

    ``marks`` has a bit per suffix; null stands for all of them.
    """
    if min_bytes < ANCHOR_BYTES + 8:
        raise ValueError(f"min_bytes must be at least {ANCHOR_BYTES + 8}")
    rows = _all_runs(docs, min_bytes)
    again = rows.groupBy("anchor").agg(F.sum("n").alias("_n")).where("_n >= 2").select("anchor")
    rows = cut_lineage(rows.join(again, "anchor"))
    runs = cut_lineage(rows.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.min("key").alias("key")))
    n_runs = runs.groupBy("anchor").agg(F.count("*").alias("n_runs"))
    several = cut_lineage(runs.join(n_runs.where("n_runs > 1"), "anchor"))
    hot = n_runs.where(F.col("n_runs") > most_runs).select("anchor").toArrow().column("anchor").to_numpy()
    contents = cut_lineage(_contents(docs, several.select("anchor", "run", "key"), np.sort(hot), min_bytes, filter_bits))
    alone = runs.join(n_runs.where("n_runs = 1"), "anchor").select("anchor", "run", F.lit(None).cast("binary").alias("marks"))
    marked = (_sorted_buckets(contents, several.where(F.col("n_runs") <= most_runs), min_bytes, block_bytes)
              .unionByName(_hot_buckets(contents, several.where(F.col("n_runs") > most_runs)))
              # Runs without a repeated suffix have nothing to say.
              .where(F.ltrim(F.hex("marks"), F.lit("0")) != ""))
    found = cut_lineage(alone.unionByName(marked))
    return (rows.select("anchor", "run", "key").join(found, ["anchor", "run"]).groupBy("key")
            .agg(F.collect_set(F.struct("anchor", "run", "marks")).alias("runs")))


def _spans(runs: Runs, own: range, marks: dict[tuple[int, int], bytes | None]) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal stretches of a text (the runs *own*) that repeated strings cover."""
    starts, min_bytes = [], runs.min_bytes
    low, high = own.start, own.stop
    for key, start, size in zip(zip(runs.anchor[low:high].tolist(), runs.run[low:high].tolist()),
                                runs.start[low:high].tolist(), runs.size[low:high].tolist()):
        if key in marks:
            bits = marks[key]
            if bits is None:
                # Suffixes in a row, no further apart than a string is long: the ends tell all.
                starts.append(np.array([*range(start, start + size - 1, min_bytes), start + size - 1]))
            else:
                starts.append(start + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[:size]))
    if not starts:
        return [], []
    at = np.concatenate(starts)
    at.sort()
    begins = np.concatenate(([True], at[1:] > at[:-1] + min_bytes))
    ends = np.append(at[:-1][begins[1:]], at[-1]) + min_bytes
    return at[begins].tolist(), ends.tolist()


_FOUND = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])


def find_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, with_kept: bool = False, **limits) -> DataFrame:
    """Per row of *docs* (doc_id, text): n_bytes, n_removed, removed spans, and the digest (or the bytes) of what stays.

    Every byte goes that is covered by a string of *min_bytes* bytes which also starts anywhere
    else in the table, in the same text or another; rows with equal texts are copies of each
    other whatever their ids. Strings are judged on the input and never reach across rows. Null
    and empty texts, and those shorter than *min_bytes*, lose nothing. Offsets are bytes of
    UTF-8, end exclusive. Other columns are ignored; an empty table gives an empty one.
    *limits*: see :func:`repeated_runs`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_runs(rows, min_bytes, **limits)
    joined = rows.withColumn("key", F.xxhash64("text")).join(found, "key", "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept, digests = [], [], [], [], []
            lists = batch.column("runs")
            n_found = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            first = np.cumsum(n_found) - n_found
            flat = lists.flatten()
            found = list(zip(flat.field("anchor").to_pylist(), flat.field("run").to_pylist()))
            marks = flat.field("marks").to_pylist()
            for low, raws in _bounded(raw_texts(batch)):
                runs = Runs([raw if n_found[low + i] else None for i, raw in enumerate(raws)], min_bytes)
                bounds = np.searchsorted(runs.text, np.arange(len(raws) + 1)).tolist()
                for i, raw in enumerate(raws):
                    at, n = first[low + i], n_found[low + i]
                    known = dict(zip(found[at:at + n], marks[at:at + n]))
                    starts, ends = _spans(runs, range(bounds[i], bounds[i + 1]), known) if known else ([], [])
                    raw = raw or b""
                    view, past, digest, parts = memoryview(raw), 0, hashlib.sha256(), []
                    for start, end in zip([*starts, len(raw)], [*ends, len(raw)]):
                        digest.update(view[past:start])
                        if with_kept:
                            parts.append(view[past:start])
                        past = end
                    sizes.append(len(raw))
                    removed.append(sum(ends) - sum(starts))
                    spans.append([{"start": s, "end": e} for s, e in zip(starts, ends)])
                    kept.append(b"".join(parts) if with_kept else None)
                    digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                pa.array(kept, pa.binary()), pa.array(digests, pa.string())], _FOUND.fieldNames())

    return joined.mapInArrow(run, _FOUND)
