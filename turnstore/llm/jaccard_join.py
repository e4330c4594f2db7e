"""Exact n-gram Jaccard join by parity sketches.

A document's distinct shingles are hashed. Within a size band the hash space is cut
into P parts, and the shingles of a part are XORed into one word of the sketch: one
shingle changes one word only, so at most |A ^ B| words of two sketches differ. Sets
with Jaccard similarity t have |A ^ B| <= (|A| + |B|) (1 - t) / (1 + t) = d, so at
least P - d words agree (pigeonhole). Words are ordered, frequent and empty ones
last; two documents that share P - d of P words then share one of their first d + 1,
and only these are joined. A second sketch holds one bit per shingle parity; its
Hamming distance bounds |A ^ B| from below as well and discards chance pairs before
the sets are compared exactly.

Groups of copies are never paired with each other: equal sets are one node, a word's
holders are first compared with the least of them only, and a second pass compares
holders of a word that are still in different components. Documents that share a
frequent passage are not paired by it: if more than (1 - t) / (1 + t) of both sets is
rare, linked sets share a rare shingle (else |A ^ B| > d). A set with fewer than d + 1
words of rare shingles therefore also offers each of them as a key, and frequent words
pair only where one side is almost wholly frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StructField, StructType)

from turnstore.llm.components import components
from turnstore.llm.words import WordHashes, list_array, mix, raw_texts, shingle_hashes, spaced_words
from turnstore.runtime import cut_lineage

# Similarity of two linked documents, in hundredths.
SIMILARITY = 80
# Share of the documents whose shingles are counted to learn which are frequent, and the
# least number of them. Only the order of words follows from the counts, and so the
# time; any order gives the same links.
SAMPLE_SHARE, SAMPLE_ROWS = 0.05, 2_000
# A shingle is frequent if so many documents of the sample hold it; most shingles that
# are sent to every task.
FREQUENT, MOST_FREQUENT = 3, 1 << 20
# Holders of a frequent word that are compared with each other at once.
BLOCK_ROWS = 1_000
# Most holders of an unmarked word that are joined with each other as rows.
FEW_HOLDERS = 64
# Nodes whose ids may be sent to every task.
BROADCAST_NODES = 500_000

_U = np.uint64
_SLOTS = 1 << 24
_LAST = _U(1 << 63)
_EMPTY = _U(3 << 62)


class Sketcher:
    """Sets, sketches and join keys of texts, for one similarity and one table of frequent shingles."""

    def __init__(self, similarity: int = SIMILARITY, frequent: np.ndarray | None = None):
        self.similarity = similarity
        self.frequent = frequent

    def shingles(self, raw: bytes | None, hashes: WordHashes) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        return np.unique(shingle_hashes(hashes.of(spaced_words((raw or b"").lower()))))

    def difference(self, size: int) -> int:
        """Most shingles in which a linked document can differ from one of *size*.

        The largest partner has size / t shingles, all of them or these and no others.
        """
        return (size * 100) // self.similarity - size

    @staticmethod
    def band(size: int) -> int:
        return (size.bit_length() - 1) // 2

    def is_frequent(self, found: np.ndarray) -> np.ndarray:
        if self.frequent is None:
            return np.zeros(len(found), bool)
        return self.frequent[(found & _U(_SLOTS - 1)).astype(np.int64)]

    def keys(self, found: np.ndarray) -> np.ndarray:
        """Join keys of a set: in its own size band, and in the next if a partner can be there."""
        size = len(found)
        largest = (size * 100) // self.similarity
        known = self.is_frequent(found)
        made = [self._first_words(found, known, b) for b in range(self.band(size), self.band(largest) + 1)]
        if any(len(keys) and keys[-1] >= _LAST for keys in made):
            # Not enough words with rare shingles: each of these is a key of its own.
            made.append(mix(found[~known] ^ _U(0x2545F4914F6CDD1D)) >> _U(1))
        return np.concatenate(made)

    def _first_words(self, found: np.ndarray, known: np.ndarray, band: int) -> np.ndarray:
        """The first words in the order (rare, frequent, empty), sorted; frequent and empty ones from _LAST on."""
        bits = 2 * band + 1
        wanted = self.difference(len(found)) + 1
        part = found >> _U(64 - bits)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        words = np.bitwise_xor.reduceat(mix(found ^ _U(0x5851F42D4C957F2D)), starts)
        keys = mix(words + part[starts] * _U(0x9E3779B97F4A7C15) + _U(band)) >> _U(1)
        keys |= np.logical_and.reduceat(known, starts).astype(_U) << _U(63)
        if len(keys) >= wanted:
            return np.sort(np.partition(keys, wanted - 1)[:wanted])
        # Empty words are the last in the order; a document rarely needs any of them.
        empty = np.setdiff1d(np.arange(1 << bits, dtype=_U), part[starts], assume_unique=True)
        return np.concatenate([np.sort(keys), _EMPTY | _U(band << 48) | empty[:wanted - len(keys)]])

    def parity(self, found: np.ndarray) -> bytes:
        """One bit per shingle, XORed; wide bands fold onto narrow ones."""
        width = 8 << (2 * self.band(len(found)))
        counts = np.bincount((found & _U(width - 1)).astype(np.int64), minlength=width)
        return np.packbits((counts & 1).astype(bool)).tobytes()


def hamming(left: bytes, right: bytes) -> int:
    """Hamming distance of two parity sketches, the wider one folded."""
    a, b = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) if len(x) > width else x for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def node_of(found: np.ndarray) -> int:
    """A set's 64-bit fingerprint."""
    spread = mix(found)
    total = np.array([spread.sum() ^ (np.bitwise_xor.reduce(spread) >> _U(7))], _U) + _U(len(found))
    return int(mix(total).view(np.int64)[0])


def frequent_shingles(docs: DataFrame, share: float = SAMPLE_SHARE) -> np.ndarray | None:
    """A table over hashes that marks shingles which several documents of a sample hold."""
    n = docs.count()
    if not n:
        return None
    share = max(share, SAMPLE_ROWS / n)
    some = docs if share >= 1 else docs.where(
        F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
    sketcher = Sketcher()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [sketcher.shingles(raw, hashes) for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([*sets, np.empty(0, _U)]).view(np.int64))})

    counts = (some.dropDuplicates(["text"]).select("text").mapInArrow(held, "shingle long")
              .groupBy("shingle").count().where(F.col("count") >= FREQUENT))
    top = counts.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).select("shingle").toArrow()
    table = np.zeros(_SLOTS, bool)
    table[top.column("shingle").to_numpy() & (_SLOTS - 1)] = True
    return table


_SKETCHED = StructType([
    StructField("doc_id", LongType()), StructField("text_key", LongType()), StructField("n_shingles", LongType()), StructField("n_rare", LongType()),
    StructField("node", LongType()),
    StructField("parity", BinaryType()), StructField("keys", ArrayType(LongType()))])


def sketch(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Per row (doc_id, text_key, text): ids, n_shingles, n_rare of them, node (null without shingles), parity sketch, join keys."""
    table = frequent_shingles(docs)
    packed = docs.sparkSession.sparkContext.broadcast(None if table is None else np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if packed.value is None else np.unpackbits(packed.value).view(bool)
        sketcher, hashes = Sketcher(similarity, marks), WordHashes()
        for batch in batches:
            sizes, rare, nodes, parities, keys = [], [], [], [], []
            for raw in raw_texts(batch):
                found = sketcher.shingles(raw, hashes)
                sizes.append(len(found))
                rare.append(int((~sketcher.is_frequent(found)).sum()))
                nodes.append(node_of(found) if len(found) else None)
                parities.append(sketcher.parity(found) if len(found) else None)
                keys.append(sketcher.keys(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "text_key": batch.column("text_key"), "n_shingles": pa.array(sizes, pa.int64()),
                "n_rare": pa.array(rare, pa.int64()), "node": pa.array(nodes, pa.int64()), "parity": pa.array(parities, pa.binary()),
                "keys": list_array(keys, pa.int64())})

    return docs.select("doc_id", "text_key", "text").mapInArrow(run, _SKETCHED)


def _sizes_allow(similarity: int):
    return 100 * F.least("size_u", "size_v") >= similarity * F.greatest("size_u", "size_v")


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (u, v) whose sizes and parity sketches allow the similarity."""
    side = nodes.select("node", "n_shingles", "parity")
    left = pairs.join(side.toDF("u", "size_u", "parity_u"), "u")
    both = left.join(side.toDF("v", "size_v", "parity_v"), "v").where(_sizes_allow(similarity))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("size_u", "parity_u", "size_v", "parity_v")}
            near = [(100 + similarity) * hamming(p, q) <= (100 - similarity) * (m + n)
                    for m, p, n, q in zip(c["size_u"], c["parity_u"], c["size_v"], c["parity_v"])]
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(keep, "u long, v long")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, similarity: int) -> DataFrame:
    """(node, found) for the nodes in *wanted*, one document read for each."""
    ids = nodes.join(wanted, "node", "left_semi").select("node", F.col("doc_id").alias("_id"))
    ids = cut_lineage(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
    sketcher = Sketcher(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [sketcher.shingles(raw, hashes) for raw in raw_texts(batch)]
            own = [node_of(f) if len(f) else None for f in found]
            # Rows may share an id; only the node's own text counts.
            right = pa.array([o == n for o, n in zip(own, batch.column("node").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_pydict({
                "node": batch.column("node"), "found": pa.array([f.tobytes() for f in found], pa.binary())}).filter(right)

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"])).select("node", "text")
    return texts.mapInArrow(run, "node long, found binary").dropDuplicates(["node"])


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs that reach the similarity, by comparing their sets."""
    pairs = cut_lineage(_plausible(pairs, nodes, similarity))
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = cut_lineage(_sets(docs, nodes, wanted, similarity))
    both = pairs.join(sets.toDF("u", "found_u"), "u").join(sets.toDF("v", "found_v"), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for p, q in zip(b.column("found_u").to_pylist(), b.column("found_v").to_pylist()):
                x, y = np.frombuffer(p, _U), np.frombuffer(q, _U)
                common = len(x) + len(y) - len(np.union1d(x, y))
                near.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield b.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(verify, "u long, v long")


def _block_pairs(rows: DataFrame, similarity: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (u, v) that share a word of many holders, by blocks of its holders.

    If the word is frequent or empty (a negative key), one side must be almost wholly frequent.
    A word's holders are cut into blocks; a cell compares the sizes, rare shingles and parity
    sketches of two blocks and gives out the plausible pairs only, and each pair only in the
    cells of the least such word that both hold.
    """
    close = (F.col("key") >= 0) | ((100 + similarity) * F.col("n_rare") <= (100 - similarity) * F.col("n_shingles"))
    rows = rows.withColumn("_close", close)
    counts = rows.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_n"),
                                     F.max("_close").alias("_any")).where("_any").select("key", "_n")
    rows = rows.join(counts, "key").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    known = rows.withColumn("_kind", F.col("key") >= 0)
    words = known.groupBy("node", "_kind").agg(F.collect_set("key").alias("_words"))
    rows = cut_lineage(known.join(words, ["node", "_kind"]).withColumn(
        "_words", F.filter("_words", lambda w: w < F.col("key"))).drop("_kind", "doc_id"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    left = rows.where("_close").select("*", F.col("_own").alias("_bu"), all_blocks.alias("_bv"), F.lit(True).alias("_left"))
    right = rows.select("*", all_blocks.alias("_bu"), F.col("_own").alias("_bv"), F.lit(False).alias("_left"))

    def compare(cell: pd.DataFrame) -> pd.DataFrame:
        u, v = cell[cell["_left"]], cell[~cell["_left"]]
        sizes = [x["n_shingles"].to_numpy() for x in (u, v)]
        low, high = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
        room = (100 - similarity) * np.add.outer(*sizes)
        fits = 100 * low >= similarity * high
        if cell["key"].iloc[0] < 0:
            fits &= (100 + similarity) * np.add.outer(u["n_rare"].to_numpy(), v["n_rare"].to_numpy()) <= room
        fits &= u["root"].to_numpy()[:, None] != v["root"].to_numpy()[None, :]
        # If both can be on the left, one of the two orders is enough.
        fits &= (u["node"].to_numpy()[:, None] < v["node"].to_numpy()[None, :]) | ~v["_close"].to_numpy()[None, :]
        if fits.any():
            fits &= ~_share(u["_words"], v["_words"])
        at_u, at_v = np.nonzero(fits)
        near = _near(u, v, at_u, at_v, room, similarity)
        return pd.DataFrame({"u": u["node"].to_numpy()[at_u[near]], "v": v["node"].to_numpy()[at_v[near]]})

    return left.unionByName(right).groupBy("key", "_bu", "_bv").applyInPandas(compare, "u long, v long")


def _share(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Whether two rows have a word in common, for all pairs of rows of two bounded blocks."""
    sides = [(np.repeat(np.arange(len(x)), x.map(len).to_numpy()), np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64))
             for x in (left, right)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    shared = np.zeros((len(left), len(right)), bool)
    # Some hundreds of words at a time.
    for start in range(0, len(both), 512):
        some = both[start:start + 512]
        marks = []
        for (of, words), n in zip(sides, shared.shape):
            at = np.minimum(np.searchsorted(some, words), len(some) - 1)
            held = some[at] == words
            table = np.zeros((n, len(some)), np.float32)
            table[of[held], at[held]] = 1
            marks.append(table)
        shared |= marks[0] @ marks[1].T > 0
    return shared


def _near(u: pd.DataFrame, v: pd.DataFrame, at_u: np.ndarray, at_v: np.ndarray, room: np.ndarray, similarity: int) -> np.ndarray:
    """Whether the Hamming distance of each pair of rows leaves the similarity possible."""
    near = np.zeros(len(at_u), bool)
    widths = [x["parity"].map(len).to_numpy() for x in (u, v)]
    for a in np.unique(widths[0]):
        for b in np.unique(widths[1]):
            width = min(a, b)
            tables = []
            for side, own, of in ((u, a, 0), (v, b, 1)):
                rows = np.flatnonzero(widths[of] == own)
                bits = np.frombuffer(b"".join(side["parity"].iloc[rows]), np.uint8).reshape(len(rows), -1, width)
                place = np.zeros(len(side), np.int64)
                place[rows] = np.arange(len(rows))
                tables.append((np.bitwise_xor.reduce(bits, axis=1), place))
            here = np.flatnonzero((widths[0][at_u] == a) & (widths[1][at_v] == b))
            # Few pairs at a time, so that their sketches stay within some megabytes.
            step = max(1, (4 << 20) // int(width))
            for start in range(0, len(here), step):
                some = here[start:start + step]
                (left, place_u), (right, place_v) = tables
                apart = np.bitwise_count(left[place_u[at_u[some]]] ^ right[place_v[at_v[some]]]).sum(axis=1, dtype=np.int64)
                near[some] = (100 + similarity) * apart <= room[at_u[some], at_v[some]]
    return near


def _across(held: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: int, few: int = FEW_HOLDERS) -> DataFrame:
    """Pairs (u, v) of different components that share a key and could be linked.

    Words of up to *few* holders are joined with themselves; all others, marked as frequent
    or not, go through blocks.
    """
    placed = held.select("key", "node").join(roots, "node", "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_holders")).where(
        "_a <> _b").select("key", "_holders")
    placed = cut_lineage(placed.join(mixed, "key"))
    by_pairs = (F.col("key") >= 0) & (F.col("_holders") <= few)
    rare = placed.where(by_pairs).join(nodes.select("node", "n_shingles"), "node")
    one, other = (rare.select("key", "node", "root", "n_shingles").toDF("key", x, f"root_{x}", f"size_{x}") for x in "uv")
    rare = one.join(other, "key").where((F.col("root_u") < F.col("root_v")) & _sizes_allow(similarity))
    known = _block_pairs(placed.where(~by_pairs).drop("_holders").join(nodes, "node"), similarity)
    pairs = rare.select("u", "v").unionByName(known)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _grouped(docs: DataFrame, similarity: int, few: int) -> DataFrame:
    """Per row of *docs* (doc_id, text, text_key): these without the text, n_shingles, node and root (null without words), component_id."""
    rows = cut_lineage(sketch(docs, similarity))
    nodes = cut_lineage(rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("n_rare").alias("n_rare"),
        F.first("parity").alias("parity")))
    held = rows.where("node is not null").select(F.explode("keys").alias("key"), "node")
    shared = held.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("_top")).where("pivot <> _top")
    held = cut_lineage(held.join(shared.drop("_top"), "key").select("key", "node", "pivot").distinct())
    # First pass: every holder of a word with the least of them.
    stars = held.where("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    links = cut_lineage(_links(stars, docs, nodes, similarity))
    roots = components(links)
    # Second pass: holders of a word in different components.
    across = _across(held, nodes, roots, similarity, few)
    links = links.unionByName(_links(across, docs, nodes, similarity))
    roots = cut_lineage(components(links))
    named = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.join(least, "root").select("node", "root", "component_id")
    return rows.select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "text_key", "n_shingles", "node", "root",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def similarity_groups(docs: DataFrame, similarity: int = SIMILARITY, few: int = FEW_HOLDERS) -> DataFrame:
    """Per row of *docs* (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links. Rows without words (null,
    empty, white space) are linked with nothing and are their own component; rows with
    equal texts are one node, whatever their ids; rows without id count but never name
    a component unless no other row could. Other columns are ignored.
    """
    return _grouped(_texts(docs), similarity, few).select("doc_id", "n_shingles", "component_id")


def keep_first(docs: DataFrame, similarity: int = SIMILARITY, few: int = FEW_HOLDERS) -> DataFrame:
    """*docs* with one document of each group, the one with the smallest doc_id.

    A document is an id and a text: of rows that share an id with different texts each is
    judged by its own text, rows that share both are one, and missing ids come last. Rows
    without words all stay.
    """
    found = cut_lineage(_grouped(_texts(docs), similarity, few).where("node is not null"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    first = found.groupBy("root").agg(F.min(order).alias("_first")).select("_first.doc_id", "_first.text_key", F.lit(True).alias("_stays"))
    kept = found.select("doc_id", "text_key").distinct()
    same = kept["doc_id"].eqNullSafe(first["doc_id"]) & (kept["text_key"] == first["text_key"])
    gone = cut_lineage(kept.join(first, same, "left_anti")).toDF("_gone_id", "_gone_key")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_NODES else gone
    names = docs.columns
    id_, text = (F.col(f"`{c}`") for c in ("doc_id", "text"))
    key = F.xxhash64(text.cast("string"))
    rest = docs.join(gone, id_.cast("long").eqNullSafe(F.col("_gone_id")) & (key == F.col("_gone_key")), "left_anti").select(*names)
    if found.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return rest
    # Repeated rows are rare: one of each stays.
    blank = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "") == ""
    return rest.where(~blank).dropDuplicates(["doc_id", "text"]).unionByName(rest.where(blank))
