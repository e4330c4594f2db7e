"""Prefix trie of conversations, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Its key is the XOR of 128-bit hashes of the
turns, each hashed with its place, so that prefixes are running XORs and a conversation
can be cut into blocks. Every node is owned by its smallest member.

Totals go from the leaves to the root. Nodes are sorted in reverse level order (deepest
first); a node takes the messages of its children from a priority queue, which spills when
it is large, and sends its own total to its parent. The tree is cut into shards: the
highest nodes whose subtrees are small enough are shard roots, and a shard is processed by
one task. Their totals are then messages to the nodes above, which are processed in the
same way, until what is left fits into one shard.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnstore.runtime import cut_lineage, small_side

# Turns of a conversation that are numbered and hashed in one task.
BLOCK_TURNS = 4096
# Most nodes of a subtree that one task processes.
SHARD_NODES = 1 << 14
# Messages a queue holds in memory.
QUEUE_MESSAGES = 200_000
# Characters of conversation ids that are handed on as one piece.
ID_CHARS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"

_KEY = ["depth", "ka", "kb"]


def ordered_turns(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, place, a, b, words) of conversation rows (conv_id, turn, role, text).

    ``place`` counts a conversation's turns from 0, by turn, null first; equal turns are ordered
    by the hash of role and text. a and b are two hashes of role and text, null being empty.
    Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.expr(f"turn div {block_turns}").cast("long").alias("_block"))
    inside = W.partitionBy("conv_id", "_block").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    earlier = W.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    base = (rows.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
            .select("conv_id", F.col("_block").alias("_own"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")))
    placed = rows.withColumn("_at", F.row_number().over(inside) - 1).withColumnRenamed("conv_id", "_conv")
    return (placed.join(base, (F.col("_conv") == F.col("conv_id")) & F.col("_block").eqNullSafe(F.col("_own")))
            .select("conv_id", (F.col("_base") + F.col("_at")).alias("place"), "a", "b", "words"))


def rebuilt_turns(turns: DataFrame, leader: Column, taken: Column, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) in which each conversation begins like another one.

    *leader* and *taken* are columns over conv_id: the first *taken* turns of conversation
    *leader* (fewer if it has fewer, none if it is absent), then the own turns after as many of
    its own. Turns are (conv_id, place, a, b, words); conversations (conv_id, n_turns) include
    those that are left without a turn.
    """
    own = cut_lineage(ordered_turns(turns, block_turns))
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("_n"))
    of = sizes.select("conv_id", "_n", leader.cast("long").alias("_leader"), taken.cast("long").alias("_taken"))
    known = of.join(sizes.toDF("_leader", "_held"), "_leader", "left").select(
        "conv_id", "_n", "_leader", "_taken", F.least("_taken", F.coalesce("_held", F.lit(0))).alias("_given"))
    known = cut_lineage(known)
    most = known.agg(F.max("_given")).first()[0] or 0
    heads = own.where(F.col("place") < most).withColumnRenamed("conv_id", "_leader")
    given = known.select("conv_id", "_leader", "_given").join(heads, "_leader").where("place < _given")
    rest = known.select("conv_id", "_taken", "_given").join(own, "conv_id").where("place >= _taken")
    rows = given.select("conv_id", "place", "a", "b", "words").unionByName(
        rest.select("conv_id", (F.col("place") - F.col("_taken") + F.col("_given")).alias("place"), "a", "b", "words"))
    n_turns = F.col("_given") + F.greatest(F.col("_n") - F.col("_taken"), F.lit(0))
    return known.select("conv_id", n_turns.alias("n_turns")), rows


def _prefixes(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, words): the key of every prefix and of its parent."""
    salted = turns.select("conv_id", "place", "words", F.xxhash64("a", "place").alias("a"), F.xxhash64("b", "place").alias("b"),
                          F.expr(f"place div {block_turns}").alias("_block"))
    running = W.partitionBy("conv_id", "_block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = salted.groupBy("conv_id", "_block").agg(F.bit_xor("a").alias("_a"), F.bit_xor("b").alias("_b"))
    bases = blocks.select("conv_id", "_block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(c) for c in ("_a", "_b")])
    keyed = salted.withColumns({"ka": F.bit_xor("a").over(running), "kb": F.bit_xor("b").over(running)}).join(bases, ["conv_id", "_block"])
    keyed = keyed.select("conv_id", (F.col("place") + 1).alias("depth"), F.col("ka").bitwiseXOR(F.col("_a")).alias("ka"),
                         F.col("kb").bitwiseXOR(F.col("_b")).alias("kb"), "a", "b", "words")
    return keyed.select("conv_id", "depth", "ka", "kb", F.col("ka").bitwiseXOR(F.col("a")).alias("pa"),
                        F.col("kb").bitwiseXOR(F.col("b")).alias("pb"), "words")


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, ka, kb, ends_sha256) of rows (depth, ka, kb, conv_id): ids ascending, joined by commas.

    Ids are first sorted and joined in ranges, so that the digest of a node with very many
    ends reads few pieces, one after the other.
    """
    order = [*_KEY, "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, first, held = None, [], None, 0
        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in order)):
                if own != key or held > ID_CHARS:
                    if ids:
                        yield piece(key, first, ids)
                    key, ids, first, held = own, [], conv, 0
                ids.append(str(conv))
                held += len(ids[-1])
        if ids:
            yield piece(key, first, ids)

    def piece(key, first, ids) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(order, [*key, first])) | {"ids": ",".join(ids)}])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*_KEY, "ids"])):
                if own != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(("," + ids).encode())
            if done:
                yield table(done)
                done = []
        if state:
            yield table([(*key, state.hexdigest())])

    def table(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*rows))[:3]),
                                           pa.array([r[3] for r in rows])], [*_KEY, "ends_sha256"])

    pieces = (ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
              .mapInArrow(_gathered(join), "depth long, ka long, kb long, conv_id long, ids string"))
    return (pieces.repartition("ka", "kb").sortWithinPartitions(*order)
            .mapInArrow(digest, "depth long, ka long, kb long, ends_sha256 string"))


def _gathered(run):
    """*run* with its many small batches put together."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 1 << 22:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return gather


class SpillingQueue:
    """A priority queue of integer tuples that keeps sorted runs in temporary files beyond a bound.

    The files have no name and go with the task.
    """

    def __init__(self, width: int, bound: int = QUEUE_MESSAGES):
        self.width, self.bound = width, bound
        self._heap: list[tuple[int, ...]] = []
        self._runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []

    def push(self, item: tuple[int, ...]) -> None:
        heapq.heappush(self._heap, item)
        if len(self._heap) > self.bound:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        np.array(sorted(self._heap), np.int64).tofile(file)
        file.seek(0)
        self._heap = []
        run = self._read(file)
        heapq.heappush(self._runs, (next(run), id(run), run))

    def _read(self, file) -> Iterator[tuple[int, ...]]:
        while block := file.read(8 * self.width * 4096):
            yield from map(tuple, np.frombuffer(block, np.int64).reshape(-1, self.width).tolist())
        file.close()

    def least(self) -> tuple[int, ...] | None:
        heads = [h[0] for h in (self._heap, self._runs) if h]
        return min(heads[0], self._runs[0][0]) if len(heads) == 2 else (heads[0] if self._heap else heads[0][0]) if heads else None

    def pop(self) -> tuple[int, ...]:
        if self._runs and (not self._heap or self._runs[0][0] < self._heap[0]):
            item, number, run = self._runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self._runs)
            else:
                heapq.heapreplace(self._runs, (following, number, run))
            return item
        return heapq.heappop(self._heap)


_NODE = ["depth", "ka", "kb", "pa", "pb", "leaves", "saved"]


def _forward(queue_messages: int):
    """Totals of the nodes of one task, which come sorted by (sa, sb, depth descending, ka, kb).

    A row (sa, sb, depth, ka, kb, pa, pb, leaves, saved) is a node with its own part of the totals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(5, queue_messages), None
        for batch in batches:
            leaves_, saved_ = [], []
            for sa, sb, depth, ka, kb, pa_, pb, leaves, saved in zip(*(batch.column(c).to_pylist() for c in ["sa", "sb", *_NODE])):
                if (sa, sb) != shard:
                    # What is left was for the parent of a shard root, which is not here.
                    queue, shard = SpillingQueue(5, queue_messages), (sa, sb)
                here = (-depth, ka, kb)
                while (head := queue.least()) is not None and head[:3] == here:
                    _, _, _, more, kept = queue.pop()
                    leaves += more
                    saved += kept
                leaves_.append(leaves)
                saved_.append(saved)
                if depth:
                    queue.push((1 - depth, pa_, pb, leaves, saved))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _NODE[:5]), pa.array(leaves_, pa.int64()), pa.array(saved_, pa.int64())], _NODE)

    return run


def _process(nodes: DataFrame, queue_messages: int) -> DataFrame:
    return (nodes.select("sa", "sb", *_NODE).repartition("sa", "sb").sortWithinPartitions("sa", "sb", F.desc("depth"), "ka", "kb")
            .mapInArrow(_forward(queue_messages), ", ".join(f"{c} long" for c in _NODE)))


def subtree_totals(nodes: DataFrame, rows: DataFrame, shard_nodes: int = SHARD_NODES,
                   queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """*nodes* (depth, ka, kb, pa, pb, conv_id of the owner, leaves, saved) with both summed over subtrees.

    *rows* (conv_id, depth, ka, kb) are the prefixes of the owners.
    """
    done = []
    while True:
        if nodes.count() <= shard_nodes:
            done.append(_process(nodes.select(F.lit(0).cast("long").alias("sa"), F.lit(0).cast("long").alias("sb"), *_NODE), queue_messages))
            break
        # A node's subtree has at most as many nodes as its members have turns from there on.
        owners = small_side(nodes.select("conv_id").distinct())
        rows = cut_lineage(rows.join(owners, "conv_id", "left_semi"))
        longest = rows.groupBy("conv_id").agg(F.max("depth").alias("_last"))
        weights = rows.join(longest, "conv_id").groupBy(*_KEY).agg(F.sum(F.col("_last") - F.col("depth") + 1).alias("_weight"))
        upper = cut_lineage(weights.where(F.col("_weight") > shard_nodes).select(*_KEY))
        above = cut_lineage(rows.join(small_side(upper), _KEY, "left_semi"))
        # The shard of a conversation's nodes begins below the last upper node on its path.
        cut = above.groupBy("conv_id").agg((F.max("depth") + 1).alias("depth"))
        shards = rows.join(cut, ["conv_id", "depth"]).select("conv_id", F.col("ka").alias("sa"), F.col("kb").alias("sb"))
        lower = nodes.join(small_side(upper), _KEY, "left_anti").join(shards, "conv_id")
        totals = cut_lineage(_process(lower, queue_messages))
        done.append(totals)
        sent = (totals.select(F.col("depth") - 1, "pa", "pb", "leaves", "saved").toDF(*_KEY, "_leaves", "_saved")
                .join(small_side(upper), _KEY, "left_semi").groupBy(*_KEY).agg(F.sum("_leaves").alias("_leaves"), F.sum("_saved").alias("_saved")))
        nodes = cut_lineage(nodes.join(small_side(upper), _KEY, "left_semi").join(sent, _KEY, "left").select(
            *_KEY, "pa", "pb", "conv_id", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved")))
        rows = above
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def prefix_trie(conversations: DataFrame, turns: DataFrame, shard_nodes: int = SHARD_NODES,
                queue_messages: int = QUEUE_MESSAGES, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of *conversations* (conv_id, n_turns) and their *turns*.

    conv_id is the smallest member, parent_conv_id the parent's (null for the root, the prefix
    of no turns); n_convs counts members, n_children children, n_leaves childless nodes of the
    subtree; saved_tokens adds, over the subtree, the words of a node's last turn times the
    members beyond the first; ends_sha256 is the digest of the ids of the conversations that end
    here. Without conversations there is no node.
    """
    n_turns = conversations.withColumnRenamed("n_turns", "_n")
    prefixes = _prefixes(turns, block_turns).join(n_turns, "conv_id").withColumn("ends", F.col("depth") == F.col("_n")).drop("_n")
    zero = F.lit(0).cast("long")
    root = conversations.select("conv_id", zero.alias("depth"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"), zero.alias("pb"),
                                zero.alias("words"), (F.col("n_turns") == 0).alias("ends"))
    rows = cut_lineage(prefixes.unionByName(root))
    nodes = cut_lineage(rows.groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.max("words").alias("words")))
    children = nodes.where("depth > 0").groupBy(F.col("depth") - 1, "pa", "pb").agg(F.count("*").alias("n_children")).toDF(*_KEY, "n_children")
    known = cut_lineage(nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = known.select(*_KEY, "pa", "pb", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(own, rows.select("conv_id", *_KEY), shard_nodes, queue_messages)
    ends = _digests(rows.where("ends"))
    parents = known.select(F.col("depth") + 1, "ka", "kb", "conv_id").toDF("depth", "pa", "pb", "parent_conv_id")
    return (known.join(totals.select(*_KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), _KEY)
            .join(ends, _KEY, "left").join(parents, ["depth", "pa", "pb"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
