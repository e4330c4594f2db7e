"""Exact top-k of every question over its user's memories.

No (question, memory) pair leaves a task unless it is among the best ``k`` of the
rows of that user it was scored with, a bounded set that takes one matrix product.
Which rows meet which questions:

``scan``  the questions are small (measured, see :func:`bounded`): they are sent to
          every task and the memories are scored where they are read, a bounded
          number of rows and bytes at a time. The memory table is never shuffled.
``grid``  the questions are large: memories and questions meet in (user, slice,
          block) cells. A user with many memories has many slices, a user with many
          questions many blocks, so a cell and its hits are bounded whatever the skew;
          small users share a cell, so that there are not as many cells as users.

Both reduce to ``row_number() <= k`` per question, whose group limit also runs
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from turnstore import settings as S
from turnstore.runtime import cut_lineage

SCAN_BYTES = 16 * 1024 * 1024   # most question data sent to every task
BLOCK_ROWS = 32_768             # memory rows gathered before they are scored
BLOCK_BYTES = 16 * 1024 * 1024  # and most bytes of them, in a grid cell as well
SLICE_ROWS = 32_768             # expected memory rows of one grid cell
QUERY_BLOCK = 4_096             # expected questions of one grid cell
CELL_HITS = 524_288             # expected hits of one grid cell
SCORE_CELLS = 2_000_000         # scores held at once by a task
HIT_ROWS = 16_384               # hits gathered before they go back to the JVM

# Scores of one user's memory rows (n) against that user's questions (q): n x q.
BlockScorer = Callable[[pa.Table, pa.Table], np.ndarray]


@dataclass(frozen=True)
class Channel:
    """What a scorer reads from each side, and the scorer."""

    scorer: BlockScorer
    memory_columns: tuple[str, ...]
    query_columns: tuple[str, ...]
    floor: float | None = None      # only scores above it count
    group: str | None = None        # memory column whose values share ``per_group`` places
    per_group: int = 0


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def dot_products(memories: pa.Table, questions: pa.Table) -> np.ndarray:
    # Laid out question by question, as they are ranked.
    return (_matrix(questions.column("qvec")) @ _matrix(memories.column("vec")).T).T


DENSE = Channel(dot_products, ("vec",), ("qvec",))


def _leading(groups: np.ndarray, limit: int) -> np.ndarray:
    """Marks the first *limit* entries of every group, in the given order."""
    by_group = np.argsort(groups, kind="stable")
    sorted_groups = groups[by_group]
    starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
    lengths = np.diff(np.r_[starts, len(groups)])
    marks = np.zeros(len(groups), dtype=bool)
    marks[by_group] = np.arange(len(groups)) - np.repeat(starts, lengths) < limit
    return marks


def _best(memories: pa.Table, questions: pa.Table, channel: Channel, k: int, decimals: int,
          cells: int) -> Iterator[pa.RecordBatch]:
    """The best *k* memories for each question of one user, some questions at a time."""
    seq = memories.column("seq").to_numpy()
    step = max(1, min(cells // max(1, memories.num_rows), HIT_ROWS // k))
    groups = None
    if channel.group:
        groups = memories.column(channel.group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    for start in range(0, questions.num_rows, step):
        part = questions.slice(start, step)
        scores = np.ascontiguousarray(channel.scorer(memories, part).T)
        query_rows, memory_rows, found = [], [], []
        for q, exact in enumerate(scores):
            rows = None if channel.floor is None else np.flatnonzero(exact > channel.floor)
            held = exact if rows is None else exact[rows]
            if groups is None and len(held) > k:
                # Everything that may tie with the k-th score, once rounded, stays until seq decides.
                kth = np.partition(held, len(held) - k)[len(held) - k]
                near = np.flatnonzero(held >= kth - 2 * max(10.0 ** -decimals, abs(kth) * 2 ** -50))
                rows = near if rows is None else rows[near]
                held = held[near]
            rows = np.arange(len(held)) if rows is None else rows
            held = np.round(held, decimals) + 0.0
            if channel.floor is not None:
                above = held > channel.floor
                rows, held = rows[above], held[above]
            order = np.lexsort((seq[rows], -held))
            if groups is not None and len(order):
                order = order[_leading(groups[rows[order]], channel.per_group)]
            order = order[:k]
            query_rows.append(np.full(len(order), q))
            memory_rows.append(rows[order])
            found.append(held[order])
        q_idx, m_idx = np.concatenate(query_rows), np.concatenate(memory_rows)
        yield pa.RecordBatch.from_arrays(
            [part.column("query_id").combine_chunks().take(pa.array(q_idx)),
             memories.column("id").combine_chunks().take(pa.array(m_idx)),
             memories.column("seq").combine_chunks().take(pa.array(m_idx)),
             pa.array(np.concatenate(found), pa.float64())],
            names=["query_id", "id", "seq", "score"])


def _by_user(table: pa.Table) -> tuple[pa.Table, dict[object, tuple[int, int]]]:
    """The table sorted by user, and where each user's rows are (offset, length)."""
    codes = table.column("user_id").combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(codes.indices)
    in_order = codes.indices.take(order).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, in_order[1:] != in_order[:-1]])
    ends = np.r_[starts[1:], len(in_order)]
    users = codes.dictionary.take(pa.array(in_order[starts])).to_pylist()
    return table.take(order).combine_chunks(), {
        user: (int(start), int(end - start)) for user, start, end in zip(users, starts, ends)}


def _each_user(block: pa.Table, asked: Container[object]) -> Iterator[tuple[object, pa.Table]]:
    """The rows of every asked user, of one user at a time: the block is not copied as a whole."""
    codes = block.column("user_id").combine_chunks().dictionary_encode()
    if len(codes.dictionary) == 1 and not codes.null_count:
        if codes.dictionary[0].as_py() in asked:
            yield codes.dictionary[0].as_py(), block
        return
    # Rows without a user come last and belong to nobody.
    places = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
    order = np.argsort(places, kind="stable")
    ends = np.cumsum(np.bincount(places, minlength=len(codes.dictionary)))
    batches = block.to_batches()
    firsts = np.cumsum([0, *(b.num_rows for b in batches)])
    for user, start, end in zip(codes.dictionary.to_pylist(), np.r_[0, ends[:-1]], ends):
        if user in asked:
            at = order[start:end]
            cuts = np.searchsorted(at, firsts)
            yield user, pa.Table.from_batches([
                b.take(pa.array(at[low:high] - first)) for b, low, high, first in zip(batches, cuts, cuts[1:], firsts) if low < high])


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where one takes more than about *size* bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(size, batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Gather Arrow batches into tables of about *rows* rows or *size* bytes, whichever is less."""
    held, n, held_bytes = [], 0, 0
    for batch in _pieces(batches, size):
        if held and (n + batch.num_rows > rows or held_bytes + batch.nbytes > size):
            yield pa.Table.from_batches(held)
            held, n, held_bytes = [], 0, 0
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _width(df: DataFrame, columns: list[str], per_string: int = 48) -> Column:
    """About how many bytes a row of *columns* takes; a string of an array counts *per_string*."""
    width = F.lit(16)
    for name in columns:
        kind = df.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            per_item = per_string if isinstance(kind.elementType, T.StringType) else 8
            width = width + F.greatest(F.size(name), F.lit(0)) * per_item
        elif isinstance(kind, T.StringType):
            width = width + F.octet_length(name)
        else:
            width = width + 8
    return width


def bounded(questions: DataFrame, columns: list[str], limit_bytes: int = SCAN_BYTES) -> pa.Table | None:
    """The questions as one Arrow table if they take at most *limit_bytes*, else None.

    The size is measured by Spark before anything is fetched.
    """
    size = questions.agg(F.sum(_width(questions, columns)).cast("bigint").alias("bytes")).first()["bytes"]
    if size is not None and size > limit_bytes:
        return None
    return questions.select(*columns).toArrow()


def _hit_schema(memories: DataFrame, questions: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", questions.schema["query_id"].dataType),
        T.StructField("id", memories.schema["id"].dataType),
        T.StructField("seq", T.LongType()),
        T.StructField("score", T.DoubleType())])


def _scan(memories: DataFrame, questions: pa.Table, schema: T.StructType, channel: Channel, k: int) -> DataFrame:
    shared = memories.sparkSession.sparkContext.broadcast(
        _by_user(questions) if questions.num_rows else (questions, {}))
    decimals, block_rows, hit_rows, cells = S.SCORE_DECIMALS, BLOCK_ROWS, HIT_ROWS, SCORE_CELLS

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, asked_at = shared.value
        for block in _blocks(batches, block_rows):
            for user, rows in _each_user(block, asked_at):
                yield from _best(rows, asks.slice(*asked_at[user]), channel, k, decimals, cells)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Many users give many short batches: they go back to the JVM together.
        for table in _blocks(scored(batches), hit_rows):
            yield from table.combine_chunks().to_batches()

    return memories.mapInArrow(stage, schema)


def _grid(memories: DataFrame, questions: DataFrame, schema: T.StructType, channel: Channel, k: int,
          slice_rows: int, query_block: int) -> DataFrame:
    asked = questions.groupBy("user_id").agg(F.count("*").alias("asked"))
    width = _width(memories, ["user_id", "id", "seq", *channel.memory_columns], 12)
    stored = memories.groupBy("user_id").agg(F.count("*").alias("stored"), F.sum(width).alias("bytes"))
    query_block = max(1, min(query_block, CELL_HITS // k))
    # Parts of a cell's most rows, bytes and questions that a user takes.
    filled = F.greatest(F.col("stored") / slice_rows, F.col("bytes") / BLOCK_BYTES)
    asking = F.col("asked") / query_block
    # One row per asked user. Spark broadcasts it when it is small; otherwise the
    # skew join splits a hot user's memories.
    users = cut_lineage(asked.join(stored, "user_id").select(
        "user_id", filled.alias("filled"), asking.alias("asking"),
        F.ceil(filled).cast("int").alias("slices"), F.ceil(asking).cast("int").alias("blocks")))
    # Users with one slice and one block share cells, about a quarter of a slice of rows or of a block of questions in each.
    alone = (F.col("slices") > 1) | (F.col("blocks") > 1)
    packs = users.where(~alone).agg(F.ceil(4 * F.greatest(F.sum("filled"), F.sum("asking"))).cast("int")).first()[0] or 1
    pack = F.pmod(F.xxhash64("user_id"), F.lit(packs)).cast("int")
    users = users.select("user_id", "slices", "blocks", F.struct(
        F.when(alone, F.col("user_id")).alias("user"), F.when(~alone, pack).alias("pack")).alias("_cell"))
    left = (memories.join(users, "user_id")
            .withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("cell", F.col("_cell")).drop("slices", "blocks", "_cell"))
    right = (questions.join(users, "user_id")
             .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
             .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
             .withColumn("cell", F.col("_cell")).drop("slices", "blocks", "_cell"))
    decimals, cells = S.SCORE_DECIMALS, SCORE_CELLS

    def cell(mems: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if mems.num_rows and asks.num_rows:
            asks, asks_at = _by_user(asks)
            for user, rows in _each_user(mems, asks_at):
                found += _best(rows, asks.slice(*asks_at[user]), channel, k, decimals, cells)
        if not found:
            return pa.table({"query_id": asks.column("query_id").slice(0, 0), "id": mems.column("id").slice(0, 0),
                             "seq": mems.column("seq").slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.Table.from_batches(found)

    keys = ["cell", "slice", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def candidates(memories: DataFrame, questions: DataFrame, k: int, channel: Channel = DENSE,
               strategy: str = "auto", scan_bytes: int = SCAN_BYTES, slice_rows: int = SLICE_ROWS,
               query_block: int = QUERY_BLOCK) -> DataFrame:
    """The best *k* memories of every question within each block: query_id, id, seq, score."""
    if strategy not in ("auto", "scan", "grid"):
        raise ValueError(f"unknown strategy {strategy!r}")
    extra = [*channel.memory_columns, *([channel.group] if channel.group else [])]
    rows = memories.select("user_id", "id", "seq", *extra).where(
        " and ".join(f"{c} is not null" for c in channel.memory_columns))
    columns = ["query_id", "user_id", *channel.query_columns]
    asks = questions.select(*columns).where(" and ".join(f"{c} is not null" for c in channel.query_columns))
    schema = _hit_schema(rows, asks)
    fetched = None if strategy == "grid" else bounded(asks, columns, scan_bytes)
    if fetched is not None:
        return _scan(rows, fetched, schema, channel, k)
    if strategy == "scan":
        raise ValueError(f"the questions take more than {scan_bytes} bytes: raise scan_bytes, or use strategy 'grid' or 'auto'")
    return _grid(rows, asks, schema, channel, k, slice_rows, query_block)


def top_hits(memories: DataFrame, questions: DataFrame, k: int, channel: Channel = DENSE, salts: int = 0, **plan) -> DataFrame:
    """The best *k* memories of every question: query_id, id, seq, score, p (from 1).

    *memories* has user_id, id, seq and the channel's columns; *questions* has
    query_id, user_id and the channel's columns. Questions of unknown users give
    no row. Ties are broken by ``seq``. Every block offers at most *k* rows for a
    question; where a user's memories lie in very many blocks, *salts* merges them in
    two levels, so that no task gets more than k x salts rows for one question. *plan*
    is passed to :func:`candidates`.
    """
    scored = candidates(memories, questions, k, channel, **plan)
    order = [F.desc("score"), "seq"]
    if salts > 1:
        salted = W.partitionBy("query_id", "_salt").orderBy(*order)
        scored = (scored.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
                  .withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= k).drop("_n", "_salt"))
    best_first = W.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("p", F.row_number().over(best_first)).where(F.col("p") <= k)
