"""BM25 over each user's memories, and rank fusion with the dense channel.

The statistics are grouped counts over the memory table. Scoring then reuses the
dense operator's plan: only the best candidates of a block leave its task, so a
frequent term never produces a row per (question, memory) pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnstore import settings as S
from turnstore.operators.scoring import Channel, top_hits
from turnstore.runtime import cut_lineage, small_side

TOKEN = r"[\p{L}\p{N}]+"
# Cells of one dense count matrix: bounds the memory of a scoring step.
_CELLS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a missing text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokenised(memories: DataFrame, text: str = "content") -> DataFrame:
    return memories.withColumn("tokens", tokens(F.col(text)))


def weighted_questions(memories: DataFrame, questions: DataFrame, text: str = "query") -> DataFrame:
    """Question terms with their idf in the user's store, and its mean length.

    *memories* has user_id and tokens. Frequencies are counted only for terms that
    some question of the user holds; the other tokens are dropped where they are
    read when the question terms are few enough to be sent there.
    """
    asked = questions.select("query_id", "user_id", F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    wanted = asked.select("user_id", "term").distinct()
    lengths = memories.groupBy("user_id").agg(
        F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avg_len"))
    counts = (memories.select("user_id", F.explode(F.array_distinct("tokens")).alias("term"))
              .join(small_side(wanted), ["user_id", "term"], "left_semi").groupBy("user_id", "term").agg(F.count("*").alias("df")))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = (wanted.join(counts, ["user_id", "term"]).join(lengths, "user_id")
               .select("user_id", "term", F.greatest(idf, F.lit(S.BM25_MIN_IDF)).alias("idf"), "avg_len"))
    return (asked.join(weights, ["user_id", "term"])
            .groupBy("query_id", "user_id")
            .agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("_w"), F.first("avg_len").alias("avg_len"))
            .select("query_id", "user_id", F.col("_w.term").alias("terms"), F.col("_w.idf").alias("idfs"), "avg_len"))


def _bm25_scorer(k1: float, b: float, cells: int):
    def score(memories: pa.Table, questions: pa.Table) -> np.ndarray:
        asked = questions.column("terms").combine_chunks()
        coded = asked.flatten().dictionary_encode()
        n_terms, n_questions = len(coded.dictionary), questions.num_rows
        if n_questions > 1 and n_terms * n_questions > cells:
            # Too many weights at once: half of the questions hold fewer terms as well.
            half = n_questions // 2
            return np.hstack([score(memories, questions.slice(0, half)), score(memories, questions.slice(half))])
        weights = np.zeros((n_terms, n_questions))
        owner = np.repeat(np.arange(n_questions), pc.list_value_length(asked).to_numpy(zero_copy_only=False))
        weights[coded.indices.to_numpy(zero_copy_only=False), owner] = (
            questions.column("idfs").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        mean = questions.column("avg_len")[0].as_py() or 1.0
        out = np.zeros((memories.num_rows, n_questions))
        step = max(1, cells // max(n_terms, 1))
        at = 0
        for held in memories.column("tokens").chunks:
            for start in range(0, len(held), step):
                part = held.slice(start, step)
                lengths = pc.list_value_length(part).to_numpy(zero_copy_only=False)
                term = pc.index_in(part.flatten(), value_set=coded.dictionary)
                place = np.repeat(np.arange(len(part)) * n_terms, lengths)
                if term.null_count:
                    known = term.is_valid().to_numpy(zero_copy_only=False)
                    place, term = place[known], term.drop_null()
                place += term.to_numpy(zero_copy_only=False)
                tf = np.bincount(place, minlength=len(part) * n_terms).astype(np.float64).reshape(len(part), n_terms)
                norm = k1 * (1 - b + b * lengths / mean)
                share = tf + norm[:, None]
                tf *= k1 + 1
                tf /= share
                out[at:at + len(part)] = tf @ weights
                at += len(part)
        return out

    return score


def bm25_channel(k1: float = S.BM25_K1, b: float = S.BM25_B) -> Channel:
    return Channel(_bm25_scorer(k1, b, _CELLS), ("tokens",), ("terms", "idfs", "avg_len"), floor=0.0)


def bm25_hits(memories: DataFrame, questions: DataFrame, k: int = S.RRF_CANDIDATES, strategy: str = "auto",
              text: str = "content", query: str = "query", **sizes: int) -> DataFrame:
    """The best *k* memories of each question that share a term with it."""
    held = tokenised(memories, text)
    # Written once: the plan of the scoring step depends on its measured size.
    weighted = cut_lineage(weighted_questions(held, questions, query))
    return top_hits(held, weighted, k, bm25_channel(), strategy=strategy, **sizes)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, lexical_weight: float = 1.0,
         rank_constant: int = S.RRF_K, candidates: int = S.RRF_CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion of two candidate lists (query_id, id, seq, p)."""
    share = lambda df, w: df.where(F.col("p") <= candidates).select(
        "query_id", "id", "seq", (F.lit(float(w)) / (F.col("p") + rank_constant)).alias("part"))
    # A union and one grouped sum: an item is in each list at most once.
    summed = (share(dense, 1.0).unionByName(share(lexical, lexical_weight))
              .groupBy("query_id", "id", "seq").agg(F.round(F.sum("part"), S.SCORE_DECIMALS).alias("score")))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return summed.withColumn("p", F.row_number().over(best)).where(F.col("p") <= k)
