"""Orders of a selected set. None of them adds or drops a memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _placed(taken: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``pos`` (from 0) by *order*; a question holds at most the return limit."""
    by = W.partitionBy("query_id").orderBy(*order)
    return taken.withColumn("pos", F.row_number().over(by) - 1)


def relevance(taken: DataFrame) -> DataFrame:
    """The order of selection."""
    return _placed(taken, "take")


def raw_first(taken: DataFrame) -> DataFrame:
    """Verbatim turns, then facts, each by selection."""
    return _placed(taken, F.col("kind") != "raw", "take")


def fact_first(taken: DataFrame) -> DataFrame:
    return _placed(taken, F.col("kind") == "raw", "take")


def sandwich(taken: DataFrame) -> DataFrame:
    """The better half of the verbatim turns, the facts, the other half."""
    kinds = W.partitionBy("query_id", "kind")
    nth = F.row_number().over(kinds.orderBy("take"))
    of = F.count("*").over(kinds)
    part = F.when(F.col("kind") != "raw", 1).when(nth <= F.ceil(of / 2), 0).otherwise(2)
    return _placed(taken.withColumn("_part", part), "_part", "take").drop("_part")


def shuffled(taken: DataFrame, seed: int = 0) -> DataFrame:
    """A reproducible random order, the control arm of ordering comparisons."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("id").cast("string")))
    return _placed(taken, draw, "take")


ORDERINGS = {"raw_first": raw_first, "fact_first": fact_first, "relevance": relevance, "sandwich": sandwich,
             "random": shuffled}


def ordered(taken: DataFrame, name: str) -> DataFrame:
    if name not in ORDERINGS:
        raise ValueError(f"unknown ordering {name!r}: use one of {sorted(ORDERINGS)}")
    return ORDERINGS[name](taken)
