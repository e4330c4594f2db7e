"""Repeated runs of two arms: sign test, majority labels, spread.

Input rows are (arm, run, question_id, category, right).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def run_spread(judged: DataFrame) -> DataFrame:
    """Mean and sample deviation of the run accuracies of each arm."""
    runs = judged.groupBy("arm", "run").agg(F.avg(F.col("right").cast("int")).alias("accuracy"))
    return runs.groupBy("arm").agg(
        F.count("*").alias("runs"), F.avg("accuracy").alias("mean"),
        F.stddev_samp("accuracy").alias("sd"), F.min("accuracy").alias("worst"), F.max("accuracy").alias("best"))


def arm_flips(left: DataFrame, right: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Questions only one side answers right. Both sides: question_id, right (and *by*)."""
    by = by or []
    pairs = left.select("question_id", *by, F.col("right").alias("a")).join(
        right.select("question_id", F.col("right").alias("b")), "question_id")
    return pairs.groupBy(*by).agg(
        F.count_if(~F.col("a") & F.col("b")).alias("fixes"), F.count_if(F.col("a") & ~F.col("b")).alias("breaks"),
        F.count("*").alias("n")).withColumn("net", F.col("fixes") - F.col("breaks"))


# Steps of the continued fraction; it converges in far fewer than this from the side it is used on.
FRACTION_STEPS = 200
# Below so many, the terms of the tail are added up one by one.
SHORT_TAIL = 64


def _half_binomial(k: Column, n: Column) -> Column:
    """P(X = k) for X ~ Bin(n, 1/2) and large k and n - k.

    Stirling's series and the deviance from n / 2, so that nothing large cancels.
    """

    def rest(x):
        return 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))

    k, n = k.cast("double"), n.cast("double")
    off = (n - 2 * k) / n
    deviance = n / 2 * ((1 + off) * F.log1p(off) + (1 - off) * F.log1p(-off))
    return F.exp(rest(n) - rest(k) - rest(n - k) - deviance) * F.sqrt(n / (2 * math.pi * k * (n - k)))


def _fraction_tail(small: Column, n: Column) -> Column:
    """P(X <= small) for X ~ Bin(n, 1/2), small < n / 2: the incomplete beta function I_1/2(n - small, small + 1).

    Lentz's continued fraction in a fixed number of steps, whatever the counts are.
    """
    a, b = (n - small).cast("double"), (small + 1).cast("double")
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    d0 = 1 / safe(1 - (a + b) * 0.5 / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def both(state, m):
        m = m.cast("double")
        even = m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))
        c, d, h = state["c"], state["d"], state["h"]
        # Arrays of one element bind a value, so that it is computed once.
        first = F.transform(F.array(F.struct((1 / safe(1 + even * d)).alias("d"), safe(1 + even / c).alias("c"))), lambda s: F.struct(
            s["c"].alias("c"), s["d"].alias("d"), (h * s["c"] * s["d"]).alias("h")))
        second = F.transform(first, lambda s: F.struct(
            safe(1 + odd / s["c"]).alias("c"), (1 / safe(1 + odd * s["d"])).alias("d"), s["h"].alias("h")))
        return F.transform(second, lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h")))[0]

    steps = F.sequence(F.lit(1), F.lit(FRACTION_STEPS))
    h = F.aggregate(steps, start, both)["h"]
    return _half_binomial(small, n) / 2 * h


def _summed_tail(small: Column, n: Column) -> Column:
    """The same for few terms, whose logarithms grow by log((n-i+1)/i); kept relative to the largest."""
    start = F.struct(F.lit(0.0).alias("log_term"), F.lit(1.0).alias("tail"))
    steps = F.when(small > 0, F.sequence(F.lit(1).cast("bigint"), F.least(small, F.lit(SHORT_TAIL)))).otherwise(F.array().cast("array<bigint>"))

    def step(state, i):
        grow = F.log((n - i + 1) / i)
        return F.struct((state["log_term"] + grow).alias("log_term"),
                        (state["tail"] * F.exp(-grow) + 1.0).alias("tail"))

    total = F.aggregate(steps, start, step)
    return F.exp(total["log_term"] + F.log(total["tail"]) - n * F.log(F.lit(2.0)))


def sign_test(flips: DataFrame) -> DataFrame:
    """Add ``p_value``: the two-sided exact binomial tail of fixes against breaks.

    The work per row is fixed: short tails are sums of at most SHORT_TAIL terms, longer ones a
    continued fraction of the incomplete beta function, so billions of flips cost as much as ten.
    """
    n = F.col("fixes") + F.col("breaks")
    small = F.least("fixes", "breaks")
    tail = F.when(small <= SHORT_TAIL, _summed_tail(small, n)).otherwise(_fraction_tail(small, n))
    even = (n == 0) | (2 * small == n)
    return flips.withColumn("p_value", F.when(even, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def majority(judged: DataFrame) -> DataFrame:
    """One row per arm and question: the majority label, and whether all runs agree."""
    hit = F.col("right").cast("int")
    return judged.groupBy("arm", "question_id", "category").agg(
        (F.sum(hit) * 2 > F.count("*")).alias("right"), (F.min(hit) == F.max(hit)).alias("stable"))


def stable_questions(voted: DataFrame) -> DataFrame:
    """Questions whose runs agree within every arm."""
    return voted.groupBy("question_id").agg(F.min(F.col("stable").cast("int")).alias("_s")).where("_s = 1").drop("_s")
