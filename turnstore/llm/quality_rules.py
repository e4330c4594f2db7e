"""Quality rules with risk-controlled thresholds.

Base rules are fixed. The cutoffs of further measures are selected per stratum on a
labelled holdout: a cutoff is allowed only if an exact binomial bound says that it
rejects at most a given share of good documents. Cutoffs of one measure are tried in a
fixed sequence, from the mildest to the first that fails, which needs no correction;
the doubt is divided among all measures and strata (Bonferroni). The strictest allowed
cutoff of each measure applies; a stratum with too few labels gets none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnstore.llm.words import WordHashes, raw_texts, shingle_hashes, spaced_words
from turnstore.runtime import cut_lineage

# Most good documents that a rule may reject, and the chance of being wrong about it.
RISK = 0.005
DOUBT = 0.05
# Measures are shares in thousandths, so a stratum has at most so many cutoffs each.
STEPS = 1001
LEAST_WORDS = 10
_SYMBOLS = tuple(bytes([b]) for b in b"#*$%&|<>")
_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))


def measure(raw: bytes | None, hashes: WordHashes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper of a text.

    Words are runs without ASCII white space; lines without a word are not counted.
    Characters are code points. Null is the empty text.
    """
    raw = raw or b""
    words = hashes.of(spaced_words(raw))
    shingles = shingle_hashes(words) if len(words) >= 5 else np.empty(0, np.uint64)
    repeated = 0
    if len(shingles):
        _, at, counts = np.unique(shingles, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        if twice.any():
            edge = np.zeros(len(words) + 1, np.int64)
            edge[:len(twice)] += twice
            edge[5:5 + len(twice)] -= twice
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    points = len(raw.translate(None, _FOLLOWING))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words), points - spaces, sum(map(raw.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated,
            len(lines), upper)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
# Measure of a rule -> numerator and denominator.
SHARES = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"),
          "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars")}


def measures(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Per row of *docs*: *columns* and the counts of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = np.array([measure(raw, hashes) for raw in raw_texts(batch, "_text")], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns}
                                             | {n: pa.array(found[:, i]) for i, n in enumerate(COUNTS)})

    schema = StructType([docs.schema[c] for c in columns] + [StructField(n, LongType()) for n in COUNTS])
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def share(name: str) -> Column:
    """A measure in whole thousandths, rounded down; 1000 at most."""
    top, below = SHARES[name]
    return F.least(F.lit(STEPS - 1), F.floor(1000 * F.col(top) / F.greatest(F.lit(1), F.col(below)))).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws of chance p: a regularised incomplete beta function, by continued fraction."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, p)
    return _beta_fraction(a, b, x)


def _beta_fraction(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def most_rejected(n: int, risk: float, doubt: float) -> int:
    """The largest k for which k rejected of n good documents prove a risk below *risk*; -1 if none.

    That is the exact one-sided (Clopper-Pearson) bound: P(X <= k | n, risk) <= doubt.
    """
    low, high = -1, n
    while low < high:
        middle = (low + high + 1) // 2
        if binomial_at_most(middle, n, risk) <= doubt:
            low = middle
        else:
            high = middle - 1
    return low


def cutoffs(measured: DataFrame, good: DataFrame, stratum: str, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, measure, cutoff): the strictest allowed cutoff of each measure and stratum.

    *measured* has doc_id, the stratum and the counts; *good* the doc_ids labelled good.
    A document fails where its measure is above the cutoff. Base failures are left out:
    the rules here judge what the base keeps. Strata without a row get no rule.
    """
    held = measured.join(good.select("doc_id").distinct(), "doc_id", "left_semi").where(~base_failed())
    bins = held.select(stratum, F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), share(name).alias("bin")) for name in SHARES])).alias("m"))
    bins = bins.groupBy(stratum, "m.measure", "m.bin").agg(F.count("*").alias("n"))
    own = W.partitionBy(stratum, "measure")
    # At most STEPS rows per stratum and measure: documents above each cutoff.
    above = bins.withColumn("n_good", F.sum("n").over(own)).withColumn(
        "n_above", F.col("n_good") - F.sum("n").over(own.orderBy("bin")))
    n_strata = max(1, bins.select(stratum).distinct().count())
    each = doubt / (n_strata * len(SHARES))

    @F.pandas_udf("long")
    def allowed(n: pd.Series) -> pd.Series:
        known = {x: most_rejected(int(x), risk, each) for x in n.unique()}
        return n.map(known)

    # n_above falls as the cutoff rises, so the sequence ends at the least bin that passes.
    sizes = above.select("n_good").distinct().withColumn("most", allowed("n_good"))
    return (above.join(sizes, "n_good").where(F.col("n_above") <= F.col("most"))
            .groupBy(stratum, "measure").agg(F.min("bin").alias("cutoff")))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """Per row of *docs* (doc_id, text, stratum): doc_id, the counts, base_failed, kept, failed_rules.

    *labels* (doc_id, quality): quality 1 is good; rows without id or label are ignored.
    Rows without a stratum are one of their own. Null and empty texts fail the base
    (too few words). Without labels only the base decides.
    """
    rows = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("_stratum"))
    measured = cut_lineage(measures(rows, ["doc_id", "_stratum"]))
    limits = cutoffs(measured, labels.where("quality = 1 and doc_id is not null"), "_stratum", risk, doubt)
    limits = limits.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("measure", "cutoff"))).alias("_limits"))
    # One row per stratum: a shuffle join that splits a hot stratum, or a broadcast of a small table.
    joined = measured.join(limits, "_stratum", "left")
    failed = F.array_compact(F.array(*[
        F.when(share(name) > F.col("_limits")[name], F.lit(name)) for name in SHARES]))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
