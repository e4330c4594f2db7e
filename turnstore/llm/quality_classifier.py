"""Ordinal cumulative-link regression on graded ratings, over hashed text features.

P(grade <= k) = logistic(threshold_k - w.x): all grades share the weights w, and the
thresholds are ordered. x marks which hashed words a text holds and in which interval
its shares of symbols, capitals and repeated words lie. The weights are learnt on a
bounded sample of rated documents; features whose pull is not beyond chance weigh
nothing, so long documents are not judged by noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from turnstore.llm.words import alnum_words, list_array, raw_texts, spaced_words

HASH_BITS = 18
# Rated documents the weights are learnt on: about so many, chosen by a hash of their ids.
SAMPLE_ROWS = 12_000
ROUNDS = 400
# Standard deviations by which a feature's pull must exceed chance; most features used.
LEAST_PULL = 5.0
MOST_FEATURES = 512
# Both the L1 and the L2 penalty of a weight.
PENALTY = 1.0
# A document stays if its best grade is at least this likely.
KEEP_TAIL = 0.5

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_STEPS = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])


def features(raw: bytes | None) -> np.ndarray:
    """Distinct feature numbers of a text; null is the empty text."""
    raw = raw or b""
    words: set[bytes] = set()
    for piece in alnum_words(raw):
        words.update(piece)
    n_spaced = distinct = 0
    for piece in spaced_words(raw):
        n_spaced += len(piece)
        distinct += len(set(piece))
    size = max(1, len(raw))
    shares = (sum(map(raw.count, (bytes([b]) for b in _SYMBOLS))) / size, (len(raw) - len(raw.translate(None, _UPPER))) / size,
              raw.count(b"!") / size, 1 - distinct / max(1, n_spaced))
    marks = [b"%d\x00%d" % (i, np.searchsorted(_STEPS, share, "right")) for i, share in enumerate(shares)]
    marks.append(b"n\x00%d" % n_spaced.bit_length())
    found = np.fromiter(map(zlib.crc32, [*words, *marks]), np.uint32)
    return np.unique(found >> np.uint32(32 - HASH_BITS)).astype(np.int32)


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; grades are 0 to len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[found].sum(), -50, 50)))


def _probabilities(eta: np.ndarray, thresholds: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= its own) and P(grade < its own) of each row."""
    return tuple(1 / (1 + np.exp(np.clip(eta - edge[grades], -40, 40))) for edge in (
        np.append(thresholds, 80.0), np.concatenate(([-80.0], thresholds))))


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = 3, rounds: int = ROUNDS,
        least_pull: float = LEAST_PULL, most_features: int = MOST_FEATURES) -> OrdinalModel:
    """Maximum likelihood by accelerated proximal gradient steps over the telling features.

    A feature tells something if its pull on the model without weights exceeds chance
    by *least_pull* standard deviations; the strongest *most_features* are used, the
    others weigh nothing. Grades that never occur get half a count for the thresholds,
    so they stay finite. No rows: all grades are equally likely for every text.
    """
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    below = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(below / (1 - below))
    size, n = 1 << HASH_BITS, len(rows)
    weights = np.zeros(size, np.float32)
    if not n:
        return OrdinalModel(weights, thresholds)
    lengths = np.array([len(r) for r in rows])
    index, of = np.concatenate(rows), np.repeat(np.arange(n), lengths)
    upto, less = _probabilities(np.zeros(n), thresholds, grades)
    slope = upto + less - 1
    slope -= slope.mean()
    seen = np.bincount(index, minlength=size)
    chance = np.sqrt(np.maximum(seen * (1 - seen / n) * slope.var(), 1e-9))
    pull = np.abs(np.bincount(index, weights=slope[of], minlength=size)) / chance
    pull[(seen < 2) | (seen == n)] = 0
    chosen = np.argsort(-pull, kind="stable")[:most_features]
    chosen = chosen[pull[chosen] > least_pull]
    if not len(chosen):
        return OrdinalModel(weights, thresholds)
    column = np.full(size, -1)
    column[chosen] = np.arange(len(chosen))
    known = column[index] >= 0
    table = np.zeros((n, len(chosen)), np.float32)
    table[of[known], column[index[known]]] = 1
    top = np.ones(len(chosen), np.float32)
    for _ in range(20):
        top = table.T @ (table @ top)
        top /= np.linalg.norm(top)
    rate = 1 / (0.5 * float(top @ (table.T @ (table @ top))) + PENALTY)
    own = ahead = np.zeros(len(chosen), np.float32)
    turn = 1.0
    for _ in range(rounds):
        upto, less = _probabilities(table @ ahead, thresholds, grades)
        gain = table.T @ (1 - upto - less).astype(np.float32) + PENALTY * ahead
        fresh = ahead - rate * gain
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - rate * PENALTY, 0)
        following = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        ahead = fresh + np.float32((turn - 1) / following) * (fresh - own)
        own, turn = fresh, following
        span = np.maximum(upto - less, 1e-9)
        rise, fall = upto * (1 - upto) / span, less * (1 - less) / span
        for k in range(len(thresholds)):
            at, over = grades == k, grades == k + 1
            thresholds[k] += np.clip(2 * (rise[at].sum() - fall[over].sum()) / n, -0.5, 0.5)
        thresholds = np.maximum.accumulate(thresholds + np.arange(len(thresholds)) * 1e-6)
    weights[chosen] = own
    return OrdinalModel(weights, thresholds)


def graded_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 toxic, 1 neither toxic nor of quality, 2 of quality.

    Rows without id or without both labels are ignored; of repeated ids the lowest grade counts.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return (labels.where("doc_id is not null and toxic is not null and quality is not null")
            .select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade")))


def learn(docs: DataFrame, rated: DataFrame, sample_rows: int = SAMPLE_ROWS, n_grades: int = 3) -> OrdinalModel:
    """A model from about *sample_rows* of the rated documents (doc_id, grade)."""
    total = rated.count()
    if total > sample_rows:
        rated = rated.where(F.pmod(F.xxhash64(F.lit("rated"), "doc_id"), F.lit(1_000_000))
                            < F.lit(int(1_000_000 * sample_rows / total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(raw) for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_pydict({"grade": batch.column("grade").cast(pa.int32()),
                                              "found": list_array(found, pa.int32())})

    # The sample is bounded, so its ids can go to every task.
    chosen = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("grade", "text")
    schema = StructType([StructField("grade", IntegerType()), StructField("found", ArrayType(IntegerType()))])
    got = chosen.mapInArrow(run, schema).toArrow()
    order = sorted(zip(got.column("grade").to_pylist(), (np.asarray(x.values) for x in got.column("found"))),
                   key=lambda x: (x[0], x[1].tobytes()))
    return fit([f for _, f in order], np.array([g for g, _ in order], np.int64), n_grades)


def score(docs: DataFrame, model: OrdinalModel, keep_tail: float = KEEP_TAIL, columns: list[str] | None = None) -> DataFrame:
    """Per row: *columns* (doc_id), expected_grade, tail (P(grade > k) per k), kept.

    Null and empty texts are scored by their (empty) features alone.
    """
    columns = columns or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            tails = [own.tails(features(raw)) for raw in raw_texts(batch, "_text")]
            kept = [bool(t[-1] >= keep_tail) for t in tails]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {
                "expected_grade": pa.array([float(t.sum()) for t in tails], pa.float64()),
                "tail": list_array(tails, pa.float64()), "kept": pa.array(kept, pa.bool_())})

    fields = [docs.schema[c] for c in columns] + [StructField("expected_grade", DoubleType()),
                                                  StructField("tail", ArrayType(DoubleType()))]
    schema = StructType(fields).add("kept", "boolean")
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def keep_accepted(docs: DataFrame, labels: DataFrame, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """*docs* without the documents that the model, learnt on *labels*, rejects."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, graded_labels(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [bool(sent.value.tails(features(raw))[-1] >= keep_tail) for raw in raw_texts(batch)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
