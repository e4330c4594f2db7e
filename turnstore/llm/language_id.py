"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of the n-grams (one to three characters) of labelled texts give a matrix of log
probabilities, slots x languages, that goes to every task; a text's score is the sum
of the rows its n-grams hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SLOT_BITS = 14
# Labelled texts the matrix is learnt on: about so many, chosen by a hash of their ids.
SAMPLE_ROWS = 20_000
# Characters handled at once.
PIECE_CHARS = 1 << 20
UNKNOWN = "und"
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
# ASCII letters in lower case; everything else below 128 is a gap.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in (ord(chr(i).lower()) for i in range(128))], np.uint32)


def _characters(text: str) -> np.ndarray:
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = found < 128
    return np.where(plain, _PLAIN[np.where(plain, found, 0)], found)


def has_letter(text: str) -> bool:
    if text.isascii():
        return any(map(str.isalpha, set(text)))
    return any(c.isalpha() for c in set(text))


def gram_slots(text: str) -> np.ndarray:
    """Slots of all n-grams of one to three characters, with gaps at both ends."""
    c = np.concatenate(([np.uint32(32)], _characters(text), [np.uint32(32)])).astype(np.uint32)
    shift = np.uint32(32 - SLOT_BITS)
    parts, total = [], np.zeros(len(c), np.uint32)
    for size in range(3):
        if len(c) <= size:
            break
        total = total[:len(c) - size] * np.uint32(31) + c[size:] * _FACTORS[size]
        parts.append((total * np.uint32(0x27D4EB2F) + np.uint32(size)) >> shift)
    return np.concatenate(parts)


def gram_counts(text: str) -> np.ndarray:
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for start in range(0, max(1, len(text)), PIECE_CHARS):
        counts += np.bincount(gram_slots(text[start:start + PIECE_CHARS]), minlength=1 << SLOT_BITS)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its posterior probability; ``und`` and 0 without a letter."""
        if not self.languages or text is None or not has_letter(text):
            return UNKNOWN, 0.0
        if len(text) < 4096:
            scores = self.matrix[gram_slots(text)].sum(axis=0, dtype=np.float64)
        else:
            scores = gram_counts(text) @ self.matrix.astype(np.float64)
        best = int(np.argmax(scores))
        return self.languages[best], float(1 / np.exp(scores - scores[best]).sum())


def learn(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from about *sample_rows* of *texts* (doc_id, text, lang).

    Rows without language, or whose text is null or has no letter, teach nothing; no
    rows give a model that answers ``und``. Languages are equally likely beforehand.
    """
    known = texts.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    total = known.count()
    if total > sample_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1_000_000))
                            < F.lit(int(1_000_000 * sample_rows / total)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + gram_counts(text)
        for lang, counts in sums.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(slots), pa.string()),
                                              "slot": pa.array(slots, pa.int64()), "n": pa.array(counts[slots], pa.int64())})

    got = (known.select("text", "lang").mapInArrow(count, "lang string, slot long, n long")
           .groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow())
    languages = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((1 << SLOT_BITS, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[got.column("slot").to_numpy(), [place[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    smooth = counts + 0.5
    return LanguageModel(languages, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, columns: list[str] | None = None) -> DataFrame:
    """Per row: *columns* (doc_id), lang_pred, score; the text alone decides.

    Null texts and texts without a letter are ``und`` with score 0; of equally likely
    languages the first in alphabetical order is taken. Long texts are counted in pieces.
    """
    columns = columns or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(text) for text in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | {
                "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64())})

    schema = StructType([docs.schema[c] for c in columns] + [
        StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)
