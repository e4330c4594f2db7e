"""Text to vectors, and arithmetic on vector columns.

An embedder is any picklable callable that returns a *batch function*; the batch
function maps a list of texts to a float matrix. It is built once per Python
worker, so a model is loaded once and reused for every Arrow batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from turnstore import settings as S
from turnstore.schemas import VECTOR

BatchEncoder = Callable[[list[str]], np.ndarray]
Embedder = Callable[[], BatchEncoder]

_WORD = re.compile(r"[^\W_]+")


def hashed_embedder(dim: int = 64) -> Embedder:
    """Bag of words hashed into *dim* buckets: needs no model and no network."""

    def build() -> BatchEncoder:
        buckets: dict[str, int] = {}

        def bucket(word: str) -> int:
            found = buckets.get(word)
            if found is None:
                if len(buckets) > 500_000:
                    buckets.clear()
                found = buckets[word] = int(md5(word.encode("utf-8")).hexdigest()[:4], 16) % dim
            return found

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                hits = [bucket(word) for word in _WORD.findall(text.lower())]
                if hits:
                    out[row] = np.bincount(hits, minlength=dim)
            return out

        return encode

    return build


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; an all-zero row stays zero."""
    norms = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (matrix / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed(text: Column, embedder: Embedder, is_query: bool = False, batch_size: int | None = S.EMBED_BATCH,
          skip_nulls: bool = False) -> Column:
    """Unit vectors of *text*; a question carries the retrieval instruction.

    The model gets at most *batch_size* texts at once (None: a whole Arrow batch). Missing texts
    are embedded as empty ones; with *skip_nulls* the model does not see them and they have no vector.
    """

    @F.arrow_udf(VECTOR)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = embedder()
        for texts in batches:
            texts = texts if skip_nulls else texts.fill_null("")
            known = texts.drop_null()
            step = batch_size or max(1, len(known))
            # Texts become Python strings as the model gets them, not a whole Arrow batch at once.
            parts = [unit_rows(model(known.slice(i, step).to_pylist())) for i in range(0, len(known), step)]
            matrix = np.concatenate(parts) if parts else np.zeros((0, 1), np.float32)
            present = texts.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(present * matrix.shape[1]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()), mask=pa.array(~present))

    return encode(F.concat(F.lit(S.QUERY_PREFIX), text) if is_query else text)


def blend(query_vec: Column, recall_vec: Column, weight: float = S.RECALL_WEIGHT) -> Column:
    """One vector whose dot product is the fused score of both channels.

    ``(1-w)(m.q) + w(m.r) = m.((1-w)q + w r)``: blending first halves the scoring
    work. Without a recall vector the query vector is used alone; the result is
    not normalised again.
    """
    mixed = F.zip_with(
        query_vec, recall_vec,
        lambda q, r: q.cast("double") * F.lit(1.0 - weight) + r.cast("double") * F.lit(weight))
    return F.when(recall_vec.isNull(), F.transform(query_vec, lambda q: q.cast("double"))).otherwise(mixed)
