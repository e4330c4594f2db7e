"""Words, shingles and hashes of raw UTF-8 text, as numpy arrays inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Longest stretch of a text that is held as a list of words at once.
PIECE_BYTES = 1 << 20
# Most words whose hash one task remembers.
CACHE_WORDS = 250_000
SHINGLE_WORDS = 5

SPACE = re.compile(rb"[\x20\x09-\x0d]")
# Sought in raw text, so A-Z are no gaps.
_ALNUM = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_U = np.uint64
# Odd multipliers, one per place in a shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                    0xFF51AFD7ED558CCD, 0xA0761D6478BD642F], dtype=_U)
# Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a space.
_TO_ALNUM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def _pieces(raw: bytes, gap: re.Pattern) -> Iterator[bytes]:
    """*raw* in pieces that end at a gap between words, so that memory stays bounded."""
    start = 0
    while len(raw) - start > PIECE_BYTES:
        cut = gap.search(raw, start + PIECE_BYTES)
        if cut is None:
            break
        yield raw[start:cut.start()]
        start = cut.start()
    yield raw[start:] if start else raw


def spaced_words(raw: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, piece by piece."""
    for piece in _pieces(raw, SPACE):
        yield piece.split()


def alnum_words(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters, digits and non-ASCII characters, piece by piece."""
    for piece in _pieces(raw, _ALNUM):
        yield piece.translate(_TO_ALNUM).split()


class WordHashes(dict):
    """A 64-bit hash per word, remembered within a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, pieces: Iterator[list[bytes]]) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, words), _U, len(words)) for words in pieces]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    values = values ^ (values >> _U(30))
    values = values * _U(0xBF58476D1CE4E5B9)
    values = values ^ (values >> _U(27))
    values = values * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, in order; of the whole text if it is shorter."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    size = min(n, SHINGLE_WORDS)
    total = np.full(n - size + 1, size if n < SHINGLE_WORDS else 0, _U) * _PLACES[-1]
    for place in range(size):
        total += words[place:n - size + 1 + place] * _PLACES[place]
    return mix(total)


def list_array(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.ListArray:
    """One list per entry of *parts*, without a Python object per value."""
    lengths = [0 if p is None else len(p) for p in parts]
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    full = [p for p in parts if p is not None and len(p)]
    values = np.concatenate(full) if full else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
