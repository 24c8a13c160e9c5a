"""Word shingles and their MinHash bands.

A text has 32 bands of 4 minima each; a pair with a Jaccard similarity of 0.8 shares none with a chance under 1e-7.
:mod:`near` takes the shingles and the identity of a text from here; no query uses the bands.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from . import common

SEED = 42
SHINGLE = 5
BANDS, ROWS = 32, 4
PIECE = 1 << 12


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)], np.uint64))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def bands(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), PIECE):
        low = np.minimum(low, (a * hashes[at : at + PIECE] + b).min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def node_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))
