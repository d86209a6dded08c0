"""Hashes of word shingles."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included, after lower-casing A-Z.

    With fewer words the whole sequence is the one shingle; with none there is
    no shingle.
    """
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(tokens)
    if len(tokens) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    ends = list(itertools.accumulate(map(len, tokens), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    count = len(tokens) - size + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :])), np.uint64, count)
