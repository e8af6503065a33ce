"""Hashes of a text's word shingles."""

from __future__ import annotations

import xxhash

SEED = 42


def hashes(text: str, size: int) -> list[int]:
    """64 bits per run of ``size`` words, A-Z in lower case; a shorter text is one run, and one
    without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(joined, SEED)]
    starts, at = [0] * len(words), 0
    for i, word in enumerate(words):
        starts[i] = at
        at += len(word) + 1
    starts += [at]
    return [digest(joined[s : e - 1], SEED) for s, e in zip(starts, starts[size:])]
