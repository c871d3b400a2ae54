"""Vectorised runs of residues (shingles) for batches of strings."""

from __future__ import annotations

import numpy as np

RUN = 5
_BITS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owner) of all letters: A-Z as 1-26, owner is the text's place."""
    joined = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    return (joined - 64).astype(np.int64), np.repeat(np.arange(len(texts)), lengths)


def all_runs(texts: list[str], k: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, code) of every run of k letters; places count over all letters of all texts."""
    codes, owner = letters(texts)
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    run = np.zeros(n, np.int64)
    for i in range(k):
        run = (run << _BITS) | codes[i : i + n]
    whole = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return owner[whole], whole, run[whole]


def runs(texts: list[str], k: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(owner, code): the distinct runs of k letters of each text, sorted by owner and code."""
    owner, _, code = all_runs(texts, k)
    both = (owner << (_BITS * k)) | code
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both >> (_BITS * k), both & ((1 << (_BITS * k)) - 1)


def similar_pairs(a: list[str], b: list[str], share: float) -> np.ndarray:
    """For each pair of texts whether runs in both number at least share of those in either; two texts without runs don't."""
    oa, ca = runs(a)
    ob, cb = runs(b)
    n = len(a)
    size = np.bincount(oa, minlength=n) + np.bincount(ob, minlength=n)
    both = np.concatenate([(oa << (_BITS * RUN)) | ca, (ob << (_BITS * RUN)) | cb])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]] >> (_BITS * RUN)
    common = np.bincount(twice, minlength=n)
    return (common > 0) & (common >= share * (size - common))
