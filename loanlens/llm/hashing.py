"""Hashes of words and integers, the same in every process."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from .common import remembers

WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 150_000          # words a worker remembers
_known: dict[str, int] = {}
remembers(__name__, _known.clear)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher: a 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word."""
    got = list(map(_known.get, words))
    if None in got:
        if len(_known) > CACHE_WORDS:
            _known.clear()
        for i, (w, h) in enumerate(zip(words, got)):
            if h is None:
                h = _known.get(w)
                if h is None:
                    digest = hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest()
                    h = _known[w] = int.from_bytes(digest, "little")
                got[i] = h
    return np.array(got, np.uint64)
