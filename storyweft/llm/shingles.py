"""Words, their hashes and rolling hashes of word runs, for whole batches of texts at once."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"[^\W_]+").findall
PRIME = np.uint64(0x100000001B3)
CACHE = 500_000  # distinct words kept by a worker


class Hasher:
    """64-bit hashes of words, kept between texts up to a fixed number."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return out

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and where each text begins (one more than there are texts)."""
        flat: list[int] = []
        ends = [0]
        for t in texts:
            if t:
                flat += self(WORDS(t.lower()))
            ends.append(len(flat))
        return np.array(flat, np.uint64), np.array(ends, np.int64)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; empty if there are fewer words. Runs across two texts are included."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = (out + hashes[i : i + len(out)]) * PRIME
        out ^= out >> np.uint64(29)
    return out


def inside(ends: np.ndarray, count: int, n: int) -> np.ndarray:
    """Which of ``count`` runs of n words lie inside one text."""
    ok = np.ones(count, bool)
    for e in ends[1:-1]:
        ok[max(0, e - n + 1) : max(0, min(e, count))] = False
    return ok
