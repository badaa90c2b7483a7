"""Word shingles of whole texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from docloom.llm.common import WordHashes, mix64

#: Odd multipliers, one for each place in a shingle.
PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


class ShingleSets:
    """The distinct k-word shingles of a text, sorted; words are what ASCII white space
    parts, A-Z lower-cased. Fewer than k words are one shingle, none an empty set."""

    def __init__(self, k: int = 5):
        self.k, self.hashes = k, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        k = min(self.k, len(words))
        w = self.hashes(words)
        n = len(w) - k + 1
        h = np.full(n, np.uint64(k))
        for i in range(k):
            h += w[i : i + n] * PLACES[i]
        return np.unique(mix64(h))
