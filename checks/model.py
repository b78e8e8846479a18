"""A stand-in for a served embedding model, for checks and tests only."""

from __future__ import annotations

import hashlib

import numpy as np

from catalith.operators.embed import ModelFactory


class HashingModel:
    """Deterministic stand-in for a served model: signed counts of hashed words.

    Components are whole numbers, so products of two vectors are exact.
    """

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self._known: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        """Twice the place of a word, plus one where it counts positively."""
        slot = self._known.get(word)
        if slot is None:
            digest = hashlib.md5(word.encode()).hexdigest()
            slot = 2 * (int(digest[:8], 16) % self.dim) + int(digest[8:10], 16) % 2
            if len(self._known) < 1_000_000:
                self._known[word] = slot
        return slot

    def __call__(self, texts: list[str]) -> list[list[float]]:
        vectors = []
        for text in texts:
            slots = np.fromiter(map(self._slot, text.split()), dtype=np.int64)
            counts = np.bincount(slots, minlength=2 * self.dim)
            vectors.append((counts[1::2] - counts[0::2]).astype(float).tolist())
        return vectors


def hashing_model(dim: int) -> ModelFactory:
    return lambda: HashingModel(dim)
