"""Sets of word shingles as sorted 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once; longer texts are cut at white space.
PIECE = 1 << 18
_U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(name: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        steps = np.full(size, base, _U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=_U)
        if size <= 2 * PIECE:  # one very long word does not stay in memory
            _POWERS[name] = have
    return have[:n]


def _hash_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a piece: polynomials of their bytes."""
    gap = _GAP[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    terms = (data.astype(_U) + _U(1)) * _powers("up", _BASE, len(data))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(terms, dtype=_U)])
    down = _powers("down", _INVERSE, len(data) + 1)
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)), starts


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, A-Z lower-cased, and the bytes where they start."""
    buffer = np.frombuffer(data.lower(), np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = min(at + PIECE, len(buffer))
        while end < len(buffer) and not _GAP[buffer[end]]:
            gaps = np.nonzero(_GAP[buffer[end : end + PIECE]])[0]
            end = end + int(gaps[0]) if len(gaps) else min(end + PIECE, len(buffer))
        found, places = _hash_piece(buffer[at:end])
        hashes.append(found)
        starts.append(places + at)
        at = end
    if not hashes:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _sets(words: np.ndarray, counts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    weights = mix(np.arange(1, size + 1, dtype=_U) * _U(_BASE)) | _U(1)
    short = mix(np.arange(size, dtype=_U) * _U(0xA0761D6478BD642F))
    n = len(words) - size + 1
    if n > 0:
        sums = np.zeros(n, _U)
        for k in range(size):
            sums += words[k : n + k] * weights[k]
        sums = mix(sums)
    at = 0
    for count in counts.tolist():
        if count >= size:
            yield np.unique(sums[at : at + count - size + 1])
        elif count:
            whole = np.append(words[at : at + count] * weights[:count], short[count])
            yield mix(whole.sum(dtype=_U, keepdims=True))
        else:
            yield np.zeros(0, _U)
        at += count


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The set of each text, as sorted distinct hashes of ``size`` words in a row.

    A text of fewer words has one shingle, all of them; one without words has none.
    """
    at = 0
    while at < len(texts):
        end, room = at, PIECE
        while end < len(texts) and (end == at or len(texts[end]) < room):
            room -= len(texts[end]) + 1
            end += 1
        group = texts[at:end]
        words, starts = hash_words(b"\n".join(group))
        lengths = np.array([len(t) + 1 for t in group])
        ends = np.searchsorted(starts, np.cumsum(lengths))
        yield from _sets(words, np.diff(np.concatenate([[0], ends])), size)
        at = end
