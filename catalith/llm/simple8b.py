"""Simple-8b: whole numbers packed into 64-bit words, coded and decoded by NumPy.

A word's upper 4 bits select how its lower 60 are divided: ``count`` numbers of ``bits``
bits, the first lowest. Selectors 0 and 1 are runs of 240 and 120 zeros. Selector 15
with 60 bits holds one number; a number of more than 60 bits is an escape: selector 15
with all 60 bits set, and the number itself in the next word. (The number of 60 set bits
is escaped as well.)

Numbers are coded in blocks of ``BLOCK``. Each starts on a word, and a list of word offsets
lets any block be decoded alone. The coder takes, at each place, the selector that packs
most numbers; all blocks of a call advance together, a word each per step.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Count and bits of each selector. Fixed values of the code.
SELECTORS = (
    (240, 0),
    (120, 0),
    (60, 1),
    (30, 2),
    (20, 3),
    (15, 4),
    (12, 5),
    (10, 6),
    (8, 7),
    (7, 8),
    (6, 10),
    (5, 12),
    (4, 15),
    (3, 20),
    (2, 30),
    (1, 60),
)
_U = np.uint64
_COUNTS = np.array([c for c, _ in SELECTORS], np.int64)
_BITS = np.array([b for _, b in SELECTORS], np.int64)
_FULL = _U((1 << 60) - 1)
#: The distinct widths: numbers below a limit need no more bits than its place among them says.
_WIDTHS = sorted(set(_BITS.tolist()))
_LIMITS = np.array([1 << bits for bits in _WIDTHS[:-1]] + [(1 << 60) - 1], _U)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=_U), "right").astype(np.uint8)
_LEVEL = [_WIDTHS.index(bits) for bits in _BITS.tolist()]


def _choices(values: np.ndarray) -> np.ndarray:
    """The selector to take at each place; 16 for an escape."""
    n = len(values)
    if values.max() < len(_SMALL):
        width = _SMALL[values.astype(np.int64)]
    else:
        width = np.searchsorted(_LIMITS, values, "right").astype(np.uint8)
    best = np.full(n, 15, np.int8)
    best[width > 14] = 16
    held = np.cumsum(np.bincount(width, minlength=16))
    border = np.zeros(n, bool)
    border[BLOCK::BLOCK] = True
    for selector in range(14, -1, -1):
        count = SELECTORS[selector][0]
        level = _LEVEL[selector]
        if held[level] < count:
            continue
        fits = width <= level
        # Runs of numbers that fit, within a block: the word may start in any that has room.
        turn = np.flatnonzero((fits[1:] != fits[:-1]) | border[1:]) + 1
        starts, ends = np.append(0, turn), np.append(turn, n)
        long = fits[starts] & (ends - starts >= count)
        starts, sizes = starts[long], (ends - starts)[long] - count + 1
        if len(starts):
            step = np.ones(int(sizes.sum()), np.int64)
            step[0] = starts[0]
            step[np.cumsum(sizes)[:-1]] = starts[1:] - (starts + sizes)[:-1] + 1
            best[np.cumsum(step)] = selector
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (little-endian) of the numbers, and the word at which each block starts."""
    values = np.ascontiguousarray(values, _U)
    n = len(values)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n)
    best = _choices(values)
    # Where each block's words begin: all blocks step on together.
    steps, at = [], np.arange(blocks, dtype=np.int64) * BLOCK
    widths = np.append(_COUNTS, 1)
    alive = np.arange(blocks)
    while len(alive):
        steps.append(np.stack([alive, at[alive]]))
        at[alive] += widths[best[at[alive]]]
        alive = alive[at[alive] < ends[alive]]
    which, start = np.concatenate(steps, axis=1)
    start = np.sort(start)
    chosen = best[start]
    escapes = chosen == 16
    take = np.minimum(chosen, 15)
    words = take.astype(_U) << _U(60)
    for selector in range(2, 16):
        count, bits = SELECTORS[selector]
        mine = np.nonzero((chosen == selector))[0]
        for k in range(count) if len(mine) else ():
            words[mine] |= values[start[mine] + k] << _U(k * bits)
    words[escapes] |= _FULL
    size = np.where(escapes, 2, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), _U)
    out[place] = words
    out[place[escapes] + 1] = values[start[escapes]]
    first = np.searchsorted(start, np.arange(blocks) * BLOCK)
    return out.astype("<u8"), place[first]


def decode(words: np.ndarray, n: int, offsets: np.ndarray | None = None) -> np.ndarray:
    """The ``n`` numbers of the words; ``offsets`` are only needed to find single blocks."""
    words = np.asarray(words).astype(_U)
    if not n:
        return np.zeros(0, _U)
    selector = (words >> _U(60)).astype(np.int64)
    full = (selector == 15) & ((words & _FULL) == _FULL)
    raw = np.zeros(len(words), bool)
    if full.any():
        # A raw word follows each escape; what looks like an escape may itself be raw.
        for place in np.nonzero(full)[0]:
            if not raw[place]:
                raw[place + 1] = True
    counts = np.where(raw, 0, _COUNTS[selector])
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.zeros(n, _U)
    for s in range(2, 16):
        count, bits = SELECTORS[s]
        mine = np.nonzero((selector == s) & ~raw)[0]
        if not len(mine):
            continue
        mask = _U((1 << bits) - 1)
        for k in range(count):
            out[begins[mine] + k] = (words[mine] >> _U(k * bits)) & mask
    escaped = np.nonzero(full & ~raw)[0]
    out[begins[escaped]] = words[escaped + 1]
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, block: int, n: int) -> np.ndarray:
    """The numbers of one block, by its offset; ``n`` is the number of all."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : end], min(BLOCK, n - block * BLOCK))
