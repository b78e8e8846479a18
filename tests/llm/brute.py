"""Second versions of the operators, in plain Python, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

GAPS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def pii(text: str | None) -> list[tuple[int, int, str, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = GAPS.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 5)}
    lines = [line for line in text.split("\n") if GAPS.search(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(text, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = word.findall(lowered(text))
    hit, ids = set(), set()
    for item_id, item in items:
        wanted = word.findall(lowered(item))
        n = min(width, len(wanted))
        if not n:
            continue
        windows = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)}
        for at in range(len(found) - n + 1):
            if tuple(found[at : at + n]) in windows:
                hit.update(range(at, at + n))
                ids.add("" if item_id is None else str(item_id))
    return len(found), len(hit), sorted(ids)


def shingles(text: str | None, size: int) -> frozenset:
    words = GAPS.findall(lowered(text))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(rows: list[tuple[int, str | None]], size: int, num: int, den: int) -> dict[int, int]:
    """Smallest id reachable by links, per id; every pair is compared."""
    sets = {key: shingles(text, size) for key, text in rows}
    up = {key: key for key in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                a_top, b_top = top(a), top(b)
                up[max(a_top, b_top)] = min(a_top, b_top)
    return {key: top(key) for key in keys}


def turns(rows):
    """Conversations as lists of (role, text), by turn, role and text."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role or "", text or ""))
    return {conv: [(r, t) for _, r, t in sorted(v)] for conv, v in out.items()}
