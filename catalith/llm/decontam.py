"""Benchmark decontamination: a prefix-filtered containment join.

An item's windows are sets of ordered shingles (``GRAM`` words). A document contains a window
only if it contains all its shingles, so one shingle of each window is enough to find
it: its prefix under the order of rarity, the rarest. Rarity is counted over all
documents. A document's shingles are joined with these prefixes; a match says where
the window would lie, the length and positional bounds drop places that reach over
either end of the text, and the rest is compared word by word.

The benchmark is the query set. It is read in blocks of at most ``BLOCK_WORDS`` words,
whatever its size, and each block goes to the tasks; documents are never shuffled.

Words are runs of letters, digits and any character beyond ASCII, with A-Z lower-cased.
Defined cases: a null or empty text has no words and no hits; an item without words has no
windows, one with fewer words than a window is one window; repeated items are found each,
with their own ids, and repeated documents judged each; a null item id is listed as an
empty string. Extra columns are handed through; one named like a made one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


WINDOW = 10
GRAM = 3
#: Words of benchmark items that are matched in one pass over the documents.
BLOCK_WORDS = 1_000_000
_KEEP = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_MADE = ("n_words", "hits", "n_hit", "items", "contaminated")
_HITS = "array<struct<item:string,start:int,end:int>>"


def _split(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


class Windows:
    """A block of benchmark items: their words as numbers, windows and shingles."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int, gram: int) -> None:
        self.ids = ids
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        rows: list[list[int]] = []
        owners: list[int] = []
        for item, text in enumerate(texts):
            found = [number(w, len(self.vocabulary)) for w in _split(text)]
            whole = len(found) < window
            for at in range(1 if whole else len(found) - window + 1) if found else ():
                rows.append(found if whole else found[at : at + window])
                owners.append(item)
        self.gram, self.width = gram, window
        self.owners = np.array(owners, np.int64)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.words = np.full((len(rows), window), -1, np.int64)
        for k, row in enumerate(rows):
            self.words[k, : len(row)] = row
        # Every shingle of every window; a window shorter than a shingle is its own.
        base = len(self.vocabulary) + 1
        self.base = base
        codes, at, of = [], [], []
        for offset in range(window):
            has = (self.lengths - offset >= gram) | (offset == 0)
            take = np.nonzero(has)[0]
            codes.append(self._code(self.words[take, offset : offset + gram]))
            at.append(np.full(len(take), offset))
            of.append(take)
        self.shingle_codes = np.concatenate(codes) if rows else np.zeros(0, np.int64)
        self.shingle_at = np.concatenate(at) if rows else np.zeros(0, np.int64)
        self.shingle_of = np.concatenate(of) if rows else np.zeros(0, np.int64)
        self.shingles = np.unique(self.shingle_codes)

    def _code(self, grams: np.ndarray) -> np.ndarray:
        """One number for the words of a shingle; missing words count as -1."""
        code = np.zeros(len(grams), np.int64)
        for column in range(self.gram):
            part = grams[:, column] if column < grams.shape[1] else np.full(len(grams), -1)
            code = code * self.base + part + 1
        return code

    def choose(self, seen: np.ndarray) -> None:
        """Keep the rarest shingle of each window as its prefix; ties go to the first place."""
        rarity = seen[np.searchsorted(self.shingles, self.shingle_codes)]
        order = np.lexsort((self.shingle_at, rarity, self.shingle_of))
        first = np.unique(self.shingle_of[order], return_index=True)[1]
        best = order[first]
        by_code = best[np.argsort(self.shingle_codes[best], kind="stable")]
        self.prefix_codes = self.shingle_codes[by_code]
        self.prefix_at = self.shingle_at[by_code]
        self.prefix_of = self.shingle_of[by_code]
        del self.shingle_codes, self.shingle_at, self.shingle_of

    def numbers(self, found: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in found), np.int64, len(found))

    def text_shingles(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and places of the shingles of a text that benchmark words make up.

        The shingles of windows shorter than a shingle are told apart by length, so a
        place has one code for each length up to ``gram``.
        """
        codes, places = [], []
        known = numbers >= 0
        for length in range(1, self.gram + 1):
            if length < self.gram and not self._short(length):
                continue
            n = len(numbers) - length + 1
            if n <= 0:
                break
            ok = known[:n].copy()
            for k in range(1, length):
                ok &= known[k : n + k]
            at = np.nonzero(ok)[0]
            if len(at):
                code = np.zeros(len(at), np.int64)
                for k in range(self.gram):
                    code = code * self.base + (numbers[at + k] + 1 if k < length else 0)
                codes.append(code)
                places.append(at)
        if not codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(codes), np.concatenate(places)

    def _short(self, length: int) -> bool:
        return bool((self.lengths == length).any())

    def search(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, start, end)`` of every window in a text."""
        codes, places = self.text_shingles(numbers)
        low = np.searchsorted(self.prefix_codes, codes, "left")
        high = np.searchsorted(self.prefix_codes, codes, "right")
        counts = high - low
        if not counts.any():
            return []
        which = np.repeat(np.arange(len(codes)), counts)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        prefix = low[which] + inside
        window = self.prefix_of[prefix]
        start = places[which] - self.prefix_at[prefix]
        fits = (start >= 0) & (start + self.lengths[window] <= len(numbers))
        window, start = window[fits], start[fits]
        same = np.ones(len(window), bool)
        for k in range(self.width):
            inside_window = k < self.lengths[window]
            place = np.minimum(start + k, len(numbers) - 1)
            same &= ~inside_window | (numbers[place] == self.words[window, k])
        window, start = window[same], start[same]
        if not len(window):
            return []
        end = start + self.lengths[window]
        out = np.unique(np.stack([self.owners[window], start, end], axis=1), axis=0)
        return [tuple(row) for row in out.tolist()]


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[str], list[bytes]]]:
    """The benchmark in blocks of bounded size, in the order of ids and texts."""
    ids: list[str] = []
    texts: list[bytes] = []
    size = 0
    rows = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")),
        F.coalesce(F.col(f"`{text}`"), F.lit("")),
    )
    for name, value in rows.sortWithinPartitions(*rows.columns).toLocalIterator():
        raw = value.encode()
        count = len(_split(raw))
        if texts and size + count > BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(name)
        texts.append(raw)
        size += count
    if texts:
        yield ids, texts


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for value in batch.column(column).cast(pa.large_binary()):
        yield value.as_py() or b""


def _count(block, column: str):
    """Per task, how often each shingle of the block comes in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        known = windows.shingles
        seen = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in _texts(batch, column):
                codes, _ = windows.text_shingles(windows.numbers(_split(text)))
                at = np.searchsorted(known, codes)
                inside = at < len(known)
                at = at[inside]
                np.add.at(seen, at[known[at] == codes[inside]], 1)
        at = np.nonzero(seen)[0]
        yield pa.record_batch(
            [pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], names=["shingle", "n"]
        )

    return run


def _search(block, column: str, through: list[str], first: bool):
    """Add the block's hits to those of the blocks before."""
    kind = pa.list_(
        pa.struct([("item", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for batch in batches:
            found, counts = [], []
            for text in _texts(batch, column):
                got = _split(text)
                counts.append(len(got))
                found.append(
                    [
                        {"item": windows.ids[item], "start": start, "end": end}
                        for item, start, end in windows.search(windows.numbers(got))
                    ]
                )
            if not first:
                before = batch.column("hits").to_pylist()
                found = [old + new for old, new in zip(before, found, strict=True)]
            yield pa.record_batch(
                [
                    *(batch.column(name) for name in through),
                    pa.array(counts, pa.int64()),
                    pa.array(found, kind),
                ],
                names=[*through, "n_words", "hits"],
            )

    return run


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``n_words, hits, n_hit, items, contaminated``.

    ``hits`` lists item, start and end (in words) of every window found; ``n_hit`` counts the
    words inside any of them; ``items`` are the ids found, sorted as strings.
    """
    spark: SparkSession = docs.sparkSession
    made = {name.lower() for name in _MADE}
    names = [c for c in docs.columns if c.lower() not in made]
    given = docs.select(*(f"`{c}`" for c in names))
    blocks = _blocks(items, item_id, item_text)
    block_now, block_next = next(blocks, ([], [])), next(blocks, None)
    now, number = given, 0
    while block_now is not None:  # the driver holds a block and the next one
        windows = Windows(*block_now, window, gram)
        if len(windows.shingles):
            block = spark.sparkContext.broadcast(windows)
            counted = given.select(f"`{text}`").mapInArrow(
                _count(block, text), "shingle long, n long"
            )
            seen = np.zeros(len(windows.shingles), np.int64)
            for row in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect():
                seen[row["shingle"]] = row["n"]
            block.unpersist()
        else:
            seen = np.zeros(0, np.int64)
        windows.choose(seen)
        through = [c for c in names if keep_text or c != text or block_next is not None]
        schema = T.StructType([given.schema[c] for c in through])
        schema = schema.add("n_words", "long").add("hits", T.DataType.fromDDL(_HITS))
        now = now.mapInArrow(
            _search(spark.sparkContext.broadcast(windows), text, through, number == 0), schema
        )
        number += 1
        block_now, block_next = block_next, next(blocks, None)
    places = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"], h["end"])))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("reach"), zero.alias("n")),
        lambda state, h: F.struct(
            F.greatest(state["reach"], h["end"]).alias("reach"),
            (
                state["n"] + F.greatest(h["end"] - F.greatest(state["reach"], h["start"]), F.lit(0))
            ).alias("n"),
        ),
        lambda state: state["n"],
    )
    return now.select(
        "*",
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"]))).alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )
