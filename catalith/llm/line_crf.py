"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features are shares of kinds of characters, lengths and
repetition, those of the lines before and after it, and a few of the whole text. Labels of
neighbouring lines depend on each other through learned weights. The forward-backward pass
gives each line's probability of being good; their mean, weighted by length, is the
document's score.

Learned from labelled documents, at most ``MOST_LABELLED`` of them (those with the smallest
hash of their id) and ``MOST_LINES`` of their lines; a line takes its document's label. A document id
counts once per label, however many rows have it. The likelihood of the label sequences
is maximised on the driver, on this bounded sample. Scoring takes the whole texts, in
groups of about a megabyte, all documents of a group at once.

Defined cases: a null or empty text is one empty line, and has a score. Null labels and ids are left
out of learning; without any labelled document every score is 0.5. Repeated rows are scored
each. An empty table gives an empty result. Extra columns are handed through; one named
like a made one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import labelled_texts
from catalith.llm.shingles import hash_words
from catalith.session import Scratch

#: Labelled documents that the model is fitted on, at most.
MOST_LABELLED = 8_000
#: Lines that the driver collects for it, at most. Documents come whole, by the hash of their id, up to
#: the first that would go beyond; one that alone has more lines is passed over.
MOST_LINES = 400_000
ROUNDS = 400
#: Bytes of text whose features are computed together.
GROUP = 1 << 20
_SYMBOL, _CAPITAL, _SMALL, _DIGIT, _POINT, _SPACE, _OTHER = range(7)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[ord(c) for c in "#*$%&|<>!=~^{}[]\\"]] = _SYMBOL
_KIND[[ord(c) for c in ".,;:?'\"()-/+@_`"]] = _POINT
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _CAPITAL, _SMALL, _DIGIT
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_OWN = 10  # features of a line itself; its neighbours' come twice more
_WHOLE = 4
FEATURES = 3 * _OWN + _WHOLE


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a key came earlier with the same owner."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    return out


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, the characters of each, and the number of lines of each text."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    kinds = _KIND[raw]
    text_of = np.repeat(np.arange(len(texts)), counts)

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask, dtype=np.int32))
        return (sums[ends] - sums[starts]).astype(np.float64)

    chars = np.maximum(per_line((raw & 0xC0) != 0x80), 0)
    filled = np.maximum(chars - per_line(kinds == _SPACE), 1)
    hashes, places = hash_words(data)
    word_line = np.searchsorted(ends, places)
    words = np.bincount(word_line, minlength=len(ends)).astype(np.float64)
    again = _repeats(hashes, text_of[word_line])
    repeated = np.bincount(word_line, weights=again, minlength=len(ends))
    line_key = np.zeros(len(ends), np.uint64)
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    np.add.at(line_key, word_line, mixed * (places - starts[word_line] + 1).astype(np.uint64))
    copy = _repeats(line_key, text_of) & (words > 0)
    capitals = per_line(kinds == _CAPITAL)
    own = np.stack(
        [
            np.log1p(chars),
            np.log1p(per_line(kinds == _SYMBOL)),
            per_line(kinds == _SYMBOL) / filled,
            capitals / filled,
            per_line(kinds == _DIGIT) / filled,
            per_line(kinds == _POINT) / filled,
            filled / np.maximum(words, 1),
            repeated / np.maximum(words, 1),
            copy.astype(np.float64),
            (words < 3).astype(np.float64),
        ],
        axis=1,
    )
    first = np.append(0, np.cumsum(counts)[:-1])
    before = np.vstack([np.zeros((1, _OWN)), own[:-1]])
    after = np.vstack([own[1:], np.zeros((1, _OWN))])
    before[first] = 0
    after[np.cumsum(counts) - 1] = 0

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text_of, weights=values, minlength=len(texts))

    text_words = np.maximum(per_text(words), 1)
    whole = np.stack(
        [
            np.log1p(per_text(words)),
            np.log(counts),
            per_text(repeated) / text_words,
            per_text(per_line(kinds == _SYMBOL)) / np.maximum(per_text(filled), 1),
        ],
        axis=1,
    )
    return np.hstack([own, before, after, whole[text_of]]), chars, counts


@dataclass
class Chain:
    """Weights of a line's features for "good", and of neighbouring labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    level: float
    moves: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale @ self.weights + self.level

    def marginals(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The probability that each line is good."""
        return forward_backward(score, counts, self.moves)[0]


def forward_backward(
    score: np.ndarray, counts: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each line, and the expected number of each move, of many chains at once.

    Bad lines score 0 and good ones ``score``. Chains are sorted by length; step t takes
    all chains that have a line t.
    """
    order = np.argsort(-counts, kind="stable")
    first = np.append(0, np.cumsum(counts)[:-1])[order]
    sizes = counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), "left")
    emit = np.stack([np.zeros(len(score)), score], axis=1)
    ahead = np.zeros_like(emit)
    back = np.zeros_like(emit)
    for t in range(longest):
        at = first[: alive[t]] + t
        ahead[at] = emit[at]
        if t:
            came = ahead[at - 1][:, :, None] + moves[None]
            ahead[at] += np.logaddexp(came[:, 0], came[:, 1])
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        goes = moves[None] + (emit[at + 1] + back[at + 1])[:, None, :]
        back[at] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
    both = ahead + back
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
    expected = np.zeros((2, 2))
    ends = np.zeros(len(score), bool)
    ends[np.cumsum(counts) - 1] = True
    at = np.flatnonzero(~ends)
    if len(at):
        whole = np.logaddexp(both[at, 0], both[at, 1])
        joint = ahead[at][:, :, None] + moves[None] + (emit[at + 1] + back[at + 1])[:, None, :]
        expected = np.exp(joint - whole[:, None, None]).sum(0)
    return good, expected


def fit(features: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Chain:
    """Maximise the likelihood of the label sequences; each line has its text's label."""
    width = features.shape[1]
    if not len(labels):
        return Chain(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)))
    mean, scale = features.mean(0), features.std(0) + 1e-6
    z = np.hstack([(features - mean) / scale, np.ones((len(features), 1))])
    wanted = np.repeat(labels, counts).astype(np.float64)
    moved = np.zeros((2, 2))
    for label in (0, 1):
        moved[label, label] = (counts[labels == label] - 1).sum()
    coef, moves = np.zeros(width + 1), np.zeros((2, 2))
    n = len(labels)
    slope_1, slope_2 = np.zeros(width + 5), np.zeros(width + 5)
    for step in range(1, ROUNDS + 1):
        good, expected = forward_backward(z @ coef, counts, moves)
        slope = np.concatenate([z.T @ (wanted - good), (moved - expected).ravel()]) / n
        slope -= 1e-3 * np.concatenate([coef, moves.ravel()])
        slope_1 = 0.9 * slope_1 + 0.1 * slope
        slope_2 = 0.99 * slope_2 + 0.01 * slope**2
        rate = 0.1 * (1 - step / (ROUNDS + 1))
        change = rate * slope_1 / (1 - 0.9**step) / (np.sqrt(slope_2 / (1 - 0.99**step)) + 1e-8)
        coef += change[: width + 1]
        moves += change[width + 1 :].reshape(2, 2)
    return Chain(mean, scale, coef[:-1], float(coef[-1]), moves)


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for group in _groups(_texts(batch, "text")):
            features, _, counts = line_features(group)
            ends = np.cumsum(counts)
            rows += [features[b - c : b].astype("<f4").tobytes() for b, c in zip(ends, counts)]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
            names=["doc_id", "label", "features"],
        )


def learn(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Chain:
    """Fit a chain on the documents whose id and ``label`` (0 or 1) are in ``labelled``."""
    given = labelled.select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = labelled_texts(docs, given, MOST_LABELLED, doc_id, text, "label")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    with Scratch(docs.sparkSession, "lines") as scratch:
        described = chosen.mapInArrow(_describe, f"doc_id {kind}, label int, features binary")
        described = described.withColumns(
            {
                "lines": F.floor(F.octet_length("features") / (4 * FEATURES)),
                "place": F.xxhash64("doc_id", "label"),
            }
        )
        described = scratch.settle(described, "described").where(F.col("lines") <= MOST_LINES)
        sizes = sorted(tuple(r) for r in described.select("place", "lines").collect())
        fit_in = np.cumsum([lines for _, lines in sizes]) <= MOST_LINES
        last = sizes[int(fit_in.sum()) - 1][0] if len(sizes) else 0
        kept = described.where(F.col("place") <= last)
        rows = kept.select("doc_id", "label", "features").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["features"])))
    parts = [np.frombuffer(r["features"], "<f4").reshape(-1, FEATURES) for r in rows]
    features = np.vstack(parts).astype(np.float64) if parts else np.zeros((0, FEATURES))
    counts = np.array([len(p) for p in parts], np.int64)
    return fit(features, counts, np.array([r["label"] for r in rows], np.int64))


def _score(chain: Chain, column: str, through: list[str], made: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for group in _groups(_texts(batch, column)):
                features, chars, counts = line_features(group)
                good = chain.marginals(chain.emissions(features), counts)
                owner = np.repeat(np.arange(len(group)), counts)
                weight = chars + 1
                scores.append(
                    np.bincount(owner, weights=good * weight, minlength=len(group))
                    / np.bincount(owner, weights=weight, minlength=len(group))
                )
            value = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.record_batch(
                [*(batch.column(c) for c in through), pa.array(np.clip(value, 0, 1))],
                names=[*through, made],
            )

    return run


def score(
    docs: DataFrame, chain: Chain, text: str = "text", keep_text: bool = True, made: str = "score"
) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1; higher where good is likelier."""
    names = [c for c in docs.columns if c.lower() != made]
    through = [c for c in names if keep_text or c != text]
    given = docs.select(*(f"`{c}`" for c in names))
    schema = T.StructType([given.schema[c] for c in through]).add(made, "double")
    return given.mapInArrow(_score(chain, text, through, made), schema)
