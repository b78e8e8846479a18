"""Secrets in texts: patterns propose, a random forest removes false findings.

Proposals are values assigned to names such as ``token`` or ``password``, and runs of at
least 16 characters of the usual alphabets. For each, the features are its length, its
characters and the transitions between their kinds, how word-like its letter triples are,
how much of it dictionary words cover, the path it comes from, and how word-like its neighbours are. A
random forest, trained on labelled findings, says how likely it is a secret.

Letter triples and words of any script are counted over all texts: triples in a table of fixed
size, words by a shuffle that sums in each task first. The dictionary is all words that come ``LEAST_COUNT``
times, as a bit table of 16 bits a word (at most ``MOST_BITS`` in all; with more words than that allows for,
more strings pass for words). The forest is fitted on at most ``MOST_LABELLED`` findings.

Labels that are made here (``weak_labels``) come from what the forest does not see: known forms of
keys, and the name and quotes beside a value.

Defined cases: a null or empty text has no findings. Null paths are empty. Repeated rows are
searched each. Without labelled findings of both kinds no finding is removed, and scores
are null. An empty table gives an empty result. Only the id, the text and the path are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.session import Scratch, settle

#: A word of the dictionary comes so often at least.
LEAST_COUNT = 5
#: Bits of the dictionary's table, at least and at most (8 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Cells of the table of letter triples.
TRIPLES = 1 << 15
#: Labelled findings that the forest is fitted on, at most.
MOST_LABELLED = 20_000
TREES, DEPTH, SEED = 20, 6, 7
LEAST_SCORE = 0.5
#: Characters before and after a finding that are looked at.
NEAR = 24
NAMES = r"token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential"
_ASSIGNED = re.compile(rf"(?i)(?:{NAMES})[\"']?[ \t]{{0,4}}[:=][ \t]{{0,4}}[\"']?([^\s\"']{{8,}})")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_TEST = re.compile(r"(?i)test|example|sample|doc|mock|fixture")
#: Forms of well-known keys. Fixed values.
KEY_FORM = (
    r"^(AKIA[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|"
    r"AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)"
)
FEATURES = (
    "length entropy capitals smalls digits others changes triples covered distinct hex "
    "covered_before covered_after word_before path_depth path_test"
).split()
_FOUND = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def propose(text: str) -> list[tuple[int, int]]:
    """Spans of all proposals, in order; a run inside an assigned value is part of it."""
    spans = [m.span(1) for m in _ASSIGNED.finditer(text)]
    last = 0
    for a, b in [m.span() for m in _RUN.finditer(text)]:
        while last < len(spans) and spans[last][1] <= a:
            last += 1
        if last == len(spans) or spans[last][0] >= b:
            spans.insert(last, (a, b))
    return spans


def _search(id_type: pa.DataType):
    kind = pa.list_(
        pa.struct(
            [
                ("start", pa.int32()),
                ("end", pa.int32()),
                ("value", pa.string()),
                ("before", pa.string()),
                ("after", pa.string()),
            ]
        )
    )
    fields = [
        ("doc_id", id_type),
        ("path", pa.string()),
        ("found", kind),
        ("word", pa.string()),
        ("n", pa.int64()),
    ]
    schema = pa.schema(fields)

    def told(words: Counter[str]) -> Iterator[pa.RecordBatch]:
        while words:
            part = [words.popitem() for _ in range(min(len(words), 50_000))]
            yield pa.record_batch(
                [
                    *(pa.nulls(len(part), f.type) for f in list(schema)[:3]),
                    pa.array([w for w, _ in part], pa.string()),
                    pa.array([n for _, n in part], pa.int64()),
                ],
                schema=schema,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                words.update(_LETTERS.findall(text.lower()))
                rows.append(
                    [
                        {
                            "start": a,
                            "end": b,
                            "value": text[a:b],
                            "before": text[max(0, a - NEAR) : a],
                            "after": text[b : b + NEAR],
                        }
                        for a, b in propose(text)
                    ]
                )
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("path"),
                    pa.array(rows, kind),
                    pa.nulls(len(rows), pa.string()),
                    pa.nulls(len(rows), pa.int64()),
                ],
                schema=schema,
            )
            if len(words) > 300_000:
                yield from told(words)
        yield from told(words)

    return run


def triple_cells(text: str) -> np.ndarray:
    """The cells of all triples of characters, in order."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
    return (code[:-2] * 961 + code[1:-1] * 31 + code[2:]) % TRIPLES


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of letter triples in counted words, a number per cell and task."""
    counts = np.zeros(TRIPLES)
    for batch in batches:
        words = batch.column("word").to_pylist()
        cells = triple_cells("\0".join(words) + "\0\0\0")
        sizes = np.array([len(word) for word in words]) + 1
        times = np.repeat(batch.column("n").to_numpy(), sizes)
        # A triple counts where its word has two more characters.
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(times))
        inside = left > 3
        counts += np.bincount(cells[: len(times)][inside], times[inside], TRIPLES)
    at = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(at), pa.array(counts[at].astype(np.int64))], names=["triple", "n"])


class Dictionary:
    """Words as bits: a word is known if both bits of its hash are set."""

    def __init__(self, bits: np.ndarray, lengths: list[int]) -> None:
        self.bits, self.last = bits, len(bits) * 8 - 1
        #: The lengths that known words have, longest first.
        self.lengths = sorted(lengths, reverse=True)

    def __contains__(self, word: str) -> bool:
        code = xxhash.xxh64_intdigest(word.encode(), 42)
        for place in (code & self.last, (code >> 32) & self.last):
            if not self.bits[place >> 3] >> (place & 7) & 1:
                return False
        return True


def covered(text: str, dictionary: Dictionary) -> int:
    """Characters in dictionary words: at each place the longest one, and on behind it."""
    found = 0
    for run in _LETTERS.finditer(text):
        letters, at = run[0], 0
        while at < len(letters):
            for size in dictionary.lengths:
                if at + size <= len(letters) and letters[at : at + size] in dictionary:
                    found += size
                    at += size
                    break
            else:
                at += 1
    return found


def describe(
    value: str, before: str, after: str, path: str, likely: np.ndarray, dictionary: Dictionary
) -> list[float]:
    """The features of a finding, in the order of ``FEATURES``."""
    n = len(value)
    kinds = [
        0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in value
    ]
    share = [kinds.count(k) / n for k in range(4)]
    seen = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / n
    low = value.lower()
    cells = [triple_cells(run[0]) for run in _LETTERS.finditer(low)]
    triples = float(likely[np.concatenate(cells)].sum()) / max(1, n - 2) if cells else likely.min(initial=0.0)
    return [
        math.log2(n),
        entropy,
        share[1],
        share[0],
        share[2],
        share[3],
        changes,
        triples,
        covered(low, dictionary) / n,
        len(seen) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        covered(before.lower(), dictionary) / max(1, len(before)),
        covered(after.lower(), dictionary) / max(1, len(after)),
        float(bool(re.search(r"[^\W\d_]{2,}\W*$", before))),
        float(path.count("/")),
        float(bool(_TEST.search(path))),
    ]


def _describe(model, through: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likely, dictionary = model.value
        names = ("value", "before", "after", "path")
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            rows = [
                describe(v, b, a, p or "", likely, dictionary)
                for v, b, a, p in zip(*columns, strict=True)
            ]
            yield pa.record_batch(
                [*(batch.column(c) for c in through), pa.array(rows, pa.list_(pa.float64()))],
                names=[*through, "features"],
            )

    return run


def dictionary_of(words: DataFrame) -> Dictionary:
    """The table of the counted words; tasks set bits, and only the table comes to the driver."""
    known = words.where(F.col("n") >= LEAST_COUNT)
    size = known.agg(F.count("*").alias("n"), F.collect_set(F.char_length("word")).alias("lengths")).first()
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * size["n"]).bit_length()))
    code = F.xxhash64("word")
    places = F.explode(F.array(code, F.shiftrightunsigned(code, 32))).alias("place")
    place = known.select(places).select(F.col("place").bitwiseAND(n_bits - 1).alias("place"))
    slots = place.groupBy(F.shiftright("place", 6).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(63).cast("int"))).alias("bits")
    )
    table = np.zeros(n_bits // 64, "<i8")
    found = slots.toArrow()
    table[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return Dictionary(table.view(np.uint8), size["lengths"])


def proposals(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with what was found in each, and all findings with their features."""
    spark = docs.sparkSession
    given = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path"),
        F.col(f"`{text}`").alias("text"),
    )
    kind = given.schema["doc_id"].dataType.simpleString()
    arrow = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    searched = given.mapInArrow(
        _search(arrow), f"doc_id {kind}, path string, found {_FOUND}, word string, n long"
    )
    both = scratch.settle(searched.withColumn("row", F.monotonically_increasing_id()), "searched")
    rows = both.where("word IS NULL").select("row", "doc_id", "path", "found")
    words = scratch.settle(
        both.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    counts = np.zeros(TRIPLES)
    summed = words.mapInArrow(_triples, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n"))
    for row in summed.collect():
        counts[row["triple"]] = row["n"]
    likely = np.log2((counts + 0.5) * TRIPLES / (counts.sum() + 0.5 * TRIPLES))
    model = spark.sparkContext.broadcast((likely, dictionary_of(words)))
    each = rows.select("row", "path", F.explode("found").alias("f")).select("row", "path", "f.*")
    through = ["row", "path", "start", "end", "value", "before", "after"]
    features = each.mapInArrow(
        _describe(model, through),
        "row long, path string, start int, end int, value string, before string, after string,"
        " features array<double>",
    )
    return rows, scratch.settle(features, "findings")


def weak_labels(findings: DataFrame) -> DataFrame:
    """Labelled findings where none are given.

    Values in the form of a well-known key, and quoted ones assigned to a secret's name, are secrets. Values
    without such a name before them that are numbers, or letters alone, are not. Others stay without a label.
    """
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    named = before.rlike(rf"(?i)(?:{NAMES})")
    quoted = before.rlike("[:=][ \\t]*[\"']$") & after.rlike("^[\"']")
    secret = value.rlike(KEY_FORM) | (named & quoted)
    plain = ~named & (value.rlike(r"^\P{L}*$") | value.rlike(r"^[\p{L}/_=+-]*$") & ~value.rlike("[0-9]"))
    label = F.when(secret, 1.0).when(plain, 0.0)
    return findings.select("features", "value", label.alias("label")).where("label IS NOT NULL")


def scan(
    docs: DataFrame,
    labelled=weak_labels,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str = "source",
) -> DataFrame:
    """``doc_id, n_proposed, secrets`` of every row; ``secrets`` lists start, end, value and score.

    ``labelled`` makes labelled findings (``features, value, label``) of the findings.
    """
    with Scratch(docs.sparkSession, "secrets") as scratch:
        rows, findings = proposals(docs, scratch, doc_id, text, path)
        sample = scratch.settle(
            labelled(findings)
            .orderBy(F.xxhash64("value"), "value", "label", "features")
            .limit(MOST_LABELLED)
            .select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")),
            "labelled",
        )
        kinds = {r["label"] for r in sample.select("label").distinct().collect()}
        if len(kinds) > 1:
            forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(sample)
            told = forest.transform(
                findings.select("row", "start", "end", "value", array_to_vector("features").alias("features"))
            )
            scored = told.select(
                "row", "start", "end", "value",
                F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("score"),
            ).where(F.col("score") >= LEAST_SCORE)
        else:
            scored = findings.select("row", "start", "end", "value", F.lit(None).cast("double").alias("score"))
        kept = scored.groupBy("row").agg(
            F.array_sort(F.collect_list(F.struct("start", "end", "value", "score"))).alias("secrets")
        )
        none = F.array().cast("array<struct<start:int,end:int,value:string,score:double>>")
        result = rows.join(kept, "row", "left").select(
            "doc_id",
            F.size("found").cast("long").alias("n_proposed"),
            F.coalesce("secrets", none).alias("secrets"),
        )
        return settle(result, "secrets")
