"""Token ids on disk: texts are encoded, packed by Simple-8b and written in id order.

A store is a folder. ``chunks`` (Parquet) has a row per run of whole documents, in ascending
order within a shard: their ids and lengths, the packed words of all their token ids, and
the word at which each block of 1,024 ids starts. ``shards`` has the number of ids before
each shard. Spark's writer commits both, so lost executors leave no half files.

Texts are range-partitioned by document id and sorted within a task, so shards follow one
another. Rows of equal id are ordered by a hash of their texts. A document's position is
the shard's start plus what stands before it there.

Encoding is that of the tokenizers library. Where white space only separates words, a task
remembers the ids of words it has seen, up to a fixed number, and asks the library for
the others.

Defined cases: a null text is empty, and an empty one is the end id alone. A null document id
comes first. Repeated rows are written each. An empty table makes an empty store. Only the
document id and the text are read; other columns do not matter.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.llm import simple8b

#: A chunk is closed once it holds so many ids.
CHUNK_IDS = 1 << 19
#: Words that a task remembers.
MEMORY = 600_000
#: Bytes of texts whose words are looked up together.
TOGETHER = 1 << 24
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_MARKS = bytes(b for b in range(33, 127) if b not in _ALNUM)


#: The stages before the vocabulary for which words can be encoded one by one: white
#: space only separates, case is dropped, and runs of letters are pieces of their own.
_BY_WORDS = (
    ["NFC", "Replace", "Lowercase"],
    ["Split", "ByteLevel"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
)


def printable_bytes() -> dict[int, str]:
    """The characters by which byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _gather(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (``sizes`` has their lengths) in the order of ``which``."""
    times = sizes[which]
    ends = np.cumsum(times)
    starts = np.cumsum(sizes) - sizes
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + times, times)]


class Encoder:
    """The ids of texts, as little-endian 32-bit numbers.

    Where the tokenizer's stages allow it, words are encoded one by one and remembered;
    with any other tokenizer, whole texts are.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([end_id], "<u4").tobytes()
        with open(path, encoding="utf-8") as file:
            stages = json.load(file)
        parts = lambda key, of: [x["type"] for x in (stages.get(key) or {}).get(of, [])]
        splits = (stages.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        pattern = splits[0].get("pattern", {}).get("Regex")
        found = (parts("normalizer", "normalizers"), parts("pre_tokenizer", "pretokenizers"), pattern)
        self.by_words = found == _BY_WORDS
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([b"\x00", *map(re.escape, special)])).search
        self.tokenize = self.tokenizer.model.tokenize
        self.spelling = printable_bytes()
        self.words: dict[str, bytes] = {"": b""}
        self.tails: dict[str, bytes] = {}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, stem: str) -> bytes:
        """Ids of a word in lower case without marks at its end."""
        spelled = stem
        if stem.isascii():  # a-z: one piece, spelled as it is
            plain = stem.isalpha()
        else:
            # Letters below U+0200 have one lower case each, but for U+0130.
            spelled = stem.lower()
            plain = (
                max(stem) < "\u0200" and "\u0130" not in stem and spelled.isalpha()
                and unicodedata.is_normalized("NFC", spelled)
            )
            if plain:
                spelled = spelled.encode().decode("latin-1").translate(self.spelling)
        if not plain:
            return self.ids(stem)
        return self.pack([token.id for token in self.tokenize(spelled)])

    def _known(self, memory: dict[str, bytes], most: int, parts: list[str], make) -> list[bytes]:
        """The ids of parts of words, remembered or asked for."""
        out = list(map(memory.get, parts))
        for k, ids in enumerate(out):
            if ids is None:
                ids = out[k] = make(parts[k])
                if len(memory) < most:
                    memory[parts[k]] = ids
        return out

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without special tokens.

        Marks after a letter or digit are a piece of their own, so a word is a stem and the marks at its
        end, which come from few different ones. Each different stem is looked up once.
        """
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten().dictionary_encode()
        which = words.indices.to_numpy()
        words = words.dictionary
        stems = pc.ascii_rtrim(words, _MARKS.decode())
        cut = pc.binary_length(stems).to_numpy()
        marked = np.flatnonzero((cut > 0) & (cut < pc.binary_length(words).to_numpy()))
        ends = pc.utf8_slice_codeunits(stems, -1).take(pa.array(marked))
        last = ends.to_numpy(zero_copy_only=False)
        marked = marked[[x.isascii() or x.isalpha() for x in last]] if len(marked) else marked
        # Words of marks alone stay whole, and so do those where marks follow something else.
        is_cut = np.zeros(len(words), bool)
        is_cut[marked] = True
        stems = pc.if_else(pa.array(is_cut), stems, words).dictionary_encode()
        whole = words.take(pa.array(marked)).to_numpy(zero_copy_only=False)
        lengths = pc.utf8_length(pc.take(stems.dictionary, stems.indices.take(pa.array(marked)))).to_numpy()
        tails = [word[n:] for word, n in zip(whole, lengths, strict=True)]
        of_tail = dict.fromkeys(tails)
        of_tail = {tail: k for k, tail in enumerate(of_tail)}

        named = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = self._known(self.words, MEMORY, named, self._piece)
        parts += self._known(self.tails, 10_000, list(of_tail), self.ids)
        parts += [b"", self.end]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        stem_of = stems.indices.to_numpy()
        tail_of = np.full(len(words), len(parts) - 2)
        tail_of[marked] = len(named) + np.fromiter(map(of_tail.get, tails), np.int64, len(tails))

        # The ids of each different word, then those of all words in order and the end id of each text.
        both = np.stack([stem_of, tail_of], axis=1).ravel()
        both = np.append(both, len(parts) - 1)
        flat = _gather(np.frombuffer(b"".join(parts), "<u4"), sizes, both)
        sizes = np.append(sizes[both[:-1]].reshape(-1, 2).sum(axis=1), sizes[-1])
        offsets = split.offsets.to_numpy()
        which = np.insert(which, offsets[1:] - offsets[0], len(sizes) - 1)
        upto = np.cumsum(sizes[which])
        last = np.cumsum(np.diff(offsets) + 1) - 1
        return _gather(flat, sizes, which), np.diff(upto[last], prepend=0)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts with their end ids, and how many each has, for runs of texts in a row."""
        given = pc.fill_null(texts, "").cast(pa.large_string())
        data = given.cast(pa.large_binary()).to_pylist()
        # ASCII letters count in lower case, unless a special token is spelled by them.
        odd = [k for k, text in enumerate(data) if not self.by_words or self.odd(text)]
        at = 0
        for k in [*odd, len(data)]:
            while at < k:
                to, room = at + 1, TOGETHER - len(data[at])
                while to < k and len(data[to]) <= room:
                    room -= len(data[to])
                    to += 1
                yield self._by_word(given.slice(at, to - at))
                at = to
            if k < len(data):
                ids = np.frombuffer(self.ids(data[k].decode()) + self.end, "<u4")
                yield ids, np.array([len(ids)])
                at = k + 1


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, end_id: int) -> Encoder:
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, end_id)
    return _ENCODERS[key]


def _pack(path: str, end_id: int, schema: pa.Schema):
    def chunk(state: dict) -> pa.RecordBatch:
        ids = np.concatenate(state["parts"])
        words, offsets = simple8b.encode(ids)
        row = [
            state["shard"],
            state["chunk"],
            state["before"],
            len(ids),
            state["docs"],
            state["counts"],
            words.tobytes(),
            offsets,
        ]
        state["before"] += len(ids)
        state["chunk"] += 1
        state["docs"], state["counts"], state["parts"], state["size"] = [], [], [], 0
        return pa.record_batch(
            [pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {
            "shard": TaskContext.get().partitionId(),
            "chunk": 0,
            "before": 0,
            "docs": [],
            "counts": [],
            "parts": [],
            "size": 0,
        }
        coder = _encoder(path, end_id)
        for batch in batches:
            names = iter(batch.column("doc_id").to_pylist())
            for ids, counts in coder.encode(batch.column("text")):
                # A chunk is closed by the document that fills it.
                upto = np.cumsum(counts)
                at = 0
                while at < len(counts):
                    before = int(upto[at] - counts[at])
                    to = int(np.searchsorted(upto, before + CHUNK_IDS - state["size"])) + 1
                    to = min(to, len(counts))
                    state["docs"].extend(islice(names, to - at))
                    state["counts"].extend(counts[at:to].tolist())
                    state["parts"].append(ids[before : int(upto[to - 1])])
                    state["size"] += int(upto[to - 1]) - before
                    if state["size"] >= CHUNK_IDS:
                        yield chunk(state)
                    at = to
        if state["docs"]:
            yield chunk(state)

    return run


def write(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode all texts with the tokenizer file and write them to ``folder``."""
    given = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{text}`").alias("text"),
    )
    kind = given.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text")]
    ranged = given.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema(
        [
            ("shard", pa.int32()),
            ("chunk", pa.int32()),
            ("before", pa.int64()),
            ("n_ids", pa.int64()),
            ("docs", pa.list_(pa.string() if kind == "string" else pa.int64())),
            ("counts", pa.list_(pa.int64())),
            ("words", pa.binary()),
            ("offsets", pa.list_(pa.int64())),
        ]
    )
    packed = ranged.mapInArrow(
        _pack(tokenizer, end_id, schema),
        "shard int, chunk int, before long, n_ids long, docs array<"
        + ("string" if kind == "string" else "long")
        + ">, counts array<long>, words binary, offsets array<long>",
    )
    packed.write.option("compression", "zstd").parquet(f"{folder}/chunks")
    sizes = docs.sparkSession.read.parquet(f"{folder}/chunks").groupBy("shard").agg(
        F.sum("n_ids").alias("n_ids"), F.count("*").alias("n_chunks")
    )
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.select(
        "shard", "n_ids", "n_chunks", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start")
    ).write.parquet(f"{folder}/shards")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            counts = np.array(row["counts"], np.int64)
            ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), row["n_ids"])
            data = ids.astype("<u4").tobytes()
            ends = np.cumsum(counts)
            begins = ends - counts
            yield pa.record_batch(
                [
                    pa.array(row["docs"], batch.schema.field("docs").type.value_type),
                    pa.array(begins + row["start"], pa.int64()),
                    pa.array(
                        [data[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())],
                        pa.binary(),
                    ),
                ],
                names=["doc_id", "start", "ids"],
            )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document; ``ids`` are little-endian 32-bit numbers."""
    chunks = spark.read.parquet(f"{folder}/chunks")
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "start")
    placed = chunks.join(shards, "shard").select(
        "docs", "counts", "words", "n_ids", (F.col("start") + F.col("before")).alias("start")
    )
    kind = chunks.schema["docs"].dataType.elementType.simpleString()
    return placed.mapInArrow(_unpack, f"doc_id {kind}, start long, ids binary")
