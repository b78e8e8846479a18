"""Two tokenizers' tokens of the same texts, aligned by bytes, and how often their ids go together.

Both tokenizers spell a blank and the text. Where tokens of both end at the same byte, the text is cut;
between two cuts lies a group, and every A token of a group is linked with every B token of it. A pair of ids
counts in how many documents it is linked; each document then learns what its links count.

Long texts are dealt out as byte ranges, and a range's tokens of A and of B begin where that tokenizer can
start anew, which need not be the same place. A range gives a *fragment*: an open head (tokens up to the
first cut, whose group may begin in an earlier range), closed groups, and an open tail. ``compose`` joins two
neighbours: the left's tail and the right's head are cut together. It is associative, and fragments of a text
are composed in a tree, ``FAN`` neighbours per step, by tasks all over the cluster. Texts of one range
are whole fragments and are aligned where they lie, many at a time.

Pairs are counted per task before they are shuffled. Documents look them up in an array of the most
frequent ones (at most ``HELD``, whatever the corpus); the others are joined by Spark, each of them rare.

Defined cases: texts that are null or empty, or that a tokenizer does not spell as they are, have no tokens: their
counts are 0 and they are not among the documents a pair counts. Repeated rows count each. Null ids stay. Ranges of
very long texts are encoded apart; a run of a text in which the piece tokenizer cannot start anew (no blank between two other
characters) is encoded by one task, and a document's spelled groups end up in one row, to be hashed. Ties
for an id's most frequent partner are all best. An empty table gives an empty one. Columns besides id and
text do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.tokens import printable_bytes
from catalith.session import settle

#: Bytes of a range.
RANGE = 1 << 16
#: Neighbouring fragments that one step composes.
FAN = 16
#: Pairs that every task holds.
HELD = 1 << 20
#: Bytes of texts aligned at once.
TOGETHER = 1 << 18
#: Groups with more links than this are counted by their distinct ids.
WIDE = 1 << 14
#: B ids take the lower bits of a pair's code.
B_BITS = 15
_B_MASK = (1 << B_BITS) - 1

#: How byte-level vocabularies split texts before they merge. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A can start anew between a letter and another character of ASCII, B at a single blank.
_A_ANEW = re.compile(rb"[A-Za-z](?=[^A-Za-z\x80-\xff])")
_B_ANEW = re.compile(rb"[^ ](?= [^ ])")


class Coder:
    """The ids of both tokenizers, and the bytes that each id spells."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        import sentencepiece
        import tiktoken

        with open(bytes_path, encoding="utf-8") as file:
            stages = json.load(file)
        split = stages.get("pre_tokenizer") or {}
        if stages.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            raise ValueError(f"{bytes_path} is not a plain byte-level vocabulary")
        byte_of = {char: byte for byte, char in printable_bytes().items()}
        special = {token["content"] for token in stages.get("added_tokens", [])}
        ranks = {
            bytes(byte_of[char] for char in piece): rank
            for piece, rank in stages["model"]["vocab"].items()
            if piece not in special
        }
        # The merges of this vocabulary are in the order of its ids, so ids serve as ranks.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        if self.b.get_piece_size() > 1 << B_BITS:
            raise ValueError(f"{pieces_path} has more than {1 << B_BITS} pieces")
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.a_bytes[rank] = piece
        self.b_bytes = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Spelled ids: what follows inside a group, and after the last token of its kind.
        self.a_spelled = np.array([f"{k}{end}" for end in ",|" for k in range(len(self.a_bytes))], object)
        self.b_spelled = np.array([f"{k}{end}" for end in ",;" for k in range(len(self.b_bytes))], object)

    def _piece(self, k: int) -> bytes:
        piece = self.b.id_to_piece(k)
        if self.b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def a_ids(self, text: str) -> np.ndarray:
        return self.a.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def b_ids(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def spells(self, a: np.ndarray, b: list[int], a_data: bytes, b_data: bytes) -> bool:
        if b"".join([self.a_bytes[k] for k in a.tolist()]) != a_data:
            return False
        return b"".join([self.b_bytes[k] for k in b]) == b_data


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(paths: tuple[str, str]) -> Coder:
    if paths not in _CODERS:
        _CODERS[paths] = Coder(*paths)
    return _CODERS[paths]


class Tokens(NamedTuple):
    """Tokens of both kinds, with the bytes at which they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def pick(self, a: slice, b: slice) -> "Tokens":
        return Tokens(self.a[a], self.a_ends[a], self.b[b], self.b_ends[b])

    def then(self, other: "Tokens") -> "Tokens":
        return Tokens(*(np.concatenate(pair) for pair in zip(self, other, strict=True)))


class Closed(NamedTuple):
    """Whole groups: how many, what they link, and how they are spelled (each ends with ``;``)."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    spelled: str
    codes: np.ndarray
    occurs: np.ndarray

    def then(self, other: "Closed") -> "Closed":
        codes, at = np.unique(np.concatenate([self.codes, other.codes]), return_inverse=True)
        occurs = np.bincount(at, np.concatenate([self.occurs, other.occurs]), len(codes)).astype(np.int64)
        sums = (x + y for x, y in zip(self[:5], other[:5], strict=True))
        return Closed(*sums, codes, occurs)


class Fragment(NamedTuple):
    """``closed`` is None while no cut is known; all tokens are in ``head`` then."""

    head: Tokens
    closed: Closed | None
    tail: Tokens


_NONE = np.zeros(0, np.int64)
NO_TOKENS = Tokens(_NONE, _NONE, _NONE, _NONE)
NO_GROUPS = Closed(0, 0, 0, 0, "", _NONE, _NONE)


def cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each kind end where one of the other kind does."""
    hit_a, hit_b = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    if len(a_ends) and len(b_ends):
        at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
        hit_a = b_ends[at] == a_ends
        hit_b[at[hit_a]] = True
    return hit_a, hit_b


def align(given: Tokens, hits: tuple[np.ndarray, np.ndarray], texts: np.ndarray, code: Coder) -> list[Closed]:
    """The groups of texts that lie one after the other; ``texts`` has each one's numbers of A and B tokens.

    The tokens end with a cut, and so does each text.
    """
    a, b = given.a, given.b
    hit_a, hit_b = hits
    n_groups = int(hit_a.sum())
    group_a, group_b = np.cumsum(hit_a) - hit_a, np.cumsum(hit_b) - hit_b
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
    spelled = np.empty(len(a) + len(b), object)
    spelled[np.arange(len(a)) + (to_b - in_b)[group_a]] = code.a_spelled[a + hit_a * len(code.a_bytes)]
    spelled[np.arange(len(b)) + to_a[group_b]] = code.b_spelled[b + hit_b * len(code.b_bytes)]
    spelled = spelled.tolist()

    n_of = texts.sum(axis=1)
    ends = np.cumsum(texts, axis=0)
    text_of_a = np.repeat(np.arange(len(texts)), texts[:, 0])
    links = in_a * in_b
    narrow = (links <= WIDE)[group_a]
    a_few, group_few = a[narrow], group_a[narrow]
    times = in_b[group_few]
    begin = np.cumsum(times) - times
    partner = np.arange(int(times.sum())) + np.repeat((to_b - in_b)[group_few] - begin, times)
    pair = (np.repeat((text_of_a[narrow] << 17) | a_few, times) << B_BITS) | b[partner]
    pair, occurs = np.unique(pair, return_counts=True)
    for k in np.flatnonzero(links > WIDE).tolist():
        some_a, of_a = np.unique(a[to_a[k] - in_a[k] : to_a[k]], return_counts=True)
        some_b, of_b = np.unique(b[to_b[k] - in_b[k] : to_b[k]], return_counts=True)
        text = int(text_of_a[to_a[k] - 1])
        wide = (((text << 17) | some_a[:, None]) << B_BITS) | some_b[None, :]
        pair, at = np.unique(np.concatenate([pair, wide.ravel()]), return_inverse=True)
        occurs = np.bincount(at, np.concatenate([occurs, np.outer(of_a, of_b).ravel()]), len(pair)).astype(np.int64)

    last = group_a[ends[:, 0] - 1] + 1 if len(texts) else _NONE
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(links)])
    border = np.searchsorted(pair, np.arange(len(texts) + 1) << (17 + B_BITS))
    to = np.cumsum(n_of)
    codes = pair & ((1 << (17 + B_BITS)) - 1)
    return [
        Closed(
            int(texts[k, 0]),
            int(texts[k, 1]),
            int(last[k] - first[k]),
            int(upto[last[k]] - upto[first[k]]),
            "".join(spelled[to[k] - n_of[k] : to[k]]),
            codes[border[k] : border[k + 1]],
            occurs[border[k] : border[k + 1]],
        )
        for k in range(len(texts))
    ]


def _close(given: Tokens, code: Coder) -> Closed:
    """The groups of tokens that end with a cut."""
    if not len(given.a):
        return NO_GROUPS
    return align(given, cuts(given.a_ends, given.b_ends), np.array([[len(given.a), len(given.b)]]), code)[0]


def fragment(given: Tokens, code: Coder) -> Fragment:
    """A range's tokens: head up to the first cut, groups, and what comes after the last."""
    hit_a, hit_b = cuts(given.a_ends, given.b_ends)
    if not hit_a.any():
        return Fragment(given, None, NO_TOKENS)
    at_a, at_b = np.flatnonzero(hit_a), np.flatnonzero(hit_b)
    a0, a1, b0, b1 = at_a[0] + 1, at_a[-1] + 1, at_b[0] + 1, at_b[-1] + 1
    return Fragment(
        given.pick(slice(a0), slice(b0)),
        _close(given.pick(slice(a0, a1), slice(b0, b1)), code),
        given.pick(slice(a1, None), slice(b1, None)),
    )


def compose(left: Fragment, right: Fragment, code: Coder) -> Fragment:
    """The fragment of two neighbours; associative, with the fragment without tokens as its neutral element."""
    if left.closed is None and right.closed is None:
        return fragment(left.head.then(right.head), code)
    if left.closed is None:
        # What the left leaves open meets the right's head, whose end is a cut.
        met = fragment(left.head.then(right.head), code)
        return Fragment(met.head, met.closed.then(right.closed), right.tail)
    met = fragment(left.tail.then(right.head), code)
    if met.closed is None:
        return Fragment(left.head, left.closed, met.head)
    # The left's last cut is where the met tokens begin, so their head is a whole group.
    closed = left.closed.then(_close(met.head, code)).then(met.closed)
    if right.closed is None:
        return Fragment(left.head, closed, met.tail)
    return Fragment(left.head, closed.then(right.closed), right.tail)


def finish(whole: Fragment, code: Coder) -> Closed:
    """The groups of a whole text: its head begins with the text, and nothing is left open behind."""
    if whole.closed is None:
        return NO_GROUPS
    return _close(whole.head, code).then(whole.closed)


def ranges(text: str, size: int = 0) -> Iterator[tuple[int, int, str, int, str]]:
    """Number of a range, and where and what A and B encode of it; B's blank in front is not part of its text."""
    data = b" " + text.encode()
    size = size or RANGE
    a = b = 0
    for seq in range(-(-len(data) // size)):
        upto = (seq + 1) * size
        ends = []
        for anew, since in ((_A_ANEW, a), (_B_ANEW, b)):
            found = anew.search(data, max(upto, since)) if upto < len(data) else None
            ends.append(found.end() if found else len(data))
        if a < ends[0] or b < ends[1]:
            yield seq, a, data[a : ends[0]].decode(), b, data[b + 1 : ends[1]].decode()
        a, b = ends


def encode_range(a_at: int, a_text: str, b_at: int, b_text: str, code: Coder) -> Tokens | None:
    """The tokens of a range; None if they do not spell it."""
    a = code.a_ids(a_text) if a_text else _NONE
    b = code.b_ids([b_text])[0] if b_text else []
    if not code.spells(a, b, a_text.encode(), b" " + b_text.encode() if b_text else b""):
        return None
    b = np.array(b, np.int64)
    return Tokens(a, a_at + np.cumsum(code.a_sizes[a]), b, b_at + np.cumsum(code.b_sizes[b]))


def align_whole(texts: list[str], code: Coder) -> list[Closed]:
    """The groups of whole texts, aligned together; without tokens where a text is not spelled as it is."""
    out = [NO_GROUPS] * len(texts)
    some, a_parts, b_parts = [], [], []
    given = [k for k, text in enumerate(texts) if text]
    for k, b in zip(given, code.b_ids([texts[k] for k in given]), strict=True):
        text = " " + texts[k]
        a, data = code.a_ids(text), text.encode()
        if code.spells(a, b, data, data):
            some.append(k)
            a_parts.append(a)
            b_parts.append(b)
    if not some:
        return out
    sizes = np.array([[len(a), len(b)] for a, b in zip(a_parts, b_parts, strict=True)])
    a = np.concatenate(a_parts)
    b = np.fromiter(chain.from_iterable(b_parts), np.int64, int(sizes[:, 1].sum()))
    tokens = Tokens(a, np.cumsum(code.a_sizes[a]), b, np.cumsum(code.b_sizes[b]))
    for k, closed in zip(some, align(tokens, cuts(tokens.a_ends, tokens.b_ends), sizes, code), strict=True):
        out[k] = closed
    return out


# What tasks exchange: codes and counts as little-endian 32-bit numbers, open tokens as 64-bit ones.

_DONE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, occurs binary"


def _done_row(closed: Closed) -> list:
    sha = hashlib.sha256(closed.spelled[:-1].encode()).hexdigest() if closed.n_groups else ""
    return [*closed[:4], sha, closed.codes.astype("<u4").tobytes(), closed.occurs.astype("<u4").tobytes()]


def _batch(rows: list[list], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


_DONE_FIELDS = [
    *(pa.field(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")),
    pa.field("groups_sha256", pa.string()),
    pa.field("codes", pa.binary()),
    pa.field("occurs", pa.binary()),
]


def _align_short(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(paths)
        for batch in batches:
            fields = [batch.schema.field("doc_id"), *_DONE_FIELDS]
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            upto = np.cumsum(sizes, dtype=np.int64)
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + TOGETHER, "right")))
                some = batch.slice(at, to - at)
                ids, texts = (some.column(name).to_pylist() for name in ("doc_id", "text"))
                done = align_whole([text or "" for text in texts], code)
                yield _batch([[k, *_done_row(c)] for k, c in zip(ids, done, strict=True)], fields)
                at = to

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [batch.schema.field("row"), batch.schema.field("doc_id"), pa.field("seq", pa.int64())]
        fields += [pa.field("a_at", pa.int64()), pa.field("a_text", pa.string())]
        fields += [pa.field("b_at", pa.int64()), pa.field("b_text", pa.string())]
        for row, doc_id, text in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "text")), strict=True):
            for piece in ranges(text):
                yield _batch([[row, doc_id, *piece]], fields)


_OPEN = ("head_a", "head_a_ends", "head_b", "head_b_ends", "tail_a", "tail_a_ends", "tail_b", "tail_b_ends")
_FRAGMENT = (
    "seq long, spelled_right boolean, cut boolean, "
    + ", ".join(f"{name} binary" for name in _OPEN)
    + ", n_a long, n_b long, n_groups long, n_links long, spelled string, codes binary, occurs binary"
)
_FRAGMENT_FIELDS = [
    pa.field("seq", pa.int64()),
    pa.field("spelled_right", pa.bool_()),
    pa.field("cut", pa.bool_()),
    *(pa.field(name, pa.binary()) for name in _OPEN),
    *_DONE_FIELDS[:4],
    pa.field("spelled", pa.string()),
    *_DONE_FIELDS[5:],
]


def _fragment_row(seq: int, part: Fragment | None) -> list:
    """A fragment as a row; None is that of a text which is not spelled as it is."""
    shown = part or Fragment(NO_TOKENS, None, NO_TOKENS)
    closed = shown.closed or NO_GROUPS
    opened = [x.astype("<i8").tobytes() for x in (*shown.head, *shown.tail)]
    packed = [closed.codes.astype("<u4").tobytes(), closed.occurs.astype("<u4").tobytes()]
    return [seq, part is not None, shown.closed is not None, *opened, *closed[:5], *packed]


def _fragment_of(row: dict) -> Fragment | None:
    if not row["spelled_right"]:
        return None
    opened = [np.frombuffer(row[name], "<i8") for name in _OPEN]
    closed = None
    if row["cut"]:
        packed = [np.frombuffer(row[name], "<u4").astype(np.int64) for name in ("codes", "occurs")]
        closed = Closed(*(row[name] for name in ("n_a", "n_b", "n_groups", "n_links", "spelled")), *packed)
    return Fragment(Tokens(*opened[:4]), closed, Tokens(*opened[4:]))


def _encode_ranges(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(paths)
        for batch in batches:
            fields = [batch.schema.field("row"), batch.schema.field("doc_id"), *_FRAGMENT_FIELDS]
            for row in batch.to_pylist():
                found = encode_range(row["a_at"], row["a_text"], row["b_at"], row["b_text"], code)
                part = None if found is None else fragment(found, code)
                yield _batch([[row["row"], row["doc_id"], *_fragment_row(row["seq"], part)]], fields)

    return run


def _compose_some(paths: tuple[str, str]):
    def run(table: pa.Table) -> pa.Table:
        code = coder(paths)
        whole: Fragment | None = Fragment(NO_TOKENS, None, NO_TOKENS)
        rows = table.sort_by("seq").to_pylist()
        for row in rows:
            part = _fragment_of(row)
            whole = None if whole is None or part is None else compose(whole, part, code)
        fields = [table.schema.field("row"), table.schema.field("doc_id"), *_FRAGMENT_FIELDS]
        made = [rows[0]["row"], rows[0]["doc_id"], *_fragment_row(rows[0]["seq"] // FAN, whole)]
        return pa.Table.from_batches([_batch([made], fields)])

    return run


def _finish_rows(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(paths)
        for batch in batches:
            fields = [batch.schema.field("doc_id"), *_DONE_FIELDS]
            for row in batch.to_pylist():
                part = _fragment_of(row)
                closed = NO_GROUPS if part is None else finish(part, code)
                yield _batch([[row["doc_id"], *_done_row(closed)]], fields)

    return run


def _align_long(texts: DataFrame, paths: tuple[str, str], kind: str) -> DataFrame:
    """Ranges of long texts, encoded all over the cluster, composed in a tree."""
    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = numbered.mapInArrow(
        _cut, f"row long, doc_id {kind}, seq long, a_at long, a_text string, b_at long, b_text string"
    )
    # The row numbers are fixed once the pieces are written.
    pieces = settle(pieces, "ranges").repartition("row", "seq")
    schema = f"row long, doc_id {kind}, {_FRAGMENT}"
    parts = settle(pieces.mapInArrow(_encode_ranges(paths), schema), "fragments")
    last = parts.agg(F.max("seq")).first()[0] or 0
    while last > 0:
        near = F.floor(F.col("seq") / FAN).alias("near")
        parts = parts.groupBy("row", near).applyInArrow(_compose_some(paths), schema)
        last //= FAN
    return parts.mapInArrow(_finish_rows(paths), f"doc_id {kind}, {_DONE}")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each pair."""
    fields = [pa.field("code", pa.int64()), pa.field("n", pa.int64())]
    codes, counts = _NONE, _NONE
    fresh: list[np.ndarray] = []

    def add() -> None:
        nonlocal codes, counts
        given = np.concatenate([codes, *fresh])
        weights = np.concatenate([counts, np.ones(len(given) - len(codes), np.int64)])
        codes, at = np.unique(given, return_inverse=True)
        counts = np.bincount(at, weights, len(codes)).astype(np.int64)
        fresh.clear()

    for batch in batches:
        fresh.append(np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u4").astype(np.int64))
        if sum(map(len, fresh)) > 1 << 20:
            add()
        if len(codes) > 1 << 21:
            yield pa.record_batch([codes, counts], schema=pa.schema(fields))
            codes, counts = _NONE, _NONE
    add()
    yield pa.record_batch([codes, counts], schema=pa.schema(fields))


def _look_up(held, best):
    """Each document's sums over the links whose pair is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = held.value
        most = best.value
        for batch in batches:
            some = [np.frombuffer(x, "<u4") for x in batch.column("codes").to_pylist()]
            sizes = np.array([len(x) for x in some], np.int64)
            given = np.concatenate([np.zeros(0, "<u4"), *some])
            times = np.frombuffer(b"".join(batch.column("occurs").to_pylist()), "<u4").astype(np.int64)
            found = np.zeros(len(given), np.int64)
            if len(codes):
                at = np.minimum(np.searchsorted(codes, given), len(codes) - 1)
                found = np.where(codes[at] == given, counts[at], 0)
            is_best = (found > 0) & (found == most[given >> B_BITS])
            ends = np.cumsum(sizes)

            def each(values: np.ndarray) -> pa.Array:
                sums = np.concatenate([[0], np.cumsum(values)])
                return pa.array(sums[ends] - sums[ends - sizes], pa.int64())

            columns = [batch.column(name) for name in batch.schema.names if name not in ("codes", "occurs")]
            names = [name for name in batch.schema.names if name not in ("codes", "occurs")]
            yield pa.record_batch([*columns, each(times * is_best), each(times * found)], names=[*names, "n_best", "count_sum"])

    return run


def _not_held(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _ = held.value
        for batch in batches:
            sizes = [len(x) // 4 for x in batch.column("codes").to_pylist()]
            given = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u4")
            times = np.frombuffer(b"".join(batch.column("occurs").to_pylist()), "<u4").astype(np.int64)
            rare = np.ones(len(given), bool)
            if len(codes):
                rare = codes[np.minimum(np.searchsorted(codes, given), len(codes) - 1)] != given
            row = np.repeat(batch.column("row").to_numpy(), sizes)
            yield pa.record_batch([row[rare], given[rare].astype(np.int64), times[rare]], names=["row", "code", "times"])

    return run


def _numbers(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(name).to_numpy().astype(np.int64) for name in names]


def align_documents(docs: DataFrame, bytes_path: str, pieces_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: its tokens, groups and links, and what the links count in the corpus.

    The columns are ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``.
    """
    spark = docs.sparkSession
    paths = (bytes_path, pieces_path)
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    is_long = F.coalesce(F.octet_length("text") > RANGE, F.lit(False))
    short = given.where(~is_long).mapInArrow(_align_short(paths), f"doc_id {kind}, {_DONE}")
    long = _align_long(given.where(is_long), paths, kind)
    # Written down with row numbers, which are fixed from here on.
    rows = settle(short.unionByName(long).withColumn("row", F.monotonically_increasing_id()), "aligned")

    counts = settle(
        rows.select("codes").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pairs"
    )
    a_id = F.shiftright("code", B_BITS).alias("a")
    best = counts.groupBy(a_id).agg(F.max("n").alias("most"))  # a row per A id
    ids, most = _numbers(best, "a", "most")
    table = np.zeros(1 << 17, np.int64)
    table[ids] = most

    # The least power of two from which on all pairs can be held.
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = {r["power"]: r["count"] for r in counts.groupBy(power).count().collect()}
    least, so_far = max(sizes, default=0) + 1, 0
    while least > 0 and so_far + sizes.get(least - 1, 0) <= HELD:
        least -= 1
        so_far += sizes.get(least, 0)
    codes, n = _numbers(counts.where(F.col("n") >= 1 << least), "code", "n")
    order = np.argsort(codes)
    held = spark.sparkContext.broadcast((codes[order].astype("<u4"), n[order]))
    broadcast_best = spark.sparkContext.broadcast(table)

    made = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    looked = rows.mapInArrow(_look_up(held, broadcast_best), f"doc_id {kind}, {made}, row long, n_best long, count_sum long")
    if least > 0:
        rare = counts.where(F.col("n") < 1 << least).join(F.broadcast(best), counts["code"].bitwiseAND(~_B_MASK) == F.shiftleft("a", B_BITS))
        rest = rows.select("row", "codes", "occurs").mapInArrow(_not_held(held), "row long, code long, times long")
        rest = rest.join(rare.select("code", "n", (F.col("n") == F.col("most")).alias("is_best")), "code")
        more = rest.groupBy("row").agg(
            F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
        added = [F.col("n_best") + F.coalesce("more_best", F.lit(0)), F.col("count_sum") + F.coalesce("more_sum", F.lit(0))]
        looked = looked.join(more, "row", "left").withColumns({"n_best": added[0], "count_sum": added[1]})
    return looked.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
