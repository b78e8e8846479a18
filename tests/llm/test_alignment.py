"""The alignment of two tokenizers against plain Python and the libraries' own encoders."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from catalith.llm import alignment, queries
from tests.llm import brute

PATHS = tuple(public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spelled(libraries, text):
    """(id, bytes) of all tokens of both kinds."""
    a, b = libraries
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(k): k for k in plain}
    byte_of |= {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in plain)}
    of_a = a.encode(" " + text, add_special_tokens=False)
    left = [(k, bytes(byte_of[c] for c in t)) for k, t in zip(of_a.ids, of_a.tokens, strict=True)]
    right = []
    for k in b.encode(text):
        piece = b.id_to_piece(k)
        data = bytes([int(piece[3:5], 16)]) if b.is_byte(k) else piece.replace("▁", " ").encode()
        right.append((k, data))
    return left, right


def brute_groups(libraries, text):
    if not text:
        return []
    left, right = spelled(libraries, text)
    whole = (" " + text).encode()
    if any(b"".join(data for _, data in side) != whole for side in (left, right)):
        return []
    marks = []
    for kind, side in ((0, left), (1, right)):
        at = 0
        for k, data in side:
            at += len(data)
            marks.append((at, kind, k))
    both = {at for at, kind, _ in marks if kind == 0} & {at for at, kind, _ in marks if kind == 1}
    groups, now = [], ([], [])
    for at in sorted({at for at, _, _ in marks}):
        for end, kind, k in marks if len(marks) < 500 else [m for m in marks if m[0] == at]:
            if end == at:
                now[kind].append(k)
        if at in both:
            groups.append(now)
            now = ([], [])
    return groups


def brute_alignment(libraries, rows):
    groups = [brute_groups(libraries, text) for _, text in rows]
    links = [Counter((a, b) for g in of for a in g[0] for b in g[1]) for of in groups]
    counts = Counter(pair for found in links for pair in found)
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, _), of, found in zip(rows, groups, links, strict=True):
        sides = [sum(len(g[k]) for g in of) for k in (0, 1)]
        shown = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in of)
        n_best = sum(n for pair, n in found.items() if counts[pair] == most[pair[0]])
        count_sum = sum(n * counts[pair] for pair, n in found.items())
        sha = brute.sha(shown) if of else ""
        out.append((doc_id, *sides, len(of), sum(found.values()), n_best, count_sum, sha))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(df):
    return sorted((tuple(row[name] for name in NAMES) for row in df.collect()), key=repr)


PIECES = [
    "the", " the", "word", " tokenization", ",", ". ", " ", "  ", "\n", "\r\n", "'s", "'ll", "é", "ß", "漢字", " 漢", "😀", "1234",
    "<|endoftext|>", "<s>", "<0x41>", "_", "\t", "​", "́", "\x00", "e", "X" * 30, "http://a.b/c?d=1",
]


def texts(n, seed=1):
    rng = random.Random(seed)
    some = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [None, "", " ", "a", "▁", "a▁b and more", "漢" * 50, *some]


def test_ids_are_those_of_the_library(libraries):
    code = alignment.coder(PATHS)
    for text in texts(300, seed=9):
        if text:
            assert code.a_ids(" " + text).tolist() == libraries[0].encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("held", [alignment.HELD, 40, 0])
def test_alignment_matches_brute_force(spark, monkeypatch, libraries, held):
    monkeypatch.setattr(alignment, "HELD", held)
    monkeypatch.setattr(alignment, "TOGETHER", 500)
    rows = list(enumerate(texts(40)))
    rows += [rows[9], rows[9], (None, rows[10][1]), (None, None)]
    docs = spark.createDataFrame([(*row, 5) for row in rows], "doc_id long, text string, n_a int")
    got = alignment.align_documents(docs, *PATHS)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert found(got) == brute_alignment(libraries, rows)


def test_long_texts_are_composed_from_ranges(spark, monkeypatch, libraries):
    for name, value in (("RANGE", 40), ("FAN", 3), ("WIDE", 2)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(2)
    rows = [(i, text) for i, text in enumerate(texts(12, seed=4))]
    rows += [(100, "no" * 200), (101, "a▁b " * 60), (102, "漢字" * 60), (103, " x" * 200), (103, " x" * 200)]
    rows += [(104, " ".join(rng.choice(["it's", "word,", "other", "née", "42nd", "x;y"]) for _ in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(alignment.align_documents(docs, *PATHS)) == brute_alignment(libraries, rows)


def test_composition_is_associative():
    code = alignment.coder(PATHS)
    rng = random.Random(8)
    neutral = alignment.Fragment(alignment.NO_TOKENS, None, alignment.NO_TOKENS)

    def shown(part):
        closed = part.closed and [x.tolist() if isinstance(x, np.ndarray) else x for x in part.closed]
        return [x.tolist() for x in (*part.head, *part.tail)], closed

    left_open = 0
    for turn in range(60):
        text = "".join(rng.choice(PIECES[:8] + PIECES[10:16]) for _ in range(80))
        parts = []
        for _, a_at, a_text, b_at, b_text in alignment.ranges(text, size=rng.choice([3, 7, 20])):
            parts.append(alignment.fragment(alignment.encode_range(a_at, a_text, b_at, b_text, code), code))
        left_open += any(part.closed is not None and len(part.tail.a) + len(part.tail.b) for part in parts)
        whole = alignment.align_whole([text], code)[0]
        for _ in range(3):  # any tree gives the same
            now = list(parts)
            while len(now) > 1:
                k = rng.randrange(len(now) - 1)
                now[k : k + 2] = [alignment.compose(now[k], now[k + 1], code)]
            assert shown(alignment.compose(neutral, now[0], code)) == shown(now[0])
            assert shown(alignment.compose(now[0], neutral, code)) == shown(now[0])
            done = alignment.finish(now[0], code)
            assert done[:5] == whole[:5]
            assert (done.codes == whole.codes).all() and (done.occurs == whole.occurs).all()
    assert left_open > 20


def test_alignment_of_few_rows(spark):
    for rows in ([], [(1, None)], [(1, ""), (1, "")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(alignment.align_documents(docs, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_alignment_query_matches_brute_force(spark, libraries, tmp_path):
    rows = [(7 * k, text) for k, text in enumerate(texts(25, seed=6))] + [(9_999, "one two, three " * 6_000)]
    spark.createDataFrame([(*row, "en", "s", 0) for row in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    assert found(queries.op11_cross_tokenizer(spark, str(tmp_path))) == brute_alignment(libraries, rows)
