"""The filter audit and line dedup against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from catalith.llm import filter_audit, line_dedup
from tests.llm import brute
from tests.llm.test_native import no_python

LETTERS = "ABCDE"


def failures(rows):
    """The failed letters of each row (doc_id, text, lang)."""
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = brute.GAPS.findall(text)
        failed = "A" if len(words) < 200 else ""
        failed += "B" if 100 * len(set(words)) < 50 * len(words) else ""
        failed += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        failed += "D" if re.search("[#$%&*|]", text) else ""
        failed += "E" if doc_id is not None and least[text] < doc_id else ""
        out.append(failed)
    return out


def brute_audit(rows, labels):
    good = {d for d, quality, _ in labels if quality == 1} - {None}
    toxic = {d for d, _, is_toxic in labels if is_toxic == 1} - {None}
    out, judged = {}, failures(rows)
    for order in map("".join, permutations(LETTERS)):
        for (doc_id, _, lang), failed in zip(rows, judged, strict=True):
            gone = False
            for step, letter in enumerate(order, 1):
                counts = out.setdefault((lang or "", order, step), Counter())
                fails = letter in failed
                counts["redundant"] += fails and gone
                counts["unique_fails"] += failed == letter
                counts["removed"] += fails and not gone
                counts["good_lost"] += fails and not gone and doc_id in good
                counts["toxic_lost"] += fails and not gone and doc_id in toxic
                gone = gone or fails
                counts["kept"] += not gone
    totals = defaultdict(int)
    for (part, order, step), counts in out.items():
        totals[part, order[step - 1]] += counts["removed"]
    for (part, order, step), counts in out.items():
        counts["shapley"] = totals[part, order[step - 1]]
    return out


def check_audit(spark, rows, labels):
    # Clashing names: the results have these columns, too.
    docs = spark.createDataFrame(
        [(*row, 7, "x") for row in rows], "doc_id long, text string, lang string, kept long, part string"
    )
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    answer = filter_audit.audit(docs, given)
    wanted = brute_audit(rows, labels)
    got = answer.collect()
    assert len(got) == len(wanted)
    for row in got:
        counts = wanted[row["part"], row["filter_order"], row["step"]]
        assert row["filter"] == row["filter_order"][row["step"] - 1]
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"):
            assert row[name] == counts[name], (row, counts)


def test_filter_audit_matches_brute_force(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(300))
    few = " ".join(rng.choice(["a", "A", "b"]) for _ in range(250))
    texts = [None, "", " \n", long, few, long.upper(), long + " $5", "ÀÉ " * 300, "a | B", few + "#", "x" * 200_000]
    rows = [(i, rng.choice(texts), rng.choice([None, "", "en", "de"])) for i in range(150)]
    rows += [rows[3], rows[3], (None, long, "en"), (None, None, "de"), (5, "another", "en"), (5, "another", "en")]
    labels = [(rng.randrange(150), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(90)]
    check_audit(spark, rows, labels + [(None, 1, 1), (9_999, 1, 1), (3, 0, 0), (3, 1, 1)])


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(2, "same", "en"), (1, "same", "en")]])
def test_filter_audit_of_few_rows(spark, rows):
    check_audit(spark, rows, [])


def test_a_hot_text_is_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "SHARES", 7)
    rows = [(i, "copy" if i % 3 else f"own {i}", "en") for i in range(200)]
    rows += [(300 + i, f"pair {i // 2}", "de") for i in range(20)]
    check_audit(spark, rows, [(i, 1, 0) for i in range(0, 200, 5)])


def test_filter_audit_takes_given_orders(spark):
    counted = spark.createDataFrame([("p", True, False, 3, 4)], "part string, good boolean, toxic boolean, mask int, n long")
    got = {(r["filter_order"], r["step"]): (r["removed"], r["shapley"]) for r in filter_audit.report(counted, "AB", ["BA"]).collect()}
    assert got == {("BA", 1): (4, 4), ("BA", 2): (0, 4)}


def key_of(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def brute_lines(rows):
    last = (1, 0)
    place = [last if doc_id is None else (0, doc_id) for doc_id, _ in rows]
    first = {}
    for at, (_, text) in zip(place, rows, strict=True):
        for line in (text or "").split("\n"):
            first[key_of(line)] = min(at, first.get(key_of(line), at))
    out = []
    for at, (doc_id, text) in zip(place, rows, strict=True):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < line_dedup.LEAST or first[key_of(x)] == at]
        out.append((doc_id, text or "", len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def check_lines(spark, rows):
    docs = spark.createDataFrame([(*row, "old", 1) for row in rows], "doc_id long, text string, keep string, N_LINES int")
    judged = line_dedup.dedup(docs)
    assert [c.lower() for c in judged.columns] == ["doc_id", "text", "n_lines", "n_dropped", "keep"]
    text = line_dedup.apply_keep(F.col("text"), F.col("keep"))
    shown = judged.select("doc_id", "text", "n_lines", "n_dropped", text.alias("kept"), "keep")
    assert no_python(shown)
    got = shown.collect()
    for row in got:  # runs are maximal, apart and inside the text
        ends = [(run["start"], run["start"] + run["length"]) for run in row["keep"]]
        assert all(a < b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
        assert sum(b - a for a, b in ends) == row["n_lines"] - row["n_dropped"]
    found = [(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"], r["kept"]) for r in got]
    assert sorted(found, key=repr) == brute_lines(rows)


LINES = [
    "", " ", "short", "a line of some length", "A Line Of Some Length\t", "\x0b a line of some length \r",
    "été à la plage", "ÉTÉ à la plage", " a line of some length", "ten chars!", "nine char", "漢" * 10, "another line here",
]


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100 + i, f"line of its own, {i}\nand a line of all of them\nline of its own, {i}") for i in range(30)]
    rows += [rows[40], rows[40], (None, rows[1][1]), (None, "only where there is no id\nx"), (None, "only where there is no id")]
    rows += [(7, "two rows of one id share this"), (7, "two rows of one id share this\n"), (-4, None), (-3, ""), (5, "\n\n")]
    rows += [(200, "\n".join(f"many lines, {k % 700}" for k in range(20_000))), (201, "many lines, 5\n" + "y" * 300_000)]
    check_lines(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "alone in the table\nalone in the table")]])
def test_line_dedup_of_few_rows(spark, rows):
    check_lines(spark, rows)


def test_hot_lines_are_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARES", 12)
    rows = [(1000 - i, f"a very frequent line\nown line number {i}\n" + "a pair of lines\n" * (i % 2)) for i in range(300)]
    check_lines(spark, rows)


def test_lines_are_range_partitioned_and_streamed_in_place(spark):
    docs = spark.createDataFrame([(1, "some line or other"), (2, "some line or other")], "doc_id long, text string")
    lines = line_dedup._hashed(docs, "doc_id", "text")
    plan = line_dedup._dropped(lines)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(h" in plan and "Window" in plan
    after = plan[: plan.index("rangepartitioning(h")]
    assert "hashpartitioning" not in after
