"""Personal data, quality rules, chat formatting and mixing: built-in functions only."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalith.llm import chat, mixing, pii, queries, quality_rules
from catalith.session import settle
from tests.llm import brute

TEXTS = [
    None,
    "",
    " \n ",
    "a@b.co_x@y.zz a@b.c.d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.04 1.2.3.0999",
    "é 4111 1111 1111 1111-4111111111111111 5500-0000-0000-0004 \U0001f600 a.b+c@d-e.org.",
    "+1 (555) 123-4567 x " * 300,
    "+" * 500 + "+49 30 1234567890.5",
    "x" * 50_000 + "@b a@" + "b." * 20_000 + "c",
    "1 " * 20_000,
    "4111 1111 1111 1111",
]


def no_python(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_pii_base_matches_brute_force(spark):
    rows = [(i, text, "old") for i, text in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings string")
    found = pii.find(docs)
    assert found.columns == ["doc_id", "findings"] and no_python(found)
    got = found.collect()
    assert len(got) == len(rows)
    base = {kind.name for kind in pii.KINDS if kind.base}
    for row in got:
        text = rows[row["doc_id"]][1]
        spans = [(f["start"], f["kind"], f["end"]) for f in row["findings"] if f["kind"] in base]
        assert spans == [(s, kind, e) for s, _, kind, e in brute.pii(text)]
        assert all((text or "")[f["start"] : f["end"]] == f["found"] for f in row["findings"])


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("IBAN GB82WEST12345698765432.", ["iban"]),
        ("IBAN GB82 WEST 1234 5698 7654 32, ok", ["iban"]),
        ("IBAN GB83WEST12345698765432.", []),
        ("xGB82WEST12345698765432", []),
        ("ssn 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
        ("ssn 123-45-67890", []),
    ],
)
def test_pii_checksums_and_context(spark, text, kinds):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [f["kind"] for f in pii.find(docs).first()["findings"]] == kinds


def test_pii_score_rises_with_context(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co"), (2, "see a@b.co")], "doc_id long, text string")
    scores = {r["doc_id"]: r["findings"][0]["score"] for r in pii.find(docs).collect()}
    assert scores[1] > scores[2]


def test_quality_measures_match_brute_force(spark):
    rng = random.Random(5)
    words = [*"abcdefgh", "#x", "|", "A&B", "é"]
    texts = [None, "", "\n\n", "a b c d e " * 4000, "w\n" * 50, "a\tb\x0bc\x0cd\re  f"]
    texts += [
        "".join(rng.choice(words) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 60)))
        for _ in range(60)
    ]
    rows = [(i, text, 7) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_words long")
    measured = quality_rules.measure(docs)
    assert [c.lower() for c in measured.columns].count("n_words") == 1 and no_python(measured)
    for row in measured.collect():
        wanted = brute.quality(texts[row["doc_id"]])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert tuple(row[c] for c in names) == wanted
        assert row["base_failed"] == (wanted[0] < 10 or 100 * wanted[4] > 20 * wanted[0])


def _texts(n: int, symbol: str = "", seed: int = 0) -> list[str]:
    rng = random.Random(seed)
    return [
        " ".join(f"w{rng.randint(0, 10_000)}{symbol}" for _ in range(30)) for _ in range(n)
    ]


QUALITY = "doc_id long, lang string, source string, text string"


def test_rules_learn_their_thresholds_per_group(spark):
    """What is usual in one source is an outlier in another."""
    n = 400
    rows = [("en", "prose", t) for t in _texts(n)]
    rows += [("en", "code", t) for t in _texts(n, "#", 1)]
    rows += [("en", "prose", _texts(1, "#", 2)[0]), (None, None, _texts(1, "", 3)[0])]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], QUALITY)
    measured = settle(quality_rules.measure(docs))
    good = docs.where(F.col("doc_id") < 2 * n).select("doc_id")
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judge(measured, good).collect()}
    assert not judged[2 * n]
    assert all(kept for key, kept in judged.items() if key != 2 * n)
    # Without documents known to be good there is nothing to learn from.
    assert quality_rules.judge(measured).where("NOT kept").count() == 0


OUTLIERS = {
    "symbol_rate": " ".join(f"w{k}#" for k in range(30)),
    "caps_rate": " ".join(f"ABCD{k}" for k in range(30)),
    "dup_line_rate": "\n".join([f"w{k} {k}" for k in range(10)] + ["z"] * 4 + ["y"] * 4),
    "repeat_rate": " ".join(f"w{k}" for k in [1, 2, 3, 4, 5, 1, 2, 3, 4, 5, *range(10, 60)]),
    "word_length": " ".join(f"wordwordwordword{k}" for k in range(30)),
}


@pytest.mark.parametrize("measure", [*quality_rules.MEASURES, "short words"])
def test_each_fence_can_reject_what_passes_the_base_rule(spark, measure):
    outlier = OUTLIERS.get(measure, " ".join(chr(97 + k) for k in range(26)))
    rows = [(i, "en", f"s{i % 3}", t) for i, t in enumerate(_texts(300))] + [(999, "en", "s1", outlier)]
    docs = spark.createDataFrame(rows, QUALITY)
    measured = settle(quality_rules.measure(docs))
    judged = quality_rules.judge(measured, docs.where("doc_id < 300")).where("NOT kept").collect()
    assert [(r["doc_id"], r["base_failed"]) for r in judged] == [(999, False)]


def test_good_documents_set_how_far_a_rank_may_lie(spark, monkeypatch):
    """Of 1,000 good documents with ever more symbols, the stated share is lost."""
    monkeypatch.setattr(quality_rules, "LOSE", 50)
    rows = [(i, "en", "s", " ".join(f"w{k}" for k in range(990)) + " #" * (i // 10)) for i in range(1_000)]
    measured = settle(quality_rules.measure(spark.createDataFrame(rows, QUALITY)))
    lost = quality_rules.judge(measured, measured.select("doc_id")).where("NOT kept").collect()
    assert all(r["doc_id"] >= 980 for r in lost) and len(lost) <= 5


def test_sketch_buckets_hold_their_values(spark):
    values = spark.range(0, 70_000).select(F.col("id").alias("v"))
    top = quality_rules.bucket_top(quality_rules.bucket(F.col("v")))
    bad = values.select("v", top.alias("top")).where("top < v OR top > v + v / 16")
    assert bad.count() == 0


def test_rules_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert quality_rules.judge(quality_rules.measure(docs)).collect() == []


EVENTS = "conv_id long, seq long, kind string, target long, role string, text string"


def messages(spark, events):
    folded = chat.fold(spark.createDataFrame(events, EVENTS))
    rows = folded.orderBy("conv_id", "number").collect()
    return [(r["conv_id"], r["role"], r["text"]) for r in rows]


def test_chat_folds_deltas_edits_and_regenerations(spark):
    events = [
        (1, 5, "delta", None, None, "new"),
        (1, 0, "message", None, "user", "hi"),
        (1, 1, "message", None, "assistant", "a"),
        (1, 2, "delta", None, None, "b"),
        (1, 3, "delta", None, None, "c"),
        (1, 4, "regenerate", None, None, ""),
        (1, 6, "edit", 0, None, "hello"),
        (2, 0, "message", None, "user", "x"),
        (2, 1, "message", None, "assistant", "one"),
        (2, 2, "delta", None, None, " two"),
        (2, 3, "edit", None, None, "three"),
        (2, 4, "delta", None, None, " four"),
    ]
    assert messages(spark, events) == [
        (1, "user", "hello"),
        (1, "assistant", "new"),
        (2, "user", "x"),
        (2, "assistant", "three four"),
    ]


def test_chat_defined_cases(spark):
    events = [
        (None, None, None, None, None, None),
        (1, 0, "delta", None, "assistant", "early"),
        (2, 0, "edit", 0, "user", "nothing to edit"),
        (3, 1, "message", None, "user", "twice"),
        (3, 1, "message", None, "user", "twice"),
        (3, 2, "edit", 9, "user", "no such message"),
    ]
    assert messages(spark, events) == [
        (None, "", ""),
        (1, "assistant", "early"),
        (3, "user", "twice"),
        (3, "user", "twice"),
    ]
    assert messages(spark, []) == []


@pytest.mark.parametrize(
    "text",
    ["", "\\", "\\\\n", "###", "#####", "</turn>", "\\### Assistant: </turn> ok", "<\\/turn>\n### user: x</turn>\n", "#\\#"],
)
def test_chat_round_trip(spark, text):
    events = [(1, 0, "message", None, "us:er\\", text), (1, 1, "message", None, "assistant", text)]
    made = chat.format_chats(spark.createDataFrame(events, EVENTS))
    assert no_python(made)
    row = made.select(
        chat.formatted(F.col("segments")).alias("whole"), chat.loss_text(F.col("segments")).alias("loss")
    )
    row = row.select("whole", "loss", chat.parse(F.col("whole")).alias("turns")).first()
    assert [(t["role"], t["text"]) for t in row["turns"]] == [("us:er\\", text), ("assistant", text)]
    assert row["loss"] == text
    assert row["whole"].count("</turn>") == 2 and row["whole"].count("###") == 2


def test_chat_shuffles_once(spark):
    made = chat.format_chats(spark.createDataFrame([(1, 0, None, None, "user", "x")], EVENTS))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_chat_query_matches_brute_force(spark, small):
    stored = spark.read.parquet(f"{small}/conversations.parquet")
    rows = [tuple(r) for r in stored.select("conv_id", "turn", "role", "text").collect()]
    trap = "\\### Assistant: </turn> ok"
    wanted = brute.turns(rows + [(-7, 0, "user", trap), (-7, 1, "assistant", trap)])
    got = queries.op8_chat_formatting(spark, small).collect()
    assert len(got) == len(wanted)
    for row in got:
        turns = wanted[row["conv_id"]]
        learned = "".join(t for r, t in turns if r == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == brute.sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learned), brute.sha(learned))


def corpus(spark):
    rng = random.Random(3)
    rows = []
    for key in range(300):
        domain = ("a", "b")[key % 3 == 0]
        vocabulary = [f"{domain}{i}" for i in range(40)] + [f"both{i}" for i in range(20)]
        rows.append((key, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))), domain))
    rows += [(1000, None, None), (1001, "", None), (0, rows[0][1], None)]
    return spark.createDataFrame(rows, "doc_id long, text string, rate string")


def test_mixing_meets_targets(spark):
    docs = corpus(spark)
    labelled = docs.where("rate IS NOT NULL").select("doc_id", F.col("rate").alias("domain"))
    mixed = mixing.mix(docs, labelled, {"a": 0.3, "b": 0.7})
    rows = mixed.collect()
    assert len(rows) == 303 and mixed.columns.count("rate") == 1
    totals = [sum(r["n_tokens"] * r["rate"] * r["posterior"][k] for r in rows) for k in range(2)]
    assert totals[0] / sum(totals) == pytest.approx(0.3, abs=0.02)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    assert all(sum(r["posterior"]) == pytest.approx(1, abs=1e-5) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["posterior"][1] > 0.9 and by_id[1]["posterior"][0] > 0.9


def test_mixing_rates_are_those_of_plain_projected_gradient(spark):
    import numpy as np

    rows = [(10, [0.9, 0.1]), (30, [0.2, 0.8]), (5, [0.5, 0.5]), (0, [0.4, 0.6]), (80, [1.0, 0.0])]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    rated, reached, goal = mixing.fit_rates(members, [0.05, 0.95], 60.0, 1.0)
    got = {tuple(r["posterior"]): r["rate"] for r in rated.collect()}
    n = np.array([r[0] for r in rows], float)
    p = np.array([r[1] for r in rows])
    target = np.array([3.0, 57.0])
    slack = mixing.slack_of((p * n[:, None]).sum(0), (p**2 * n[:, None]).sum(0), target)
    w = np.ones(len(rows))
    step = 1 / (1 + ((p * n[:, None]).T @ p / slack).sum())
    for _ in range(300_000):
        gap = (p * (n * w)[:, None]).sum(0) - target
        w = np.maximum(w - step * (p @ (gap / slack) + w - 1), 0)
    assert goal == pytest.approx([3.0, 57.0])
    for row, rate in zip(rows, w):
        assert got[tuple(row[1])] == pytest.approx(rate, abs=1e-3)
    assert min(got.values()) == 0.0


def test_mixing_leaves_documents_it_cannot_tell_apart(spark):
    rows = [(10, [0.9 - k / 1000, 0.1 + k / 1000]) for k in range(20)]
    members = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    rated, _, _ = mixing.fit_rates(members, [0.99, 0.01], None, 1.0)
    assert all(0.8 < r["rate"] < 1.2 for r in rated.collect())


def test_mixing_tells_what_the_domains_got(spark, monkeypatch):
    docs = corpus(spark)
    labelled = docs.where("rate IS NOT NULL").select("doc_id", F.col("rate").alias("domain"))
    mixed, fit = mixing.mix_and_fit(docs, labelled, {"a": 0.3, "b": 0.7})
    rows = mixed.collect()
    totals = [sum(r["n_tokens"] * r["rate"] * r["posterior"][k] for r in rows) for k in range(2)]
    assert fit.domains == ["a", "b"] and fit.reached == pytest.approx(totals, rel=1e-4)
    assert fit.converged and fit.wanted[1] == pytest.approx(1.1 * fit.has[1])
    unlike = [(10, [0.9 - k / 1000, 0.1 + k / 1000]) for k in range(20)]
    members = spark.createDataFrame(unlike, "n_tokens long, posterior array<double>")
    _, fit = mixing.rates_and_fit(members, {"a": 0.99, "b": 0.01}, None, 1.0)
    assert fit.converged and fit.reached[1] > 5 * fit.wanted[1]  # a missed target is told
    monkeypatch.setattr(mixing, "STEPS", 0)
    with pytest.warns(RuntimeWarning, match="not converged"):
        _, fit = mixing.rates_and_fit(members, {"a": 0.99, "b": 0.01}, None, 1.0)
    assert not fit.converged and fit.steps == 0


def test_mixing_without_labels_or_rows(spark):
    docs = corpus(spark)
    none = spark.createDataFrame([], "doc_id long, domain string")
    row = mixing.mix(docs, none, {"a": 0.5, "b": 0.5}).first()
    assert row["posterior"] == [0.5, 0.5]
    assert mixing.mix(docs.limit(0), none, {"a": 0.5, "b": 0.5}).collect() == []


def test_native_queries_run_no_python(spark, small):
    for name in ("op1_pii", "op3_quality_rules", "op8_chat_formatting", "op10_mixing"):
        assert no_python(queries.queries()[name](spark, small))
