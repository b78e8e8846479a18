"""Decontamination, the Jaccard join, components and URL classes."""

from __future__ import annotations

import random
import re
from html import unescape
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from catalith.llm import decontam, jaccard, queries, urls
from catalith.llm.components import components
from catalith.llm.shingles import PIECE, shingle_sets
from tests.llm import brute

ITEMS = "item_id long, text string"


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["a", "b", "c", "dé", "42", "漢"]

    def text(n):
        return rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(25)]
    items += [(None, text(12)), (7, None), (8, ""), (9, "..."), (3, items[3][1]), (30, items[4][1])]
    docs = [(i, text(rng.randint(0, 60)), -1) for i in range(60)]
    docs += [(i, f"A B {items[i % 25][1].upper()} x", -1) for i in range(60, 80)]
    docs += [(80, None, -1), (81, "", -1), (81, "", -1), (82, items[13][1] * 2000, -1)]
    given = spark.createDataFrame(docs, "doc_id long, text string, N_HIT long")
    wanted = [brute.contamination(text, items) for _, text, _ in docs]
    for block in (decontam.BLOCK_WORDS, 20):  # one pass, and many
        monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
        found = decontam.find(given, spark.createDataFrame(items, ITEMS))
        assert [c.lower() for c in found.columns].count("n_hit") == 1
        got = sorted(
            ((r["doc_id"], r["text"] or "", r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in found.collect())
        )
        due = sorted(
            (d, t or "", n, hit, ids, hit > 0) for (d, t, _), (n, hit, ids) in zip(docs, wanted)
        )
        assert got == due


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = decontam.find(docs, spark.createDataFrame([], ITEMS)).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (3, 0, False)
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    assert decontam.find(docs.limit(0), items).collect() == []


def test_shingle_sets_match_brute_force():
    rng = random.Random(2)
    texts = ["", " ", "A b", "a B", "a b c", "x" * (PIECE + 5) + " y z", "ab " * PIECE]
    texts += [" ".join(rng.choice("abcdÉ") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    for size in (1, 3, 5):
        found = list(shingle_sets([t.encode() for t in texts], size))
        wanted = [brute.shingles(t, size) for t in texts]
        assert [len(f) for f in found] == [len(w) for w in wanted]
        names = {}
        for hashes, grams in zip(found, wanted):
            assert names.setdefault(grams, hashes.tobytes()) == hashes.tobytes()
        assert len(set(names.values())) == len(names)


def near_copies(rng, base, changes):
    words = base.split()
    for place in rng.sample(range(len(words)), min(changes, len(words))):
        words[place] = f"n{rng.randint(0, 10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size, num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_components_match_all_pairs(spark, size, num):
    rng = random.Random(size)
    rows = [(0, None), (1, ""), (2, "one"), (3, "ONE"), (4, "one two"), (5, " one\ttwo ")]
    for k in range(8):  # groups of near copies, from close to far
        base = " ".join(f"v{rng.randint(0, 300)}" for _ in range(rng.choice([12, 60, 150])))
        for _ in range(25):
            rows.append((len(rows), near_copies(rng, base, rng.randint(0, 4))))
    common = " ".join(f"c{i}" for i in range(30))  # a passage that many share
    for _ in range(40):
        own = " ".join(f"v{rng.randint(0, 300)}" for _ in range(rng.randint(1, 60)))
        rows.append((len(rows), f"{common} {own}"))
    rows += [(len(rows) + k, "to be or not to be " * 3) for k in range(15)]
    ids = [key for key, _ in rows]
    shuffled = list(range(len(rows)))
    rng.shuffle(shuffled)
    rows = [(shuffled[key], text) for key, text in rows]
    like = jaccard.Likeness(size, num, 100)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(7)
    got = {r["doc_id"]: r for r in jaccard.join(docs, like).collect()}
    wanted = brute.components(rows, size, num, 100)
    assert {key: r["component_id"] for key, r in got.items()} == wanted
    assert all(got[key]["n_shingles"] == len(brute.shingles(text, size)) for key, text in rows)
    assert sorted(got) == sorted(ids)


def test_jaccard_link_at_exactly_the_threshold(spark):
    """Nine of ten tokens in common are 90 %; of eleven they are not."""
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i"), (3, "a b c d e f g h i x y")]
    like = jaccard.Likeness(1, 90, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, like).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_jaccard_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "a b c d"), (None, None), (7, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(docs).collect()
    assert len(got) == 6
    assert sorted(str(r["component_id"]) for r in got) == ["5", "5", "5", "5", "7", "None"]
    assert jaccard.join(docs.limit(0)).collect() == []


def test_components_of_a_long_path_a_star_and_loops(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)]
    links += [(2, 2), (5000, 5000), (None, 3), (3001, 3000), (3000, 3001), (3000, 3001)]
    rng = random.Random(4)
    rng.shuffle(links)
    found = components(spark.createDataFrame(links, "u long, v long")).collect()
    got = {r["node"]: r["component"] for r in found}
    assert len(found) == len(got)
    wanted = {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)} | {3000: 3000, 3001: 3000}
    assert got == wanted
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []


PAGES = "page_id long, url string, html string, rule int"


def verdicts(spark, pages, **more):
    judged = urls.judge(spark.createDataFrame(pages, PAGES), queries.URL_RULES, **more)
    assert judged.columns.count("rule") == 1 and "html" not in judged.columns
    return [(r["page_id"], r["rule"], r["verdict"]) for r in judged.orderBy("page_id").collect()]


def test_url_blocks_reach_aliases(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/fr/1">', 0),
        (2, "http://b.net/fr/1", None, 0),
        (3, "http://c.org/q", '<meta http-equiv="refresh" content="0; url=http://a.org/x">', 0),
        (4, "http://d.org/", "", 0),
    ]
    assert verdicts(spark, pages) == [
        (1, None, "block"),
        (2, "net/fr/", "block"),
        (3, None, "block"),
        (4, None, "allow"),
    ]


def test_url_explicit_allow_goes_before_a_carried_block(spark):
    pages = [
        (1, "http://e.net/es/1", None, 0),
        (2, "http://f.com/a", '<link rel=canonical href="http://e.net/es/1">', 0),
        (3, "http://g.org/", '<link rel=canonical href="/z"><link href="http://e.net/es/1" rel="canonical">', 0),
    ]
    assert verdicts(spark, pages) == [(1, "net/es/", "block"), (2, "com/", "allow"), (3, None, "allow")]


def test_url_targets_are_resolved_like_the_library_does():
    rng = random.Random(7)
    pieces = ["a", "b.html", "..", ".", "c%20d", "é"]  # the library drops empty ones
    bases = ["http://h.org", "http://h.org/", "https://h.org/x/y/z?q=1#f", "http://h.org/x/./y", "http://h.org/x/y/"]
    for _ in range(3000):
        path = "/".join(rng.choice(pieces) for _ in range(rng.randint(0, 5)))
        head = rng.choice(["", "", "/", "../", "./"])
        target = head + path.lstrip("/") + rng.choice(["", "?id=2", "?u=http://x.y/../z"]) + rng.choice(["", "#t"])
        base = rng.choice(bases)
        got, wanted = urls.resolve(base, target), urljoin(base, target)
        if target.startswith("#") or not target:  # the library keeps the page's path as it is
            assert got.split("#")[0].split("?")[0].startswith(base[:12])
        else:
            assert got == wanted, (base, target)
    # The library leaves dot segments after a host of the target's own; RFC 3986 does not.
    assert urls.resolve("https://h.org/x", "//o.net/./a/../b#t") == "https://o.net/b#t"
    assert urls.resolve("https://h.org/x", "http://o.net/a/..") == "http://o.net/"
    assert urls.resolve("http://h.org/", "mailto:x@y.z") is None and urls.resolve("x", "y") is None


def test_url_links_by_relative_and_encoded_targets(spark):
    blocked = "http://b.net/fr/"
    texts = [
        ("http://b.org/dir/p", '<link rel="canonical" href="index.html">'),
        ("http://b.org/dir/sub/p", '<link rel="canonical" href="../index.html">'),
        ("http://b.org/dir/q", "<meta http-equiv=refresh content='0; url=index.html?id=2&amp;x=1'>"),
        ("http://b.org/dir/index.html", '<link rel="canonical" href="?id=2">'),
        ("http://b.org/dir/index.html?x=1&id=2", f'<link rel="canonical" href="{blocked}a?r=1&#38;s=2">'),
        ("http://b.org/dir/index.html?id=2", f'<base href="{blocked}x/"><link rel=canonical href="../a?s=2&amp;r=1">'),
        ("http://b.org/other", '<link rel="canonical" href="mailto:a@b.net">'),
        ("http://b.org/dots", f'<link rel="canonical" href="{blocked}x/../a?r=1&s=2">'),
    ]
    pages = [(k, url, html, 0) for k, (url, html) in enumerate(texts)]

    # Brute force: links by the library, then classes by repeated passes.
    def plain(url):
        scheme, host, path, query, _ = urlsplit(url)
        return host + path.rstrip("/") + ("?" + "&".join(sorted(query.split("&"))) if query else "")

    links = []
    for url, html in texts:
        base = urljoin(url, unescape((re.findall(r'<base href="([^"]*)', html) or [""])[0]))
        target = re.findall(r"(?:canonical\"? href=|url=)\"?([^\"'>]*)", html)[0]
        links.append((plain(url), plain(urljoin(base, unescape(target)))))
    lead = {n: n for pair in links for n in pair}
    for _ in lead:
        for a, b in links:
            lead[a] = lead[b] = min(lead[a], lead[b])
    carried = {lead[n] for n in lead if n.startswith(plain(blocked))}
    wanted = [(k, None, "block" if lead[plain(url)] in carried else "allow") for k, (url, _) in enumerate(texts)]
    assert verdicts(spark, pages) == wanted
    assert [v for _, _, v in wanted] == ["block"] * 6 + ["allow", "block"]


def test_url_given_redirects_spellings_and_defined_cases(spark):
    pages = [
        (1, "HTTP://WWW.Lone.org:80/p/?utm_source=a#top", None, 0),
        (2, "https://m.lone.org/p?b=2&a=1", None, 0),
        (3, "https://lone.org/p?a=1&b=2", None, 0),
        (4, None, "x", 0),
        (5, "no address", "x", 0),
        (5, "no address", "x", 0),
    ]
    moves = spark.createDataFrame(
        [("http://lone.org/p", "http://x.net/fr/"), (None, "http://x.net/fr/")], "source string, target string"
    )
    got = verdicts(spark, pages, redirects=moves)
    assert got == [
        (1, None, "block"),
        (2, None, "allow"),
        (3, None, "allow"),
        (4, None, "allow"),
        (5, None, "allow"),
        (5, None, "allow"),
    ]
    plain = spark.createDataFrame(pages, PAGES).select(urls.plain_form(F.col("url")).alias("p")).collect()
    assert [r["p"] for r in plain] == ["lone.org/p", "lone.org/p?a=1&b=2", "lone.org/p?a=1&b=2", None, None, None]
    assert verdicts(spark, []) == []


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://example.com/en/1", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://a.example.com/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://EXAMPLE.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
        ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://x.net/es/?q", "x.net", "/es/", "net/es/", "block"),
        ("x://a?b://c/d", "a", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None, 0)], PAGES)
    row = urls.judge(pages, queries.URL_RULES, html=None).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule, verdict)
