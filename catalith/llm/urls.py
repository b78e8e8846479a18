"""URL filtering by host and path rules, carried over to aliases of a page.

Two addresses are aliases when one redirects to the other or names it as canonical.
Links are read from the pages (``<link rel=canonical>`` and ``<meta http-equiv=refresh>``),
may be given as a table, and lead from every address to its plain form: without
scheme, ``www.``, ``m.``, ``amp.``, port 80 or 443, fragment, tracking parameters and closing
slash. Connected components over these links are the equivalence classes.

The verdict of an address: the longest rule that fits it, when one does. Otherwise, if
its class holds an address that a rule allows, it is allowed: an explicit allow goes
before any block. Otherwise, if its class holds a blocked one, it is blocked; with
neither, it is allowed.

A target in a page is decoded (``&amp;``) and resolved against the page's address, or its ``<base href>``:
relative paths, queries alone, dot segments. A target with dot segments and a scheme counts as it
is written, too. One without a host, as ``mailto:``, is no link.

Defined cases: a null address, or one without ``://``, has an empty host and path, fits
no rule, has no aliases and is allowed. A null page text has no links. Repeated pages
are judged each. An input column named like a made one is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalith.llm.common import others
from catalith.llm.components import components
from catalith.session import Scratch, settle


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """The host, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def plain_form(url: Column) -> Column:
    """The address all spellings of one page share; null without a host."""
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^(www|m|mobile|amp)\.(?=[^.]+\.)", "")
    query = F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    asked = F.array_sort(
        F.filter(
            F.split(query, "&"),
            lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"),
        )
    )
    path = F.regexp_replace(path_of(url), r"/+$", "")
    tail = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def fitting_rule(host: Column, path: Column, rules: list[Rule], part: str) -> Column:
    """``part`` (``name`` or ``action``) of the longest rule that fits, else null.

    A rule's length is that of its host and path; of equally long rules an allow wins,
    then the first by name.
    """
    order = sorted(rules, key=lambda r: (-len(r.name), r.action != "allow", r.name))

    def fits(rule: Rule) -> Column:
        inside = (host == rule.host) | host.endswith("." + rule.host)
        return inside & path.startswith(rule.path)

    first, *rest = order
    begin = F.when(fits(first), getattr(first, part))
    return reduce(lambda so_far, r: so_far.when(fits(r), getattr(r, part)), rest, begin)


_PARTS = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?")


def _tidy(path: str) -> str:
    """An absolute path without dot segments."""
    parts, out = path.split("/")[1:], []
    for part in parts:
        if part == "..":
            del out[-1:]
        elif part != ".":
            out.append(part)
    if parts and parts[-1] in (".", ".."):
        out.append("")
    return "/" + "/".join(out)


def resolve(base: str, target: str) -> str | None:
    """The address that ``target`` means on a page at ``base`` (RFC 3986, 5.2); null without a host."""
    scheme, host, path, query, fragment = _PARTS.fullmatch(target).groups(default="")
    if scheme and not host:
        return None
    if not host:
        own_scheme, host, own_path, own_query, _ = _PARTS.fullmatch(base).groups(default="")
        scheme = own_scheme
        if not path:
            return f"{scheme}:{host}{own_path}{query or own_query}{fragment}" if scheme and len(host) > 2 else None
        if not path.startswith("/"):
            path = (own_path.rpartition("/")[0] if own_path else "") + "/" + path
    elif not scheme:
        scheme = _PARTS.fullmatch(base)[1] or "http"
    if not scheme or len(host) < 3:
        return None
    return f"{scheme}:{host}{_tidy(path) if path else ''}{query}{fragment}"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _addresses(source: pa.Array, base: pa.Array, target: pa.Array) -> pa.Array:
    """The address of a target, and its own spelling where that differs."""
    out = []
    for page, start, name in zip(source.to_pylist(), base.to_pylist(), target.to_pylist()):
        page, name = page or "", unescape(name).strip()
        if start:
            page = resolve(page, unescape(start).strip()) or page
        made = [resolve(page, name)]
        if made[0] and re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", name) and name != made[0]:
            made.append(name)
        out.append(made if made[0] else [])
    return pa.array(out, pa.list_(pa.string()))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``source, target``: the addresses that pages name as canonical or redirect to."""
    text = F.coalesce(F.col(html), F.lit(""))
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    move = r"(?is)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
    found = F.concat(
        F.when(text.rlike("(?i)canonical"), F.regexp_extract_all(text, F.lit(tag), F.lit(1)))
        .otherwise(F.array().cast("array<string>")),
        F.when(text.rlike("(?i)http-equiv"), F.regexp_extract_all(text, F.lit(move), F.lit(1)))
        .otherwise(F.array().cast("array<string>")),
    )
    start = r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    base = F.when(text.rlike("(?i)<base"), F.regexp_extract(text, start, 1)).otherwise("")
    links = pages.select(
        F.col(url).alias("source"),
        F.when(F.size(found) > 0, base).alias("base"),
        F.explode(found).alias("target"),
    )
    return links.select("source", F.explode(_addresses("source", "base", "target")).alias("target"))


def judge(
    pages: DataFrame,
    rules: list[Rule],
    url: str = "url",
    html: str | None = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """All columns of ``pages`` but the page text, with ``host, path, rule, verdict, alias_of``.

    ``redirects`` may add ``source, target`` addresses. ``alias_of`` is the smallest
    plain address of the class, null without a host.
    """
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict", "alias_of", "_url_plain", "_url_action"]
    made += [html] if html else []
    address = F.col(f"`{url}`")
    host, path = host_of(address), path_of(address)
    with Scratch(spark, "urls") as scratch:
        links = []
        if html:
            links.append(page_links(pages, f"`{url}`", f"`{html}`"))
        if redirects is not None:
            links.append(redirects.select("source", "target"))
        named = reduce(DataFrame.union, links) if links else None
        told = None
        if named is not None:
            named = scratch.settle(named.where("source IS NOT NULL AND target IS NOT NULL"), "links")
            told = components(
                named.select(
                    plain_form(F.col("source")).alias("u"), plain_form(F.col("target")).alias("v")
                )
            )
        judged = pages.select(*others(pages, made), host.alias("host"), path.alias("path"), plain_form(address).alias("_url_plain"))
        judged = judged.select(
            *others(judged, ["rule", "_url_action"]),
            fitting_rule(F.col("host"), F.col("path"), rules, "name").alias("rule"),
            fitting_rule(F.col("host"), F.col("path"), rules, "action").alias("_url_action"),
        )
        if told is not None:
            judged = judged.join(
                told.select(F.col("node").alias("_url_plain"), F.col("component").alias("_url_class")),
                "_url_plain",
                "left",
            ).withColumn("alias_of", F.coalesce("_url_class", "_url_plain")).drop("_url_class")
        else:
            judged = judged.withColumn("alias_of", F.col("_url_plain"))
        judged = scratch.settle(judged, "judged")
        # Addresses that are only linked to may be explicitly allowed or blocked as well.
        seen = judged.select("alias_of", F.col("_url_action").alias("action"))
        if named is not None:
            ends = named.select(F.explode(F.array("source", "target")).alias("url"))
            ends = ends.select(
                plain_form(F.col("url")).alias("node"),
                fitting_rule(host_of(F.col("url")), path_of(F.col("url")), rules, "action").alias("action"),
            )
            seen = seen.union(
                ends.join(told, "node").select(F.col("component").alias("alias_of"), "action")
            )
        classes = (
            seen.where("action IS NOT NULL AND alias_of IS NOT NULL")
            .groupBy("alias_of")
            .agg(F.min("action").alias("_url_carried"))  # "allow" sorts before "block"
        )
        verdict = F.coalesce("_url_action", "_url_carried", F.lit("allow"))
        result = judged.join(classes, "alias_of", "left").select(
            *others(judged, made), "host", "path", "rule", verdict.alias("verdict"), "alias_of"
        )
        return settle(result, "urls")
