"""Mixing documents to target weights by soft membership, with built-in functions only.

A classifier learned from a labelled table gives every document a probability per
domain. Rates, one per document and never negative, are then fitted by projected
gradient so that the expected tokens of each domain meet its target.

Classifier: the distinct words of a text fall into hashed cells. Those that labelled documents
show to tell domains apart have a weight per domain. A softmax regression takes the
strongest weight and the sum per domain, and the shape of the text. The labelled sample is
bounded (``MOST_LABELLED`` rows, those with the smallest hash of their id, one per id and domain); one half shows
the cells, the other fits the regression. The model is a table of fixed size.

Fit: with tokens n, probabilities p, rates w and targets t, domain totals are ``sum(n w p)``.
Minimised are the squares of the gaps ``totals - t``, over ``R``, plus ``sum(n (w - 1)^2)``, for w of 0
and more. A step is one pass that sums the totals; it moves the multipliers of the domains
along the gradient, scaled by ``(G + R)^-1`` with ``G = sum(n p p')`` where w > 0, and projects the rates
``1 - p . multipliers`` at zero. Without projections the first step is the answer. The driver holds a few
numbers per domain, whatever the table.

``R`` is small for a domain that the probabilities tell apart (targets are then met to
about a hundredth), and large for one they hardly do: a noisy guess must not decide which
documents go. Such a target is missed: ``Fit`` says what each domain was to get and got, and whether the
steps ended at the minimum; if they did not, a warning is given as well.

Defined cases: a null or empty text has no tokens; it adds nothing to totals, and has a
rate by its probabilities. Without labelled documents every domain is as likely. Labels of other
domains, null labels and null ids are ignored. Repeated documents are fitted each; they share
their rate and their copies. A target that no document can reach is approached. An empty
table gives an empty result. An input column named like a made one is replaced.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import labelled_texts, others
from catalith.session import Scratch, settle

#: Labelled documents that the classifier is fitted on, at most.
MOST_LABELLED = 20_000
CELLS = 1 << 14
#: A cell counts if its rate in a domain differs from the others' by so many standard errors.
LEAST_SHOWN = 3.5
STEPS = 40
#: Of the regression's squared weights: a small sample must not sound sure.
PENALTY = 10.0
#: Of a domain's target, times its unexplained over its explained variance: the slack ``R``.
SLACK = 0.02
CLOSE = 1e-6
_MADE = ("n_tokens", "posterior", "rate", "copies")
_HIDDEN = ("_mix_words", "_mix_cells", "_mix_shape")


def features(docs: DataFrame, text: str, chosen: list[Column]) -> DataFrame:
    """``chosen``, ``n_tokens``, the distinct cells of a text and its shape.

    The shape: logarithms of the shares of symbols and capitals, the share of distinct
    words, and the logarithm of their number.
    """
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(F.lower(raw), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    chars = F.greatest(F.char_length(raw), F.lit(1))

    def share(pattern: str) -> Column:
        return F.log2(F.regexp_count(raw, F.lit(pattern)) * 1000 / chars + 1)

    step = docs.select(
        *chosen,
        words.alias("_mix_words"),
        F.array(share(r"[#*$%&|<>!]"), share(r"\p{Lu}")).alias("_mix_shape"),
    )
    kept = [F.col(f"`{c}`") for c in step.columns if c not in _HIDDEN]
    step = step.select(
        *kept,
        "_mix_shape",
        F.size("_mix_words").cast("long").alias("n_tokens"),
        F.array_distinct("_mix_words").alias("_mix_words"),
    )
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    shape = F.concat("_mix_shape", F.array(F.size("_mix_words") / n, F.log2(n.cast("double"))))
    cell = F.transform("_mix_words", lambda w: F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int"))
    return step.select(*kept, "n_tokens", cell.alias("_mix_cells"), shape.alias("_mix_shape"))


class Classifier:
    """Softmax regression on the evidence of cells and the shape of a text."""

    def __init__(self, domains: list[str], weights: np.ndarray) -> None:
        self.domains, self.weights = domains, weights
        self.slope = np.zeros((2 * len(domains) + 4, len(domains)))
        self.level = np.zeros(len(domains))

    def inputs(self, featured: DataFrame) -> DataFrame:
        """``featured`` with ``_mix_x`` instead of its cells and shape."""
        kept = [F.col(f"`{c}`") for c in featured.columns if c not in _HIDDEN]
        zero = F.lit(0.0)
        tables = [
            F.from_json(F.lit(json.dumps([round(float(x), 4) for x in column])), "array<double>")
            for column in self.weights.T
        ]

        def look(table: Column) -> Column:
            return F.filter(
                F.transform("_mix_cells", lambda cell: F.get(table, cell)), lambda w: w != 0
            )

        found = featured.select(
            *kept, "_mix_shape", F.array(*(look(t) for t in tables)).alias("_mix_found")
        )
        strongest = F.transform("_mix_found", lambda w: F.greatest(F.coalesce(F.array_max(w), zero), zero))
        added = F.transform(
            "_mix_found",
            lambda w: F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
            / F.sqrt(F.size(w) + F.lit(1.0)),
        )
        return found.select(*kept, F.concat(strongest, added, "_mix_shape").alias("_mix_x"))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit the softmax regression on a bounded sample."""
        k, n = len(self.domains), len(x)
        if not n:
            return
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.hstack([(x - mean) / scale, np.ones((n, 1))])
        wanted = np.eye(k)[y]
        coef = np.zeros((z.shape[1], k))
        ridge = np.full(z.shape[1], PENALTY)
        ridge[-1] = 1e-3
        # A fixed bound of the curvature, so that every step lowers the loss.
        curve = np.linalg.inv(0.5 * (z.T @ z) + np.diag(ridge))
        for _ in range(500):
            score = z @ coef
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            step = curve @ (z.T @ (p - wanted) + ridge[:, None] * coef)
            coef -= step
            if np.abs(step).max() < 1e-5:
                break
        self.slope = coef[:-1] / scale[:, None]
        self.level = coef[-1] - (mean / scale) @ coef[:-1]

    def posterior(self, featured: DataFrame) -> DataFrame:
        """``featured`` with ``posterior`` in the order of the domains, without its features."""
        given = self.inputs(featured)
        kept = [F.col(f"`{c}`") for c in given.columns if c != "_mix_x"]

        def score(k: int) -> Column:
            parts = [F.get("_mix_x", F.lit(j)) * float(w) for j, w in enumerate(self.slope[:, k])]
            return reduce(lambda a, b: a + b, parts) + float(self.level[k])

        scored = given.select(
            *kept, F.array(*(score(k) for k in range(len(self.domains)))).alias("_mix_score")
        )
        top = scored.select(*kept, "_mix_score", F.array_max("_mix_score").alias("_mix_top"))
        parts = [F.exp(F.get("_mix_score", F.lit(k)) - F.col("_mix_top")) for k in range(len(self.domains))]
        whole = reduce(lambda a, b: a + b, parts)
        return top.select(*kept, F.array(*(F.round(x / whole, 6) for x in parts)).alias("posterior"))


def learn(
    docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str, text: str
) -> Classifier:
    """Fit the classifier on documents whose id and ``domain`` are in ``labelled``.

    One half of the sample shows which cells tell domains apart, the other fits the regression.
    """
    known = labelled.where(F.col("domain").isin(*domains))
    joined = labelled_texts(docs, known, MOST_LABELLED, doc_id, text, "domain").select(
        F.col("doc_id").alias("_mix_id"),
        F.col("domain").alias("_mix_domain"),
        F.col("text").alias("_mix_text"),
    )
    place = {name: k for k, name in enumerate(domains)}
    with Scratch(docs.sparkSession, "mixing") as scratch:
        chosen = [F.col("_mix_id"), F.col("_mix_domain")]
        rows = scratch.settle(features(joined, "_mix_text", chosen), "labelled")
        first = F.pmod(F.xxhash64("_mix_id", F.lit("half")), F.lit(2)) == 0
        counted = rows.where(first)
        counts = np.zeros((CELLS, len(domains)))
        sizes = np.zeros(len(domains))
        for row in counted.groupBy("_mix_domain").count().collect():
            sizes[place[row["_mix_domain"]]] = row["count"]
        cells = counted.select("_mix_domain", F.explode(F.array_distinct("_mix_cells")).alias("cell"))
        for row in cells.groupBy("cell", "_mix_domain").count().toLocalIterator():
            counts[row["cell"], place[row["_mix_domain"]]] = row["count"]
        whole, every = sizes.sum(), counts.sum(1, keepdims=True)
        gap = np.log((counts + 0.5) / (sizes + 1.0)) - np.log(
            (every - counts + 0.5) / (whole - sizes + 1.0)
        )
        share = (every + 0.5) / (whole + 1.0)
        error = np.sqrt(share * (1 - share) * (1 / (sizes + 1.0) + 1 / (whole - sizes + 1.0)))
        apart = np.abs((counts + 0.5) / (sizes + 1.0) - (every - counts + 0.5) / (whole - sizes + 1.0))
        model = Classifier(domains, np.where(apart > LEAST_SHOWN * error, gap, 0.0))
        seen = model.inputs(rows.where(~first)).select("_mix_domain", "_mix_x").collect()
        x = np.array([r["_mix_x"] for r in seen], float).reshape(len(seen), len(model.slope))
        model.fit(x, np.array([place[r["_mix_domain"]] for r in seen], int))
    return model


@dataclass(frozen=True)
class Fit:
    """How the fit of the rates ended; tokens per domain, in the order of the targets."""

    domains: list[str]
    #: At a rate of 1 for all, by the targets, and by the rates.
    has: list[float]
    wanted: list[float]
    reached: list[float]
    slack: list[float]
    steps: int
    converged: bool


def fit_rates(
    members: DataFrame, targets: list[float], budget: float | None, headroom: float
) -> tuple[DataFrame, list[float], list[float]]:
    """``members`` with ``rate``; totals reached and targets, in tokens."""
    names = [str(k) for k in range(len(targets))]
    rated, fit = rates_and_fit(members, dict(zip(names, targets)), budget, headroom)
    return rated, fit.reached, fit.wanted


def rates_and_fit(
    members: DataFrame, targets: dict[str, float], budget: float | None, headroom: float
) -> tuple[DataFrame, Fit]:
    """``members`` (``n_tokens, posterior``) with ``rate``, and how the fit ended.

    Without a budget, the domain with the largest target weight gets ``headroom`` times
    the tokens it has, and the others follow by weight.
    """
    k = len(targets)
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    n = F.col("n_tokens")

    def totals(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        """Tokens per domain, and ``G`` of the documents with a rate above zero."""
        here = n * (rate > 0).cast("int")
        row = members.agg(
            *(F.sum(n * rate * p[i]).alias(f"a{i}") for i in range(k)),
            *(F.sum(here * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)),
        ).first()
        gram = [[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]
        return np.array([row[f"a{i}"] or 0.0 for i in range(k)]), np.array(gram)

    def rate_at(shift: np.ndarray) -> Column:
        moved = reduce(lambda a, b: a + b, (p[i] * float(shift[i]) for i in range(k)))
        return F.greatest(F.lit(1.0) - moved, F.lit(0.0))

    reached, gram = totals(F.lit(1.0))
    has = reached.tolist()
    share = np.array(list(targets.values()), float) / sum(targets.values())
    lead = int(share.argmax())
    goal = share * (budget if budget is not None else headroom * reached[lead] / share[lead])
    slack = slack_of(reached, np.diag(gram), goal)
    shift = last = np.zeros(k)
    least = np.inf
    steps = 0
    while True:
        miss = reached - goal - slack * shift
        size = float(np.abs(miss).max())
        converged = size <= CLOSE * max(float(goal.sum()), 1.0)
        if converged or steps == STEPS:
            break
        steps += 1
        if size > least:  # went too far: halve the step
            shift = (shift + last) / 2
        else:
            least, last = size, shift
            shift = shift + np.linalg.solve(gram + np.diag(slack), miss)
        reached, gram = totals(rate_at(shift))
    fit = Fit(list(targets), has, goal.tolist(), reached.tolist(), slack.tolist(), steps, converged)
    if not converged:
        warnings.warn(f"the rates have not converged: {fit}", RuntimeWarning, stacklevel=2)
    return members.withColumn("rate", F.round(rate_at(shift), 6)), fit


def slack_of(has: np.ndarray, squares: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """``R``: per domain, by how much of the variance of membership the probabilities explain."""
    tokens = max(has.sum(), 1e-9)
    mean = has / tokens
    told = (squares / tokens - mean**2) / np.maximum(mean * (1 - mean), 1e-12)
    told = np.clip(told, 1e-4, 1.0)
    return SLACK * goal * (1 - told) / told + 1e-9 * (goal + 1.0)


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    budget: float | None = None,
    headroom: float = 1.1,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``n_tokens, posterior, rate, copies``; see ``mix_and_fit``."""
    return mix_and_fit(docs, labelled, targets, doc_id, text, budget, headroom, keep_text)[0]


def mix_and_fit(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    doc_id: str = "doc_id",
    text: str = "text",
    budget: float | None = None,
    headroom: float = 1.1,
    keep_text: bool = True,
) -> tuple[DataFrame, Fit]:
    """``docs`` with ``n_tokens, posterior, rate, copies``, and how the fit of the rates ended.

    ``labelled`` has ``doc_id, domain``; ``targets`` a weight per domain. ``posterior`` follows the
    order of ``targets``. ``copies`` is the rate as a whole number: rounded down, and one
    more where a hash of id and text falls below the rest.
    """
    domains = list(targets)
    model = learn(docs, labelled, domains, doc_id, text)
    chosen = others(docs, [*_MADE, *([] if keep_text else [text])])
    draw = F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit("copies"))
    with Scratch(docs.sparkSession, "mixing") as scratch:
        featured = features(docs, text, [*chosen, draw.alias("_mix_draw")])
        members = scratch.settle(model.posterior(featured), "members")
        rated, fit = rates_and_fit(members, targets, budget, headroom)
        part = F.pmod(F.col("_mix_draw"), F.lit(1_000_000)) / 1e6
        copies = F.floor(F.col("rate")) + (part < F.col("rate") - F.floor("rate")).cast("long")
        mixed = settle(rated.withColumn("copies", copies.cast("long")).drop("_mix_draw"), "mixed")
    return mixed, fit
