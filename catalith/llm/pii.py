"""Personal data in texts: patterns propose, checksums confirm, context scores.

Built-in functions only. A text is split once per kind around the matches of its
pattern; the lengths of the pieces and matches give the positions. The patterns take
possessive quantifiers and look behind, which leaves their matches as they are but
keeps the search linear on very long texts.

Positions count code points; ends are exclusive. Every finding has a score: the
kind's own, raised when a word that fits the kind stands shortly before it. ``email``,
``ip``, ``card`` and ``phone`` are always kept. The kinds that are easily mistaken,
``iban`` and ``ssn``, need a checksum (mod 97) or a fitting word to reach
``LEAST_SCORE``.

Defined cases: a null text has no findings, like an empty one. Repeated rows are each
searched. An empty table gives an empty result. An input column named ``findings``
is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import others

LEAST_SCORE = 0.6
#: So many characters before a finding are its context.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    #: Java pattern.
    pattern: str
    #: A text without this character has no match.
    needs: str
    score: float
    #: Words (a pattern, any case) that raise the score by 0.3.
    context: str
    base: bool = True
    #: No such character may stand right before or after a match.
    apart: str = ""


_LOCAL = "[A-Za-z0-9._%+-]"

#: In the order in which findings at one place are listed.
KINDS = (
    Kind(
        "email",
        rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        0.7,
        "mail|contact|write|kontakt|contacto|correo|courriel",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        ".",
        0.6,
        "ip|host|server|address|adresse|dirección",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "",
        0.7,
        "card|visa|mastercard|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        0.6,
        "phone|call|tel|mobile|fax|telefon|teléfono|téléphone",
    ),
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        "",
        0.7,
        "iban|account|bank|konto|compte|cuenta",
        base=False,
        apart="[A-Za-z0-9]",
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        "-",
        0.4,
        "ssn|social security|tax id",
        base=False,
        apart="[0-9-]",
    ),
)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    doubled = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (without blanks) leaves 1 when divided by 97."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    values = F.transform(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55),
    )
    rest = F.aggregate(
        values,
        F.lit(0),
        lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97,
    )
    return rest == 1


def _confirmed(kind: str, found: Column) -> Column:
    if kind == "ip":
        byte = "^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)$"
        return F.forall(F.split(found, r"\."), lambda part: part.rlike(byte))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(found)).between(10, 15)
    if kind == "iban":
        bare = F.replace(found, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(F.lit(False))
    return F.lit(True)


def _added(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + n)


def _findings(kind: Kind, order: int) -> Column:
    """Findings of a kind from its stored matches, the pieces before them and their offsets."""
    pieces, matches, offsets = (F.col(f"_pii_{part}{order}") for part in "pmo")

    def build(pair: Column, offset: Column) -> Column:
        # At the start of a text nothing stands before; else, an empty piece means the last match.
        open_before = F.when(pair["piece"] == "", offset == 0).otherwise(
            ~F.right(pair["piece"], F.lit(1)).rlike(kind.apart)
        )
        alone = open_before & ~F.left(pair["after"], F.lit(1)).rlike(kind.apart)
        start = offset + F.char_length(pair["piece"])
        before = F.lower(F.right(pair["piece"], F.lit(CONTEXT)))
        score = F.lit(kind.score) + F.when(before.rlike(kind.context), 0.3).otherwise(0.0)
        return F.struct(
            start.alias("start"),
            F.lit(order).alias("order"),
            (start + F.char_length(pair["found"])).alias("end"),
            F.lit(kind.name).alias("kind"),
            pair["found"].alias("found"),
            F.round(score, 2).alias("score"),
            (alone if kind.apart else F.lit(True)).alias("alone"),
        )

    around = F.zip_with(
        pieces,
        F.slice(pieces, F.lit(2), F.size(matches)),
        lambda p, a: F.struct(p.alias("piece"), a.alias("after")),
    )
    pairs = F.zip_with(
        around,
        matches,
        lambda p, m: F.struct(p["piece"].alias("piece"), p["after"].alias("after"), m.alias("found")),
    )
    made = F.zip_with(F.slice(pairs, F.lit(1), F.size(matches)), offsets, build)
    passes = F.filter(
        made,
        lambda x: x["alone"]
        & _confirmed(kind.name, x["found"])
        & (F.lit(kind.base) | (x["score"] >= LEAST_SCORE)),
    )
    return F.when(F.size(matches) > 0, passes).otherwise(F.filter(made, lambda x: F.lit(False)))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, and ``findings``.

    Findings are ordered by start, then by the order of ``KINDS``. Offsets are running
    sums; they are built in chunks of 256 matches, so that a text with very many
    matches does not cost their square.
    """
    kept = others(docs, [text, "findings"])
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    numbers = range(len(KINDS))

    def names(*parts: str) -> list[str]:
        return [f"_pii_{part}{k}" for part in parts for k in numbers]

    none = F.array().cast("array<string>")
    step = docs.select(
        *kept,
        raw.alias("_pii_text"),
        *(
            F.when(
                F.contains(raw, F.lit(kind.needs)),
                F.regexp_extract_all(raw, F.lit(kind.pattern), F.lit(0)),
            )
            .otherwise(none)
            .alias(f"_pii_m{k}")
            for k, kind in enumerate(KINDS)
        ),
    )
    step = step.select(
        *kept,
        *names("m"),
        *(
            F.when(F.size(f"_pii_m{k}") > 0, F.split("_pii_text", kind.pattern))
            .otherwise(none)
            .alias(f"_pii_p{k}")
            for k, kind in enumerate(KINDS)
        ),
    )

    def chunks(k: int) -> Column:
        lengths = F.zip_with(
            f"_pii_p{k}",
            f"_pii_m{k}",
            lambda p, m: F.char_length(p) + F.coalesce(F.char_length(m), F.lit(0)),
        )
        return lengths.alias(f"_pii_l{k}")

    step = step.select(*kept, *names("m", "p"), *(chunks(k) for k in numbers))

    def cut(k: int) -> Column:
        whole = F.col(f"_pii_l{k}")
        count = F.floor(F.size(whole) / 256).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count), lambda c: F.slice(whole, c * 256 + 1, F.lit(256))
        ).alias(f"_pii_c{k}")

    step = step.select(*kept, *names("m", "p"), *(cut(k) for k in numbers))
    step = step.select(
        *kept,
        *names("m", "p", "c"),
        *(F.transform(f"_pii_c{k}", _added).alias(f"_pii_s{k}") for k in numbers),
    )

    def offsets(k: int) -> Column:
        bases = F.transform(
            f"_pii_s{k}", lambda s, c: _added(F.slice(f"_pii_s{k}", F.lit(1), c))
        )
        each = F.zip_with(
            f"_pii_c{k}",
            bases,
            lambda chunk, base: F.transform(
                chunk, lambda n, i: base + _added(F.slice(chunk, F.lit(1), i))
            ),
        )
        return F.slice(F.flatten(each), F.lit(1), F.size(f"_pii_m{k}")).alias(f"_pii_o{k}")

    step = step.select(*kept, *names("m", "p"), *(offsets(k) for k in numbers))
    every = F.array_sort(F.concat(*(_findings(kind, k) for k, kind in enumerate(KINDS))))
    return step.select(
        *kept,
        F.transform(
            every,
            lambda x: F.struct(
                x["start"], x["end"], x["kind"], x["found"], x["score"]
            ),
        ).alias("findings"),
    )


def spans(findings: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the findings, of all or the given kinds, joined by commas."""
    chosen = findings
    if kinds is not None:
        chosen = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    return F.array_join(
        F.transform(
            chosen,
            lambda x: F.concat_ws(
                ":", x["kind"], x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )
