"""Personal data by patterns, checksums and context words, in DataFrame functions only.

Every kind has a pattern that proposes spans, a validator that confirms them, and words which,
close before the span, raise its score. The patterns are written so that a scan is linear: runs
are possessive, and a match can only begin at the start of a run or where the last one ended.
Positions are code points: running sums of the lengths of matches and of the texts between them,
by doubling steps. The context of a span is read from the pieces before it, so that the work grows
with the text and with n log n of its n matches.

Base kinds (email, ip, card, phone) are reported whenever their validator agrees. The other kinds
(iban with its mod-97 check, national_id) are reported from ``min_score`` on.

Defined results: a null or empty text has no span; repeated rows are searched each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PiiParams:
    min_score: float = 0.6
    context_chars: int = 40  # before a span
    context_gain: float = 0.35


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: Callable[[Column], Column]  # a cheap necessary condition on the text
    valid: Callable[[Column], Column]
    score: float  # of a valid span without context
    words: str  # pattern of context words, lower case


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def luhn(digits: Column) -> Column:
    """True for digit strings whose Luhn sum is a multiple of ten."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(figures, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """True for account codes whose rearranged number leaves 1 modulo 97."""
    bare = F.regexp_replace(code, " ", "")
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    value = lambda c: F.conv(c, 36, 10).cast("int")  # noqa: E731  0-9 stay, A is 10 to Z is 35
    return F.aggregate(turned, F.lit(0), lambda a, c: (F.when(value(c) < 10, a * 10).otherwise(a * 100) + value(c)) % 97) == 1


def _ip(match: Column) -> Column:
    part = F.split(match, "\\.")
    # leading zeros do not count; what is then longer than three digits is above 255
    ok = [F.length(F.ltrim(part[k], F.lit("0"))) <= 3 for k in range(4)] + [F.concat(F.lit("0"), F.substring(F.ltrim(part[k], F.lit("0")), 1, 3)).cast("int") <= 255 for k in range(4)]
    return reduce(lambda a, b: a & b, ok)


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "e-?mail|contact|write|kontakt|correo"),
    Kind("ip", "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++", lambda t: F.contains(t, F.lit(".")), _ip, 0.6, "\\bip\\b|address|server|host|adresse"),
    Kind("card", "[0-9](?:[ -]?+[0-9]){13,}+", lambda t: F.lit(True), lambda m: _between(F.length(_digits(m)), 14, 19) & luhn(_digits(m)), 0.8, "card|credit|visa|karte|tarjeta|carte"),
    Kind("phone", "\\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: _between(F.length(_digits(m)), 10, 15), 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", "\\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\\b", lambda t: F.lit(True), mod97, 0.9, "iban|account|konto|cuenta|compte"),
    Kind("national_id", "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", lambda t: F.contains(t, F.lit("-")), lambda m: ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9") & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000"), 0.3, "ssn|social security|national id|tax id"),
)
BASE = ("email", "ip", "card", "phone")
_EMPTY = "array<struct<start:int,kind:int,end:int,score:double>>"
_STEPS = 30  # doubling steps: enough for 2^30 matches
_PIECES = 10  # matches before a span that its context may reach over; the shortest has five characters


def _running(lengths: Column) -> Column:
    """Running sums of an array of numbers: step k adds what stands 2^k places before."""
    steps = F.array(*[F.lit(1 << k) for k in range(_STEPS)])
    add = lambda acc, d: F.transform(acc, lambda x, i: x + F.coalesce(F.when(i >= d, F.get(acc, (i - d).cast("int"))), F.lit(0)))
    return F.aggregate(steps, lengths, lambda acc, d: F.when(F.size(acc) > d, add(acc, d)).otherwise(acc))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, not once for each element that looks at it."""
    return F.get(F.transform(F.array(value), use), 0)


def _spans(k: int, kind: Kind, matches: Column, gaps: Column, params: PiiParams) -> Column:
    """Valid spans of one kind, in order; ``gaps`` are the texts before, between and after the matches."""
    n = params.context_chars

    def context(pieces: Column) -> Column:
        """The ``n`` characters before each match; a piece is the end of a gap, and the match after it."""

        def before(piece: Column, i: Column) -> Column:
            earlier = [F.get(pieces, i - k)[part] for k in range(_PIECES, 0, -1) for part in ("g", "m")]
            return F.lower(F.substring(F.concat_ws("", *earlier, piece["g"]), -n, n))

        return F.transform(pieces, before)

    def span(row: Column) -> Column:
        match, end = row["m"], row["e"]
        score = F.lit(kind.score) + F.when(row["before"].rlike(kind.words), params.context_gain).otherwise(0.0)
        keep = kind.valid(match) if kind.name in BASE else kind.valid(match) & (score >= params.min_score)
        return F.when(keep, F.struct((end - F.length(match)).cast("int").alias("start"), F.lit(k).alias("kind"), end.cast("int").alias("end"), F.least(score, F.lit(1.0)).alias("score")))

    heads = F.slice(gaps, 1, F.size(matches))
    ends = _running(F.zip_with(heads, matches, lambda g, m: F.length(g) + F.length(m)))
    pieces = F.zip_with(heads, matches, lambda g, m: F.struct(F.substring(g, -n, n).alias("g"), m.alias("m")))
    rows = F.arrays_zip(matches.alias("m"), ends.alias("e"), _bound(pieces, context).alias("before"))
    found = F.filter(F.transform(rows, lambda r: span(r)), lambda s: s.isNotNull())
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(_EMPTY))


def find_pii(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with ``pii``: spans (start, kind, end, score) by start and kind.

    ``kind`` is the place in ``KINDS``; ``start`` and ``end`` count code points, the end exclusive.
    """
    names = [(f"__m{k}", f"__g{k}") for k in range(len(KINDS))]
    text = F.coalesce(F.col("text"), F.lit(""))
    # the first step finds matches; texts are split only where there are some
    found = docs.withColumns({m: F.when(kind.gate(text), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")) for kind, (m, _) in zip(KINDS, names, strict=True)})
    split = found.withColumns({g: F.when(F.size(m) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>")) for kind, (m, g) in zip(KINDS, names, strict=True)})
    parts = [_spans(k, kind, F.col(m), F.col(g), params) for k, (kind, (m, g)) in enumerate(zip(KINDS, names, strict=True))]
    return split.withColumn("pii", F.array_sort(F.concat(*parts))).drop(*[c for pair in names for c in pair])


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind))


def digest(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and all spans as text."""
    out = find_pii(docs, params)
    base = F.filter("pii", lambda s: s["kind"] < len(BASE))
    counts = [_count(k).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))


def mask(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; overlaps go to the first."""
    out = find_pii(docs, params)
    name = F.array(*[F.lit(f"<{k.name}>") for k in KINDS])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(name, s["kind"])).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    hidden = F.aggregate("pii", first, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text") - a["at"])))
    return out.withColumn("text", F.when(F.size("pii") > 0, hidden).otherwise(F.col("text"))).drop("pii")
