"""Personal data in texts, with DataFrame functions only.

Patterns propose spans, checks on their digits confirm or drop them (Luhn for cards, modulo 97 for account
numbers, ranges and lengths for the rest), and words near a span raise its score. Four kinds, the
base, are kept whenever they pass their check: email, ip, card, phone. The others (iban, ssn, key)
are weaker proposals and need a score of `THRESHOLD`, which a bare pattern doesn't have.

Spark has no function for the positions of all matches. They come from the text between the matches:
splitting by a pattern and extracting by it see the same matches, so lengths of both add up to the
positions. The context of a span is the end of the text before it and the beginning of the text after it, which
keeps the work linear in the text. The patterns equal the plain ones of the table below; a run of characters is entered
only where it begins or where the last match ended, and is never given back, which saves the
square of the length of long runs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, quoted

THRESHOLD = 0.5
NEAR_BEFORE = 40
NEAR_AFTER = 20
STEP = 256


class Kind(NamedTuple):
    name: str
    pattern: str
    hint: str  # a text without it has no match; cheap to look for
    check: Callable[[Column], Column]
    score: float
    near: str  # words that raise the score
    near_score: float = 0.3
    base: bool = False


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digits(v: Column) -> Column:
    return F.translate(v, "+ ().-", "")


def luhn(number: Column) -> Column:
    """Whether the digits end in their Luhn check digit."""

    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return acc + F.when((F.length(d) - i) % 2 == 1, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)

    return let(number, lambda d: total(d) % 10 == 0)


def mod97(account: Column) -> Column:
    """Whether an account number (country, check digits, the rest) leaves 1 modulo 97."""

    def rest(a: Column) -> Column:
        moved = F.concat(F.substring(a, F.lit(5), F.lit(40)), F.substring(a, F.lit(1), F.lit(4)))

        def add(acc: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code >= 65, acc * 100 + code - 55).otherwise(acc * 10 + code - 48) % 97

        return F.aggregate(F.split(moved, "(?!^)(?=.)"), F.lit(0), add)

    return let(F.translate(account, " ", ""), lambda a: rest(a) == 1)


def _ip(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: p.cast("double") <= 255)


def _ssn(v: Column) -> Column:
    return ~v.rlike("^(000|666|9)") & ~v.rlike("-00-") & ~v.rlike("0000$")


def _length(v: Column, lo: int, hi: int) -> Column:
    return F.length(digits(v)).between(lo, hi)


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        lambda v: F.lit(True),
        0.9,
        "mail|contact|write|correo|courriel",
        0.1,
        True,
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts up to 255
    Kind(
        "ip",
        r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        ".",
        _ip,
        0.7,
        "ip|host|server|address|serveur|adresse",
        0.3,
        True,
    ),
    # [0-9]([\x20-]?[0-9])+, 14 to 19 digits
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        "",
        lambda v: F.when(_length(v, 14, 19), luhn(digits(v))).otherwise(F.lit(False)),
        0.8,
        "card|visa|credit|karte|carte|tarjeta",
        0.2,
        True,
    ),
    # \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "+",
        lambda v: _length(v, 10, 15),
        0.8,
        "phone|call|tel|mobile|fax|telefon|appel",
        0.2,
        True,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "",
        mod97,
        0.9,
        "iban|account|konto|compte|cuenta",
        0.1,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "-",
        _ssn,
        0.3,
        "ssn|social security|tax id",
    ),
    Kind(
        "key",
        r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
        "",
        lambda v: v.rlike("[a-f]") & v.rlike("[0-9]"),
        0.3,
        "key|token|secret|password|auth",
    ),
]


def _running(steps: Column) -> Column:
    """Sums of an array from its beginning to each element, by way of the sums of blocks."""

    def blocks(s: Column) -> Column:
        count = F.floor((F.size(s) - 1) / STEP).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count),
            lambda b: _total(F.slice(s, b * STEP + 1, F.lit(STEP))),
        )

    def element(s: Column, sums: Column, i: Column) -> Column:
        block = F.floor(i / STEP).cast("int")
        inside = F.slice(s, block * STEP + 1, i - block * STEP + 1)
        return _total(F.slice(sums, F.lit(1), block)) + _total(inside)

    return let(
        steps, lambda s: let(blocks(s), lambda sums: F.transform(s, lambda _, i: element(s, sums, i)))
    )


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda acc, x: acc + x)


_EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _found(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind."""
    pattern, rank = F.lit(kind.pattern), KINDS.index(kind)

    def spans(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(matches, lambda m, i: F.length(m) + F.length(gaps[i]))
            return let(_running(steps), lambda ends: F.transform(matches, lambda m, i: span(gaps, ends, m, i)))

        def span(gaps: Column, ends: Column, m: Column, i: Column) -> Column:
            around = F.concat(F.right(gaps[i], F.lit(NEAR_BEFORE)), F.lit(" "), F.left(gaps[i + 1], F.lit(NEAR_AFTER)))
            near = F.lower(around).rlike(rf"(?<![a-z])(?:{kind.near})")
            score = F.lit(kind.score) + F.when(near, kind.near_score).otherwise(0.0)
            return F.struct(
                (ends[i] - F.length(m)).alias("start"),
                F.lit(rank).alias("rank"),
                ends[i].alias("end"),
                F.lit(kind.name).alias("kind"),
                F.when(kind.check(m), score).otherwise(-1.0).alias("score"),
            )

        least = 0.0 if kind.base else THRESHOLD
        some = let(F.split(text, pattern, -1), placed)
        kept = F.filter(some, lambda s: s["score"] >= least)
        return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(_EMPTY))

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)
    if kind.hint:
        found = F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(F.array().cast(_EMPTY))
    return found


def spans(text: Column) -> Column:
    """Spans (start, rank, end, kind, score) of a text, by start, then kind. Code points, end exclusive."""
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.sort_array(F.concat(*[_found(t, k).cast(_EMPTY) for k in KINDS])),
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans. NULL and empty texts have none; repeated rows each get a row."""
    return docs.select(
        F.col(quoted(id_col)).alias("doc_id"), spans(F.col(quoted(text_col))).alias("spans")
    )


def listed(found: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def base_only(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"].isin([k.name for k in KINDS if k.base]))


def masked(text: Column, found: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of the first, as in `<EMAIL>`."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        grown = F.concat(acc["parts"], F.array(gap, mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], grown).otherwise(acc["parts"]).alias("parts"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, start, add, finish)).otherwise(text)


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All columns of `docs` with personal data masked. NULL texts stay NULL.

    `length_col`, where `docs` has it, becomes the length of the new text.
    """
    name = fresh(docs, "found")
    text = F.col(quoted(text_col))
    # Referred to more than once below, so that Spark keeps it in a projection of its own.
    seen = docs.withColumn(name, spans(text))
    clean = F.when(F.size(F.col(name)) > 0, masked(text, F.col(name))).otherwise(text)
    out = seen.withColumn(text_col, clean).drop(name)
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(
            length_col,
            F.when(text.isNull(), F.col(quoted(length_col))).otherwise(F.length(text).cast(kind)),
        )
    return out.select(*[F.col(quoted(c)) for c in docs.columns])


def _count(found: Column, kind: Kind) -> Column:
    own = F.filter(found, lambda s: s["kind"] == kind.name)
    return F.size(own).cast("long").alias(f"n_{kind.name}")


def counts(found: Column) -> list[Column]:
    """n_email, n_ip, ...: base spans by kind."""
    return [_count(found, k) for k in KINDS if k.base]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans as text."""
    s = F.col("spans")
    return found.select(
        "doc_id",
        *counts(s),
        F.sha2(listed(base_only(s)).cast("binary"), 256).alias("base_sha256"),
        listed(s).alias("spans"),
    )
