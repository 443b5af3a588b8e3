"""Odd documents, and plain versions of what the operators compute."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 4) % 50))
    return " ".join(out)


#: NULL and empty texts, white space only, no letters, one long text, repeated rows, ids shared and missing.
ODD = [
    (1, sentence(1, 40), "en"),
    (2, None, "en"),
    (3, "", "de"),
    (4, " \t\n ", None),
    (5, "1234 !!", "en"),
    (6, sentence(6, 30_000), "fr"),
    (7, sentence(1, 40), "en"),
    (7, sentence(1, 40), "en"),
    (8, sentence(8, 25), "en"),
    (8, sentence(9, 25), "de"),
    (None, sentence(1, 40), "en"),
    (None, None, None),
    (11, "Ünïcode straße 漢字 🙂 é", "de"),
    (12, "one two", "en"),
    (13, "One  TWO", "en"),
]

#: Extra columns whose names operators use for their own.
EXTRA = (
    "id string, score string, kept string, found string, ids string, row string, label string, "
    "kept_id string, copy_no string, bad_id string, `a.b` string, decoded string, spans string"
)


def documents(spark: SparkSession, rows: list[tuple] | None = None, extra: bool = True) -> DataFrame:
    base = "doc_id long, text string, lang string, source string, n_chars long"
    rows = ODD if rows is None else rows
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows]
    if not extra:
        return spark.createDataFrame(full, base)
    return spark.createDataFrame([r + ("x",) * 13 for r in full], f"{base}, {EXTRA}")


def labels(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def white_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def shingles(text: str | None, size: int) -> set:
    w = white_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def groups(rows: list[tuple], size: int, percent: int = 80) -> dict:
    """Component by document id, all pairs compared."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            same = len(a & b)
            if same and 100 * same >= percent * (len(a) + len(b) - same):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in parent}


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(number)):
        x = int(c) * (1 + place % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def private_spans(text: str | None) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(PRIVATE.items()):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m.group())
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m.group().split("."))
            elif kind == "card":
                ok = 14 <= len(number) <= 19 and luhn(number)
            else:
                ok = kind == "email" or 10 <= len(number) <= 15
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def letter_words(text: str | None) -> list[str]:
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hit_words(text: str | None, items: list[tuple]) -> tuple[int, int, list[str]]:
    """Words, hit words, ids of items with a window in the text."""
    w, hit, found = letter_words(text), set(), set()
    for item, body in items:
        v = letter_words(body)
        k = min(len(v), 13)
        wins = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None)
