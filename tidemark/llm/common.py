"""Helpers of the text operators: learning splits, names, Arrow batches, word hashes.

Texts reach Python as Arrow batches whose bytes are used in place. `pieces` cuts a batch into runs
of whole documents, so that the arrays made from it stay small however many rows a batch has, and
`words` works through the bytes of a run block by block, so that one very long document needs
little more than its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
PIECE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240101)
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
# Words of letters, digits and everything beyond ASCII; upper case is lowered first.
NO_ALNUM = np.zeros(256, bool)
NO_ALNUM[:0x80] = True
NO_ALNUM[0x30:0x3A] = NO_ALNUM[0x41:0x5B] = NO_ALNUM[0x61:0x7B] = False


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, each exactly once, whatever else `docs` carries."""
    return docs.select(*[F.col(quoted(c)) for c in columns])


def numbered(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ..., for functions over Arrow batches: those refuse names with dots."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without copying, and where each row begins. NULL is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind.itemsize)
    at = at.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def pieces(
    column: pa.Array, most: int = PIECE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (lo, hi, bytes, begins) with about `most` bytes, or a single longer row."""
    body, at = text_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


MARK_WORDS = 1 << 18  # 64 marks each


def _may_be_in(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """A small table of marks of the ids, and the condition for a row whose key may be one of them.

    The marks are bits that a hash of an id picks; at most `MARK_WORDS` words of them are broadcast, however many
    ids there are.
    """

    def place(of: Column) -> tuple[Column, Column]:
        h = F.xxhash64(of)
        within = F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")
        return F.pmod(h, F.lit(MARK_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), within)

    word, bit = place(ids["id"])
    marks = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = place(rows[quoted(key)])
    return F.broadcast(marks), (word == marks["_word"]) & (marks["_bits"].bitwiseAND(bit) != 0)


def rows_with_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Inner join of `rows` and `ids` on their common column `id`, without moving most other rows.

    Only rows whose mark is that of an id go into the exact, shuffled join.
    """
    maybe = rows.join(*_may_be_in(rows, ids, "id"), "left_semi")
    return maybe.join(ids.hint("merge"), "id")


def rows_by_ids(rows: DataFrame, ids: DataFrame, key: str, has: bool) -> DataFrame:
    """The rows whose `key`, never NULL, is one of `ids` (column `id`), or is none of them.

    Only rows whose mark is that of an id are moved. So the fewer of those to keep and those to drop should be named.
    """
    marks = _may_be_in(rows, ids, key)
    maybe, known = rows.join(*marks, "left_semi"), ids.select(F.col("id").alias(fresh(rows, "id")))
    same = maybe[quoted(key)] == known[known.columns[0]]
    if has:
        return maybe.join(known.hint("merge"), same, "left_semi")
    return rows.join(*marks, "left_anti").union(maybe.join(known.hint("merge"), same, "left_anti"))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            table = np.full(n, base, U64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=U64)
    return _powers[0], _powers[1]


def words(
    body: np.ndarray,
    begins: np.ndarray,
    stops: np.ndarray = WHITE,
    prefixes: tuple[int, ...] = (),
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of documents, A-Z lowered: 64-bit hashes, starts, ends, first word by row.

    With `prefixes`, the hashes are a table: the word's own, and those of its first 4, 5, ... bytes, or 0
    where the word has no more than that.

    A word's hash is a polynomial in its bytes, taken from prefix sums: (S[end] - S[start]) / B^start
    modulo 2^64. `stops` says which bytes separate words.
    """
    n = len(body)
    cuts = [0]
    while n - cuts[-1] > PIECE_BYTES:
        # Cut where a separator stands; a longer word makes a longer block.
        lo = cuts[-1]
        back = np.flatnonzero(stops[body[lo + 1 : lo + PIECE_BYTES]])
        if len(back):
            cuts.append(lo + 1 + int(back[-1]))
            continue
        ahead = lo + PIECE_BYTES
        while ahead < n and not stops[body[ahead]]:
            ahead += 1
        if ahead >= n:
            break
        cuts.append(ahead)
    cuts.append(n)
    hashes, starts, ends = [], [], []
    for lo, hi in zip(cuts, cuts[1:]):
        block = body[lo:hi]
        inside = ~stops[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = begins[(begins > lo) & (begins < hi)] - lo
        first[edges] = inside[edges]
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        end = np.flatnonzero(last) + 1
        up, down = _power_tables(len(block))
        sums = np.zeros(len(block) + 1, U64)
        np.cumsum(BYTE_CODE[LOWER[block]] * up[: len(block)], dtype=U64, out=sums[1:])
        own = [mix((sums[end] - sums[start]) * down[start])]
        for n_bytes in prefixes:
            cut = np.minimum(start + n_bytes, len(block))
            part = mix((sums[cut] - sums[start]) * down[start] + U64(n_bytes))
            own.append(np.where(end - start > n_bytes, part, U64(0)))
        hashes.append(np.stack(own, axis=1) if prefixes else own[0])
        starts.append(start + lo)
        ends.append(end + lo)
    start = np.concatenate(starts)
    return (
        np.concatenate(hashes),
        start,
        np.concatenate(ends),
        np.searchsorted(start, begins, "left"),
    )


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; fewer than k words give none."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - k + 1, U64)
    for j in range(k):
        out = out * U64(_BASE) + h[j : len(h) - k + 1 + j]
    return mix(out + U64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of `counts` consecutive values."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
