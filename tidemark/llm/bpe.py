"""Byte-level BPE: exact ids of a rank file in time linear in the text, and back.

A text is cut into pieces by the pattern of the rank files, from the classes of its code points. A
piece is encoded without merging: its bytes, mapped to Latin-1, run through an Aho-Corasick automaton
of all tokens. From the left the longest token is taken; a token may follow another only if the two, put
together, would be merged into just these two (remembered per pair). Where no token fits, the last
one is taken back and a shorter one tried; ends that led nowhere are not tried twice. A sequence whose
neighbours all fit is the one that the merges make. A piece that is a token itself is that token.

Short pieces that are new in a run of texts are encoded together instead, as rows of arrays: in each round
every row merges its leftmost neighbours of lowest rank.

Encoded pieces are remembered in two halves of up to `MEMO` of them: when the younger one is full, it takes
the place of the older one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import fresh, list_array, narrow, numbered, pieces

MEMO = 100_000
PAIRS = 300_000  # tokens whose fit is remembered
MEMO_CHARS = 64  # longer pieces are not remembered
ROW_BYTES = (8, 16, 32, 64)  # widths of rows; longer pieces are encoded one by one
ROWS = 4096  # pieces that are merged at a time
PIECE_BYTES = 1 << 20

# Classes of code points, and the endings that the pattern splits off.
_OTHER, _SPACE, _LETTER, _NUMBER = 0, 1, 2, 3
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_NONE = np.int32(2**31 - 1)  # the rank of neighbours that don't merge


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids from a rank file: base64 of the token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The ids by merging, pair by pair, the neighbours of lowest rank. Slow; it defines the result."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        best = min(pairs)
        if best == 1 << 60:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def sound_ids(ranks: dict[bytes, int]) -> frozenset[int]:
    """The tokens that merging makes."""
    return frozenset(i for t, i in ranks.items() if merged(ranks, t) == [i])


class Pairs:
    """The ids of all pairs of tokens that merge, looked up for arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.span = 1 + max(ranks.values(), default=0)
        known = ranks.get
        found = {
            a * self.span + b: i
            for t, i in ranks.items()
            for k in range(1, len(t))
            if (a := known(t[:k])) is not None and (b := known(t[k:])) is not None
        }
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        # A last key beyond all pairs is found by those that don't merge.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ids = np.append(np.fromiter(found.values(), np.int32, len(found))[order], _NONE)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that a and b merge into, or `_NONE`; places without a token are negative."""
        key = a.astype(np.int64) * self.span + b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ids[at], _NONE)


class Tokenizer:
    """Encodes and decodes with the tokens of a rank file."""

    def __init__(self, ranks: dict[bytes, int], sound: frozenset[int] | None = None):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # Tokens that merging can't make occur only as whole pieces.
        self.sound = sound if sound is not None else sound_ids(ranks)
        self.texts = {i: str(i) for i in self.tokens}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            if i in self.sound:
                self.automaton.add_word(t.decode("latin-1"), (1 - len(t), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # by both ids in one number
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # Rows begin as single bytes; an id must be a rank that a row can hold.
        single = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.single = np.array(single, np.int32) if min(single) >= 0 and max(ranks.values()) < _NONE else None
        self.pairs = Pairs(ranks) if self.single is not None else None

    def _fit(self, a: int, b: int) -> bool:
        good = merged(self.ranks, self.tokens[a] + self.tokens[b]) == [a, b]
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[a << 32 | b] = good
        return good

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        # Tokens by where they begin, the longest last: (1 - length, token).
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(piece.decode("latin-1")):
            at[end + found[0]].append(found)
        known = self.fits.get
        ids: list[int] = []
        way: list[tuple[int, int]] = []  # where each token begins, how many are untried there
        dead = bytearray(n + 1)
        pos, left, last = 0, len(at[0]), -1
        while True:
            options = at[pos]
            while left:
                left -= 1
                back, token = options[left]
                stop = pos + 1 - back
                if dead[stop]:
                    continue
                if last >= 0:
                    fit = known(last << 32 | token)
                    if fit is None:
                        fit = self._fit(last, token)
                    if not fit:
                        continue
                ids.append(token)
                if stop == n:
                    return tuple(ids)
                way.append((pos, left))
                pos, last, left = stop, token, len(at[stop])
                break
            else:
                dead[pos] = 1
                ids.pop()
                pos, left = way.pop()
                last = ids[-1] if ids else -1

    def _recall(self, text: str) -> tuple[int, ...]:
        """Ids of a piece that was not in the younger half of the memory."""
        known = self.memo.get(text)
        if known is not None:
            return known
        known = self.older.get(text)
        if known is None:
            known = self.encode_piece(text.encode())
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[text] = known
        return known

    def encode_pieces(self, found: list[str]) -> list[int]:
        ids = list(map(self.memo.get, found))
        if None in ids:
            ids = [self._recall(t) if known is None else known for t, known in zip(found, ids)]
        return list(chain.from_iterable(ids))

    def encode(self, text: str) -> list[int]:
        return self.encode_pieces(split(text))

    def encode_all(self, texts: Iterable[str]) -> list[list[int]]:
        """The ids of each text of a run; pieces that are not remembered are encoded together."""
        found = [split(t) for t in texts]
        if self.pairs is not None:
            new = set().union(*found) - self.memo.keys() - self.older.keys()
            short = [t for t in new if len(t) <= MEMO_CHARS]
            for lo in range(0, len(short), ROWS):
                some = short[lo : lo + ROWS]
                if len(self.memo) >= MEMO:
                    self.older, self.memo = self.memo, {}
                self.memo.update(zip(some, self.encode_rows([t.encode() for t in some])))
        return [self.encode_pieces(x) for x in found]

    def encode_rows(self, some: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece. Every byte must be a token."""
        out = [(whole,) if (whole := self.ranks.get(p)) is not None else () for p in some]
        size = np.array([0 if ids else len(p) for p, ids in zip(some, out)])
        low = 0
        for wide in ROW_BYTES:
            rows = np.flatnonzero((size > low) & (size <= wide))
            low = wide
            if len(rows):
                joined = b"".join(some[r].ljust(wide, b"\0") for r in rows)
                codes = np.frombuffer(joined, np.uint8).reshape(-1, wide)
                tokens = np.where(np.arange(wide) < size[rows, None], self.single[codes], np.int32(-1))
                for r, ids in self._merge_rows(rows, tokens):
                    out[r] = tuple(ids)
        for r in np.flatnonzero(size > low):
            out[r] = self.encode_piece(some[r])
        return out

    def _merge_rows(self, row: np.ndarray, tokens: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Row numbers and ids, as rows have no more neighbours that merge."""
        wide = tokens.shape[1]
        rank = np.full(tokens.shape, _NONE)
        rank[:, :-1] = self.pairs.ranks(tokens[:, :-1], tokens[:, 1:])
        place = np.arange(wide)
        while len(row):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(row)), at]
            done = best == _NONE
            if done.any():
                left = (tokens[done] >= 0).sum(axis=1).tolist()
                for r, ids, n in zip(row[done].tolist(), tokens[done].tolist(), left):
                    yield r, ids[:n]
                row, tokens, rank, at, best = (x[~done] for x in (row, tokens, rank, at, best))
                if not len(row):
                    return
            # What stands behind the merged two moves up by one.
            every = np.arange(len(row))
            after = np.minimum(place + (place > at[:, None]), wide - 1)
            tokens, rank = np.take_along_axis(tokens, after, 1), np.take_along_axis(rank, after, 1)
            tokens[:, -1], rank[:, -1] = -1, _NONE
            tokens[every, at] = best
            behind = np.minimum(at + 1, wide - 1)
            rank[every, at] = np.where(at < wide - 1, self.pairs.ranks(best, tokens[every, behind]), _NONE)
            some = np.flatnonzero(at > 0)
            before = at[some] - 1
            rank[some, before] = self.pairs.ranks(tokens[some, before], best[some])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The class of every code point, as the library that is to be matched sees it.

    Versions of Unicode differ in their newest letters, so the library is asked: of all characters, its
    encoding by single bytes keeps those that a pattern matches.
    """
    if not _classes:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([i]): i for i in range(256)}
        table = np.full(0x110000, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
            asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            matched = bytes(asked.encode_ordinary(every)).decode()
            table[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def cut_points(codes: np.ndarray) -> np.ndarray:
    """Where the pieces of a text begin, from its code points.

    A piece is a run of letters, of numbers or of other signs, with one space before it if there is one;
    or white space, whose last character is left to what follows; or an apostrophe with one of
    the fixed endings, if a piece begins there.
    """
    n = len(codes)
    kind = _class_table()[codes]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    white = kind == _SPACE
    begin = new.copy()
    # A run of words takes the space before it.
    runs = np.flatnonzero(new & ~white)
    behind = runs[(runs > 0)]
    behind = behind[white[behind - 1]]
    plain = codes[behind - 1] == 0x20
    begin[behind[plain]] = False
    # The last white space before a run stands alone, or is the space that the run takes.
    begin[behind - 1] = True
    # Endings after an apostrophe: the piece goes on behind them.
    quotes = np.flatnonzero(begin & (codes == 0x27))
    if len(quotes):
        quotes = quotes[quotes + 1 < n]
        quotes = quotes[kind[quotes + 1] == _LETTER]
        for q in quotes:
            tail = "".join(map(chr, codes[q + 1 : q + 3]))
            for ending in _ENDINGS:
                if tail.startswith(ending):
                    begin[q + 1] = False
                    stop = q + 1 + len(ending)
                    if stop < n and kind[stop] == _LETTER:
                        begin[stop] = True
                    break
    return np.flatnonzero(begin)


def split(text: str) -> list[str]:
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = cut_points(codes).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


class Plan:
    """What tasks need to make the tokenizer, and the tokenizer once per Python worker."""

    _made: dict[str, Tokenizer] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        # Without the tables of a tokenizer, which the driver doesn't need.
        self.sound = sound_ids(ranks)

    def tokenizer(self) -> Tokenizer:
        if self.key not in Plan._made:
            Plan._made[self.key] = Tokenizer(self.ranks, self.sound)
        return Plan._made[self.key]


def load(spark: SparkSession, path: str):
    """The tokenizer of a rank file for use in tasks. The file is read in the driver only; what
    is broadcast is the vocabulary, which doesn't grow with the data."""
    return spark.sparkContext.broadcast(Plan(read_ranks(path)))


def _texts(body: np.ndarray, begins: np.ndarray) -> Iterator[str]:
    raw = body.tobytes()
    at = begins.tolist()
    for a, b in zip(at, at[1:]):
        yield raw[a:b].decode("utf-8", "replace")


def encode(docs: DataFrame, held, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """All columns of `docs` and `ids`, the tokens of the text. NULL and empty texts have no ids.

    With `decoded`, the bytes that the ids stand for are the last column; made in the same pass, they need no
    second Python worker. The new columns are `ids_`, ... if `docs` has such a column already.
    """
    at = docs.columns.index(text_col)
    new = [T.StructField(fresh(docs, "ids"), T.ArrayType(T.IntegerType()))]
    if decoded:
        new.append(T.StructField(fresh(docs, "decoded"), T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = held.value.tokenizer()
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(at), PIECE_BYTES):
                ids = tok.encode_all(_texts(body, begins))
                made = list_array(
                    np.fromiter(chain.from_iterable(ids), np.int32), np.array([len(x) for x in ids]), pa.int32()
                )
                added = [made]
                if decoded:
                    added.append(pa.array([tok.decode(x) for x in ids], pa.binary()))
                rows = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *added], names=[*rows.schema.names, *[f.name for f in new]]
                )

    schema = T.StructType([*docs.schema.fields, *new])
    return numbered(docs).mapInArrow(run, schema)


def digests(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    The ids are decoded again; the digests are of the ids in decimal, joined by commas, and of the
    decoded bytes. NULL and empty texts have no ids.
    """

    def made(tok: Tokenizer, ids: list[int]) -> tuple:
        joined = ",".join(map(tok.texts.__getitem__, ids))
        return (
            len(ids),
            hashlib.sha256(joined.encode()).hexdigest(),
            hashlib.sha256(tok.decode(ids)).hexdigest(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = held.value.tokenizer()
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1), PIECE_BYTES):
                rows = [made(tok, ids) for ids in tok.encode_all(_texts(body, begins))]
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *columns], names=["doc_id", *extra.names]
                )

    extra = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string")
    kinds = [pa.int64(), pa.string(), pa.string()]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *extra])
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, held, ids_col: str = "ids") -> DataFrame:
    """All columns of `encoded` and `decoded`, the bytes of its ids. NULL ids give NULL."""
    name, at = fresh(encoded, "decoded"), encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = held.value.tokenizer()
        for batch in batches:
            ids = batch.column(at).to_pylist()
            back = [None if x is None else tok.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(back, pa.binary())], names=[*batch.schema.names, name]
            )

    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.BinaryType())])
    return numbered(encoded).mapInArrow(run, schema)
