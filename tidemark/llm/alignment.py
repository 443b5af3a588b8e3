"""Alignment of two tokenizers, token by token, through the bytes that tokens share.

Tokenizer A is byte-level BPE of the `tokenizers` library, B a `sentencepiece` model. Both encode a
space and the text. The tokens of A make a sparse matrix with one row per token and one column per byte, those of
B another. Row products after Gustavson, A·Bᵀ, hold for each A token the B tokens that it overlaps, and
with how many bytes: the links. Where tokens of both end, a group ends; the product of the two matrices of tokens
by groups holds all pairs that share a group. The matrices are compressed rows (`Csr`), made here.

Neither tokenizer looks across a single space between two characters that are not white space, if no piece of B
has a space behind another character (`Pair` looks). So a text falls into words, each with its space, and no
token, group or link crosses their borders; nor, if no piece has them together, the border between a letter
and a mark (`.,;:!?`). The new words of a batch are encoded as one text and multiplied in one product, and
remembered in two halves of up to `MEMO`; texts are sums over their words.

Texts are encoded once: their pairs are kept with their digests. How often an id pair is linked in the whole corpus
is summed by Spark. The most frequent pairs, at most `TABLE`, are broadcast; links of rarer pairs are joined with
their counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, list_array, narrow, numbered, pieces
from tidemark.session import stage

TABLE = 1 << 20  # pairs that are broadcast: 17 bytes each
MEMO = 150_000
MEMO_CHARS = 64  # longer words are not remembered
PIECE_BYTES = 1 << 19
PENDING = 1 << 21  # pairs a task holds before it sums them, and distinct ones before it hands them on

_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_MARKS = ".,;:!?"
_LETTER_MARK = re.compile("[A-Za-z][.,;:!?]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_UNEVEN = re.compile(r" (?:\s|\Z)|\s ")


# -- sparse matrices ---------------------------------------------------------------------------------


@dataclass
class Csr:
    """Compressed rows: the nonzeros of row i are `at[i]` to `at[i + 1]`."""

    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each nonzero."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        at = np.zeros(self.width + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.width), out=at[1:])
        return Csr(at, self.rows[order], self.values[order], len(self.at) - 1)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: each token has ones at the bytes that it covers."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    n = int(at[-1])
    return Csr(at, np.arange(n), np.ones(n, np.int32), n)


def token_groups(lengths: np.ndarray, ends: np.ndarray) -> Csr:
    """Tokens by groups: each token has a one at the group that its last byte lies in."""
    stop = np.cumsum(lengths)
    n = len(lengths)
    return Csr(np.arange(n + 1), np.searchsorted(ends, stop), np.ones(n, np.int32), len(ends))


def product(a: Csr, b: Csr) -> Csr:
    """a·b by rows (Gustavson): each nonzero of a row of `a` brings the row of `b` that it points to,
    and what falls on the same column is added up."""
    reach = np.diff(b.at)[a.columns]
    begin = np.cumsum(reach) - reach
    pick = np.arange(int(reach.sum())) - np.repeat(begin - b.at[a.columns], reach)
    row, column = np.repeat(a.rows, reach), b.columns[pick]
    value = np.repeat(a.values, reach) * b.values[pick]
    key = row * max(1, b.width) + column
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(value, first) if len(first) else value
    row, column = np.divmod(key[first], max(1, b.width))
    at = np.zeros(len(a.at), np.int64)
    np.cumsum(np.bincount(row, minlength=len(a.at) - 1), out=at[1:])
    return Csr(at, column, sums, b.width)


def group_ends(a_lengths: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Byte offsets where a token of A and a token of B end."""
    return np.intersect1d(np.cumsum(a_lengths), np.cumsum(b_lengths), assume_unique=True)


# -- tokenizers --------------------------------------------------------------------------------------


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    _made: dict[int, Pair] = {}

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The byte-level alphabet: printable Latin-1 as itself, the other bytes in order from U+0100.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in set(plain)]
        letters = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
        special = set(self.a.get_added_tokens_decoder())
        self.a_bytes = [b""] * (1 + max(self.a.get_vocab().values()))
        for token, k in self.a.get_vocab().items():
            if k not in special:
                self.a_bytes[k] = bytes(letters[c] for c in token)
        self.b_bytes, self.closed, self.marked = [], True, True
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            if self.b.is_byte(k):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(k) or self.b.is_unknown(k):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
                self.closed &= "▁" not in piece.lstrip("▁")
                self.marked &= not _LETTER_MARK.search(piece)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_first = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_first = np.array([x[:1] == b" " for x in self.b_bytes])
        # The ids as text, with what follows them: another token of the same side, or the end of the side in its group.
        self.a_text = np.array([[f"{k}{c}" for k in range(len(self.a_bytes))] for c in ",|"], object)
        self.b_text = np.array([[f"{k}{c}" for k in range(len(self.b_bytes))] for c in ",;"], object)
        self.a_chars, self.b_chars = (np.array([len(x) for x in t[0]], np.int64) for t in (self.a_text, self.b_text))

    @classmethod
    def of(cls, spec: str, model: bytes) -> Pair:
        key = hash((spec, model))
        if key not in cls._made:
            cls._made[key] = cls(spec, model)
        return cls._made[key]

    def words(self, text: str) -> list[str]:
        """The parts of a text that are encoded alone, without the space before each."""
        if not text:
            return []
        if not self.closed:
            return [text]
        return _CUT.split(text) if _UNEVEN.search(" " + text) else text.split(" ")

    def encode(self, words: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of each word, or None where the tokens do not spell it."""
        spaced = [" " + w for w in words]
        ours = self.a.encode_batch_fast(spaced, add_special_tokens=False)
        theirs = self.b.encode(words, num_threads=1)
        out: list[tuple[list[int], list[int]] | None] = []
        for word, e, b in zip(spaced, ours, theirs):
            a, raw = e.ids, word.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((a, b) if same and all(map(self.b_bytes.__getitem__, b)) else None)
        return out

    def _joined(self, words: list[str]) -> tuple[np.ndarray, ...] | None:
        """Ids of A and B, and the first ones of each word, from one text of all words; None if that can't be told."""
        text = " ".join(words)
        raw = (" " + text).encode()
        a_ids = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b_ids = self.b.encode(text, num_threads=1)
        for ids, spelled in ((a_ids, self.a_bytes), (b_ids, self.b_bytes)):
            if b"".join(map(spelled.__getitem__, ids)) != raw:
                return None
        a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        starts = np.cumsum([0, *[len(w.encode()) + 1 for w in words[:-1]]])
        out = [a_ids, b_ids]
        for ids, size, first in ((a_ids, self.a_size, self.a_first), (b_ids, self.b_size, self.b_first)):
            at = np.flatnonzero(first[ids])
            end = np.cumsum(size[ids])
            if (size[ids] == 0).any() or len(at) != len(words) or ((end - size[ids])[at] != starts).any():
                return None
            out.append(np.append(at, len(ids)))
        return tuple(out)

    def encode_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of all words that tokens spell, where each word's begin, and which words these are."""
        alone, together = [], []
        for k, w in enumerate(words):
            plain = self.closed and w and " " not in w and not (w[0].isspace() or w[-1].isspace())
            (together if plain else alone).append(k)
        found: list[tuple[int, list[int], list[int]]] = []
        runs, waiting = [], [together] if together else []
        while waiting:
            own = waiting.pop()
            got = self._joined([words[k] for k in own])
            if got is not None:
                runs.append((own, got))
            elif len(own) > 16:
                # Some word is odd: look for it.
                waiting += [own[: len(own) // 2], own[len(own) // 2 :]]
            else:
                alone += own
        for k, ids in zip(alone, self.encode([words[k] for k in alone])):
            if ids is not None:
                found.append((k, *ids))
        parts = [(own, *got) for own, got in runs]
        if found:
            sides = [[np.array(f[side], np.int64) for f in found] for side in (1, 2)]
            ends = [np.cumsum([0, *map(len, side)]) for side in sides]
            parts.append(([f[0] for f in found], *map(np.concatenate, sides), *ends))
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(1, np.int64), np.zeros(1, np.int64), none
        a_at, b_at, a_n, b_n = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 0, 0
        for _, a, b, x, y in parts:
            a_at.append(x[1:] + a_n)
            b_at.append(y[1:] + b_n)
            a_n, b_n = a_n + len(a), b_n + len(b)
        ids = [np.concatenate([p[side] for p in parts]) for side in (1, 2)]
        which = np.concatenate([np.array(p[0], np.int64) for p in parts])
        return *ids, np.concatenate(a_at), np.concatenate(b_at), which


def load(spark: SparkSession, a_path: str, b_path: str):
    """Both tokenizers for use in tasks. The files are read in the driver only; their size doesn't follow the data."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


# -- words -------------------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Alignments of words. `which` are the words that tokens spell; the links of word `which[k]` are those from
    `link_at[k]` to `link_at[k + 1]`. `keys` has `a << 32 | b` for each link."""

    which: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    link_at: np.ndarray
    keys: np.ndarray
    groups: list[bytes]


def align_words(pair: Pair, words: list[str], groups: bool = True) -> Aligned:
    """Alignments of words, from one product for all of them; without `groups`, only the links."""
    a_ids, b_ids, a_at, b_at, which = pair.encode_all(words)
    a_size, b_size = pair.a_size[a_ids], pair.b_size[b_ids]
    links = product(token_bytes(a_size), token_bytes(b_size).transposed())
    keys = (a_ids[links.rows] << 32) | b_ids[links.columns]
    out = Aligned(which, np.diff(a_at), np.diff(b_at), np.zeros(len(which), np.int64), links.at[a_at], keys, [])
    if groups and len(which):
        ends = group_ends(a_size, b_size)
        a_group, b_group = token_groups(a_size, ends), token_groups(b_size, ends)
        a_cut, b_cut = a_group.transposed().at, b_group.transposed().at
        # The words end groups, too: their ends are ends of tokens of both.
        out.n_groups = np.diff(np.searchsorted(a_cut, a_at))
        # Each group's tokens of A, then its tokens of B.
        a_place = np.arange(len(a_ids)) + b_cut[a_group.columns]
        b_place = np.arange(len(b_ids)) + a_cut[b_group.columns + 1]
        text, size = np.empty(len(a_ids) + len(b_ids), object), np.empty(len(a_ids) + len(b_ids), np.int64)
        a_last = np.zeros(len(a_ids), np.int64)
        a_last[a_cut[1:] - 1] = 1
        b_last = np.zeros(len(b_ids), np.int64)
        b_last[b_cut[1:] - 1] = 1
        text[a_place], text[b_place] = pair.a_text[a_last, a_ids], pair.b_text[b_last, b_ids]
        size[a_place], size[b_place] = pair.a_chars[a_ids], pair.b_chars[b_ids]
        joined = "".join(text.tolist()).encode()
        at = np.concatenate([[0], np.cumsum(size)])[a_at + b_at].tolist()
        out.groups = [joined[x : y - 1] for x, y in zip(at, at[1:])]
    return out


class Memory:
    """What is known of words, in two halves; None for words that tokens don't spell.

    `make` turns a list of words into what is to be known. A word of letters and marks is put together (`join`) from the
    two, which tokens never cross; what is known of marks is what they add to a letter (`rest`).
    """

    _held: dict[int, Memory] = {}

    @classmethod
    def of(cls, pair: Pair, make, join, rest) -> Memory:
        """The memory of a Python worker for a pair of tokenizers, which outlives its tasks."""
        if id(pair) not in cls._held:
            cls._held[id(pair)] = cls(make, join, rest, pair.marked)
        return cls._held[id(pair)]

    def __init__(self, make, join, rest, marked: bool = True):
        self.make, self.join, self.rest, self.marked = make, join, rest, marked
        self.young, self.older, self.marks = {}, {}, {}

    def _mark(self, marks: str):
        if marks not in self.marks:
            if len(self.marks) > 1000:
                self.marks = {}
            self.marks[marks] = self.rest(*self.make(["a" + marks, "a"]))
        return self.marks[marks]

    def learn(self, words: set[str]) -> list[str]:
        """Make all of `words` known. Returns those too long to be remembered, for `forget`."""
        if len(self.young) > MEMO:
            self.older, self.young = self.young, {}
        young, older = self.young, self.older
        new, ended, long = set(), [], []
        for word in words - young.keys():
            if word in older:
                young[word] = older[word]
                continue
            if len(word) > MEMO_CHARS:
                long.append(word)
            stem = word.rstrip(_MARKS)
            if self.marked and len(stem) < len(word) and stem and stem[-1].isascii() and stem[-1].isalpha():
                ended.append((word, stem))
                if stem in older and stem not in young:
                    young[stem] = older[stem]
                elif stem not in young:
                    new.add(stem)
                    if len(stem) > MEMO_CHARS:
                        long.append(stem)
            else:
                new.add(word)
        new = sorted(new, key=len)
        lo = 0
        while lo < len(new):
            hi, size = lo, 0
            while hi < len(new) and hi < lo + 1024 and (hi == lo or size + len(new[hi]) < 20_000):
                size += len(new[hi])
                hi += 1
            young.update(zip(new[lo:hi], self.make(new[lo:hi])))
            lo = hi
        for word, stem in ended:
            whole = young[stem]
            young[word] = None if whole is None else self.join(whole, self._mark(word[len(stem) :]))
        return long

    def forget(self, words: list[str]) -> None:
        for word in words:
            self.young.pop(word, None)


def _texts(body: np.ndarray, begins: np.ndarray) -> list[str]:
    raw, at = body.tobytes(), begins.tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], np.add.reduceat(n, first)) if len(first) else (keys, n)


def _to_blob(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pair codes as steps, and how often each occurs: bytes of one place beside each other, compressed."""
    planes = np.stack([np.diff(codes, prepend=0), times]).astype("<u8").view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)
    return _PACK.compress(np.ascontiguousarray(planes).tobytes())


def _from_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(_UNPACK.decompress(blob), np.uint8)
    planes = np.ascontiguousarray(raw.reshape(2, 8, -1).transpose(0, 2, 1)).reshape(2, -1).view(np.int64)
    return np.cumsum(planes[0]), planes[1]


def encode(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs.

    `pairs` has the linked id pairs and how many links hold each; `row` tells rows apart. NULL and empty texts, and
    texts that the tokens of A or B do not spell, have zeros, an empty digest and no pairs. The result is to be
    written before it is used more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = Pair.of(*held.value)
        span = len(pair.b_bytes)
        row = TaskContext.get().partitionId() << 36

        def known_of(new: list[str]) -> list[tuple | None]:
            x = align_words(pair, new)
            facts = np.stack([x.n_a, x.n_b, x.n_groups, np.diff(x.link_at)], axis=1).astype(np.int64).tobytes()
            codes, at = ((x.keys >> 32) * span + (x.keys & 0xFFFFFFFF)).tobytes(), (8 * x.link_at).tolist()
            out: list[tuple | None] = [None] * len(new)
            for j, k in enumerate(x.which.tolist()):
                out[k] = (facts[32 * j : 32 * j + 32], x.groups[j], codes[at[j] : at[j + 1]])
            return out

        def sums(x: tuple, y: tuple, sign: int = 1) -> bytes:
            return (np.frombuffer(x[0], np.int64) + sign * np.frombuffer(y[0], np.int64)).tobytes()

        memory = Memory.of(
            pair,
            known_of,
            lambda x, y: (sums(x, y), x[1] + b";" + y[1], x[2] + y[2]),
            lambda x, y: (sums(x, y, -1), x[1][len(y[1]) + 1 :], x[2][len(y[2]) :]),
        )
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1), PIECE_BYTES):
                split = [pair.words(t) for t in _texts(body, begins)]
                long = memory.learn(set().union(*split))
                known = memory.young
                facts, shas, blobs = [], [], []
                for words in split:
                    of = list(map(known.__getitem__, words))
                    if not of or None in of:
                        facts.append(np.zeros(4, np.int64))
                        shas.append("")
                        blobs.append(None)
                        continue
                    facts.append(np.frombuffer(b"".join([x[0] for x in of]), np.int64).reshape(-1, 4).sum(axis=0))
                    shas.append(hashlib.sha256(b";".join([x[1] for x in of])).hexdigest())
                    codes = np.sort(np.frombuffer(b"".join([x[2] for x in of]), np.int64))
                    first = np.flatnonzero(np.diff(codes, prepend=-1))
                    blobs.append(_to_blob(codes[first], np.diff(first, append=len(codes))))
                memory.forget(long)
                table = np.stack(facts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + hi - lo)),
                        batch.column(0).slice(lo, hi - lo),
                        *[pa.array(table[:, k]) for k in range(4)],
                        pa.array(shas),
                        pa.array(blobs, pa.binary()),
                    ],
                    names=["row", "doc_id", *_NUMBERS[:4], "groups_sha256", "pairs"],
                )
                row += hi - lo

    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in _NUMBERS[:4]],
            *T.StructType.fromDDL("groups_sha256 string, pairs binary"),
        ]
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(key, n): how many links of the whole table hold an id pair; `key` is the id of A times the size of B's
    vocabulary plus the id of B. Tasks sum before they hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, pending = [], [], 0

        def rows(k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "n"])

        for batch in batches:
            for blob in batch.column(0):
                if not blob.is_valid:
                    continue
                k, n = _from_blob(blob.as_py())
                keys.append(k)
                counts.append(n)
                pending += len(k)
                if pending > PENDING:
                    k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    if len(k) > PENDING // 2:
                        yield rows(k, n)
                        k, n = k[:0], n[:0]
                    keys, counts, pending = [k], [n], len(k)
        if keys:
            yield rows(*_summed(np.concatenate(keys), np.concatenate(counts)))

    return encoded.select("pairs").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """The most frequent pairs as sorted arrays, and the table of all of them; `least` is 0 if that is all."""

    table: DataFrame
    frequent: object
    least: int


def count_pairs(encoded: DataFrame, held, most: int = TABLE) -> Counts:
    """Counts of all pairs, each with whether it is the most frequent one of its B id (ties included)."""
    spark = encoded.sparkSession
    span = len(Pair.of(*held.value).b_bytes)
    counts = stage(pair_counts(encoded), "pairs")
    b = F.col("key") % span
    # One row per id of B: never more than its vocabulary.
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    counts = counts.join(F.broadcast(top), b == F.col("b")).select("key", "n", (F.col("n") == F.col("top")).alias("best"))
    # The least count with which at most `most` pairs remain, to an eighth of a power of two.
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()
    total, chosen = 0, None
    for r in steps:
        total += r["rows"]
        if total > most:
            break
        chosen = r["step"]
    least = 0 if total <= most else (1 << 62 if chosen is None else chosen)
    some = counts if least == 0 else counts.where(step >= least)
    got = some.toArrow()
    key = got["key"].to_numpy()
    order = np.argsort(key)
    frequent = (key[order], got["n"].to_numpy()[order], got["best"].to_numpy()[order])
    return Counts(counts, spark.sparkContext.broadcast(frequent), least)


def digests(encoded: DataFrame, counts: Counts) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `n_best` counts links whose pair is the most frequent one of its B id; `count_sum` adds the
    corpus-wide count of the pair of every link. Texts without tokens have zeros and an empty digest. Rows with
    equal ids each get a row; an empty table gives none.
    """
    frequent = counts.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, number, best = frequent.value
        for batch in batches:
            sums, rare = [], []
            for blob in batch.column(len(_KEPT)):
                if not blob.is_valid or not len(key):
                    sums.append((0, 0))
                    rare.append([])
                    if not blob.is_valid:
                        continue
                codes, times = _from_blob(blob.as_py())
                if len(key):
                    at = np.minimum(np.searchsorted(key, codes), len(key) - 1)
                    hit = key[at] == codes
                    at = at[hit]
                    sums.append((int(times[hit] @ best[at]), int(times[hit] @ number[at])))
                    codes, times = codes[~hit], times[~hit]
                    rare.append([])
                rare[-1] = [{"key": k, "m": m} for k, m in zip(codes.tolist(), times.tolist())]
            columns = [pa.array([x[k] for x in sums], pa.int64()) for k in range(2)]
            columns.append(pa.array(rare, pa.list_(pa.struct([("key", pa.int64()), ("m", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(_KEPT)], *columns], names=[*_KEPT, "n_best", "count_sum", "rare"]
            )

    schema = T.StructType(
        [
            *[encoded.schema[n] for n in _KEPT],
            *T.StructType.fromDDL("n_best long, count_sum long, rare array<struct<key: long, m: long>>"),
        ]
    )
    made = encoded.select(*_KEPT, "pairs").mapInArrow(run, schema)
    order = ["doc_id", *_NUMBERS, "groups_sha256"]
    if counts.least == 0:
        return made.select(*order)
    made = stage(made, "aligned")
    rest = made.select("row", F.explode("rare").alias("p")).select("row", "p.key", "p.m").join(counts.table, "key")
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more")
    )
    none = F.lit(0).cast("long")
    both = made.drop("rare").join(rest, "row", "left")
    both = both.withColumns(
        {
            "n_best": F.col("n_best") + F.coalesce("more_best", none),
            "count_sum": F.col("count_sum") + F.coalesce("more", none),
        }
    )
    return both.select(*order)


_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, held, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and a_ids, b_ids, links, groups.

    `links` has, for each overlapping pair, the positions of the A and the B token and the bytes they share, in order;
    `groups` has the first positions and the numbers of the tokens of each group. Texts without tokens have empty lists.
    The pairs that share a group are the products of its two ranges (`group_links`). New columns are
    named `links_`, ... if `docs` has such a column already.
    """
    at = docs.columns.index(text_col)
    kinds = {
        "a_ids": "array<int>",
        "b_ids": "array<int>",
        "links": "array<struct<a: int, b: int, bytes: int>>",
        "groups": "array<struct<a: int, n_a: int, b: int, n_b: int>>",
    }
    new = [T.StructField(fresh(docs, n), T._parse_datatype_string(k)) for n, k in kinds.items()]

    def structs(columns: dict[str, list[np.ndarray]], counts: list[int]) -> pa.Array:
        flat = {n: np.concatenate([np.zeros(0, np.int32), *c]).astype(np.int32) for n, c in columns.items()}
        offsets = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=offsets[1:])
        inner = pa.StructArray.from_arrays([pa.array(c) for c in flat.values()], names=list(flat))
        return pa.ListArray.from_arrays(pa.array(offsets), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(*held.value)
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(at), PIECE_BYTES):
                rows = []
                for text in _texts(body, begins):
                    found = pair.encode(pair.words(text))
                    ok = None not in found
                    a = np.array([i for x in found for i in x[0]] if ok else [], np.int64)
                    b = np.array([i for x in found for i in x[1]] if ok else [], np.int64)
                    a_size, b_size = pair.a_size[a], pair.b_size[b]
                    c = product(token_bytes(a_size), token_bytes(b_size).transposed())
                    ends = group_ends(a_size, b_size)
                    ga, gb = token_groups(a_size, ends).transposed().at, token_groups(b_size, ends).transposed().at
                    rows.append((a, b, (c.rows, c.columns, c.values), (ga[:-1], np.diff(ga), gb[:-1], np.diff(gb))))
                made = [
                    *[
                        list_array(np.concatenate([r[k] for r in rows]), np.array([len(r[k]) for r in rows]), pa.int32())
                        for k in (0, 1)
                    ],
                    structs({n: [r[2][k] for r in rows] for k, n in enumerate(("a", "b", "bytes"))}, [len(r[2][0]) for r in rows]),
                    structs({n: [r[3][k] for r in rows] for k, n in enumerate(("a", "n_a", "b", "n_b"))}, [len(r[3][0]) for r in rows]),
                ]
                kept = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *[f.name for f in new]])

    return numbered(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *new]))


def group_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """For each A token the B tokens of its group: the product of the two matrices of tokens by groups."""
    ends = group_ends(a_lengths, b_lengths)
    return product(token_groups(a_lengths, ends), token_groups(b_lengths, ends).transposed())
