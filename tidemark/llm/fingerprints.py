"""Order MinHash: fingerprints that feel edits and their order.

A text is the bag of its k-mers of code points, the n-th occurrence of a k-mer told apart from the others.
For each of `SIGNS` hash functions the `TUPLE` smallest of them are taken, put back into the order of the
text, and hashed together. The share of equal signs of two texts estimates how likely it is that a random few
k-mers occur in both, and in the same order, which falls with the edit distance.

A text shorter than `K` is its own only k-mer; a text with fewer k-mers than `TUPLE` uses all it has;
NULL and empty texts have the signs of the empty tuple, like each other and unlike all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import U64, mix, narrow
from tidemark.session import stage

K = 8
TUPLE = 2
SIGNS = 64
STEP = 1 << 13  # k-mers hashed at a time

_RNG = np.random.default_rng(5)
_MULT = _RNG.integers(1, 2**31, SIGNS, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(1, 2**32, SIGNS, dtype=np.int64).astype(np.uint32)


def kmers(codes: np.ndarray) -> np.ndarray:
    """32-bit hashes of the occurrence-numbered k-mers, in text order."""
    k = min(K, len(codes))
    if not k:
        return np.zeros(0, np.uint32)
    n = len(codes) - k + 1
    h = np.zeros(n, U64)
    for j in range(k):
        h = h * U64(0x9E3779B97F4A7C15) + codes[j : j + n]
    h = mix(h + U64(k))
    # Sorted by hash, then place: the place stands in the low bits, which saves a stable sort.
    low = U64((1 << n.bit_length()) - 1)
    ranked = np.sort((h & ~low) | np.arange(n, dtype=U64))
    place = (ranked & low).astype(np.int64)
    begin = np.ones(n, bool)
    begin[1:] = (ranked[1:] & ~low) != (ranked[:-1] & ~low)
    at = np.arange(n)
    occurrence = np.zeros(n, np.int64)
    occurrence[place] = at - np.maximum.accumulate(np.where(begin, at, 0))
    again = occurrence > 0
    h[again] = mix(h[again] + occurrence[again].astype(U64) * U64(0xD1342543DE82EF95))
    return (h >> U64(32)).astype(np.uint32)


def signs(codes: np.ndarray) -> np.ndarray:
    """The 16-bit signs of a text given as code points."""
    h = kmers(codes)
    n = len(h)
    take = min(TUPLE, n)
    if not take:
        return np.zeros(SIGNS, np.uint16)
    every = np.arange(SIGNS)
    best = np.full((SIGNS, 0), 0, np.int64)
    for lo in range(0, n, STEP):
        part = h[lo : lo + STEP]
        seen = (part ^ _XOR[:, None]) * _MULT[:, None]
        # High bits are better mixed, and equal hashes go by position.
        seen ^= seen >> np.uint32(15)
        found = []
        for _ in range(min(take, len(part))):
            at = seen.argmin(axis=1)
            found.append((seen[every, at].astype(np.int64) << 31) | (at + lo))
            seen[every, at] = np.uint32(0xFFFFFFFF)
        best = np.sort(np.concatenate([best, np.stack(found, axis=1)], axis=1), axis=1)[:, :take]
    place = np.sort(best & ((1 << 31) - 1), axis=1)
    out = np.full(SIGNS, U64(take))
    for j in range(take):
        out = mix(out * U64(3) + h[place[:, j]].astype(U64))
    return (out >> U64(48)).astype(np.uint16)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(s: np.ndarray) -> str:
    return s.tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint. Repeated rows each get a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [as_text(signs(code_points(t or ""))) for t in _strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"]
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


def _strings(column: pa.Array) -> Iterator[str | None]:
    for value in column:
        yield value.as_py()


def edited(codes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The text with its last quarter replaced by as many first characters of the next text, or all of it."""
    cut = len(codes) // 4
    return np.concatenate([codes[: len(codes) - cut], following[:cut]])


def _compared(text: str, own: np.ndarray, following: str, next_signs: np.ndarray) -> dict:
    new = edited(code_points(text), code_points(following))
    new_signs = signs(new)
    return {
        "n_chars": len(text),
        "sha": hashlib.sha256(new.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest(),
        "own": own.tobytes(),
        "new": new_signs.tobytes(),
        "near_edited": likeness(own, new_signs),
        "near_next": likeness(own, next_signs),
    }


_ROW = "part int, kind int, text string, n_chars long, sha string, own binary, new binary, near_edited double, near_next double"
_DONE, _HEAD, _TAIL = 0, 1, 2


def _walk(id_type: pa.DataType):
    """A task's work: compare each document of a sorted range with the one behind it.

    The first document goes out as a head as well, and the last one as a tail: its successor is the
    head of the next range.
    """
    from pyspark import TaskContext

    names = [f.split()[0] for f in _ROW.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[1].get(n) for r in rows], t) for n, t in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *columns], names=["id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for key, text in zip(ids, _strings(batch.column(1))):
                text = text or ""
                own = signs(code_points(text))
                if held is None:
                    out.append((key, dict(part=part, kind=_HEAD, text=text, own=own.tobytes())))
                else:
                    out.append((held[0], dict(part=part, kind=_DONE, **_compared(held[1], held[2], text, own))))
                held = (key, text, own)
                if len(out) >= 1024:
                    yield table(out)
                    out = []
            yield table(out)
        if held is not None:
            yield table([(held[0], dict(part=part, kind=_TAIL, text=held[1], own=held[2].tobytes()))])

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text ends with the beginning of the next document instead of its own last quarter. The next
    document is the one with the next id, after the last the first; rows without an id come last, and
    rows with equal ids go by a hash of their text. A single document is its own next. NULL texts
    are empty. Empty tables give no rows.

    Texts move once, into ranges of ids. Only the first and the last document of a range are looked at
    again; the driver learns the number of each range that has rows, nothing else.
    """
    rows = narrow(docs, id_col, text_col).toDF("id", "text")
    kind = docs.schema[id_col].dataType
    order = [F.col("id").isNull(), F.col("id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL(_ROW)])
    id_type = to_arrow_type(kind)
    walked = stage(ranged.mapInArrow(_walk(id_type), schema), "fingerprints")
    parts = sorted(r["part"] for r in walked.where(F.col("kind") == _HEAD).select("part").collect())
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = walked.where(F.col("kind") == _HEAD).select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("own").alias("next_own")
    )
    tails = walked.where(F.col("kind") == _TAIL).select("id", "part", "text", "own")
    ends = tails.join(after, "part").join(heads, "next_part").select("id", "text", "own", "next_text", "next_own")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                _compared(r["text"], np.frombuffer(r["own"], np.uint16), r["next_text"], np.frombuffer(r["next_own"], np.uint16))
                for r in batch.select(["text", "own", "next_text", "next_own"]).to_pylist()
            ]
            types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            columns = [pa.array([f[c] for f in found], t) for c, t in zip(_RESULT, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *_RESULT])

    result = T.StructType([schema["id"], *[schema[c] for c in _RESULT]])
    done = walked.where(F.col("kind") == _DONE).select("id", *_RESULT).unionByName(ends.mapInArrow(finish, result))
    return done.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        F.lower(F.hex("own")).alias("fingerprint"),
        F.lower(F.hex("new")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


_RESULT = ["n_chars", "sha", "own", "new", "near_edited", "near_next"]
