"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lowered. A window is `span`
consecutive words of a benchmark item; an item with fewer words is one window as a whole. A
document word is hit if it lies in an occurrence of a window.

Of every `span - gram + 1` consecutive grams, the one with the smallest hash (the rightmost of equal
ones) is kept as a fingerprint. Documents and items choose alike, so a shared span of `span` words always
shares a fingerprint. Around it travel the hashes of the words that can belong to such a span; a
joined fingerprint is extended to both sides word by word, and counts if the match has `span` words.
Items shorter than `span` are looked for at every position of a document, by two hashes of the whole.

The fingerprints of a document that no item has are dropped before the shuffle by a bit map of fixed size,
made from all items. It grows fuller, never larger; the join that follows is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import NO_ALNUM, U64, fresh, grams, list_array, mix, narrow, numbered, pieces, signed, words
from tidemark.operators.groups import attach_facts
from tidemark.session import stage

SPAN = 13
GRAM = 5
MAP_BITS = 24

_OUTSIDE_DOC, _OUTSIDE_ITEM = U64(1), U64(2)


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of every `window` consecutive gram hashes, the rightmost of equals."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Smallest of ever longer runs; on ties the later one wins.
    best, at, have = g.copy(), np.arange(len(g)), 1
    while have < window:
        step = min(have, window - have)
        later = best[step:] <= best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        have += step
    return np.unique(at[:n])


def _surroundings(h: np.ndarray, at: np.ndarray, span: int, gram: int, outside: np.uint64) -> np.ndarray:
    """Word hashes from `span - gram` before each position to as many behind the gram."""
    reach = span - gram
    padded = np.concatenate([np.full(reach, outside), h, np.full(reach, outside)])
    return np.lib.stride_tricks.sliding_window_view(padded, 2 * span - gram)[at]


def _whole(h: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every m consecutive words."""
    salt = U64(0x51ED270B00000000 + m)
    return mix(grams(h, m) ^ salt), grams(h ^ U64(0xABCDEF), m)


def _fingerprints(
    h: np.ndarray, span: int, gram: int, lengths: list[int], outside: np.uint64
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(fingerprint, position, what must agree, words covered at least) of one text."""
    g = grams(h, gram)
    at = winnow(g, span - gram + 1)
    if len(at):
        yield g[at], at, _surroundings(h, at, span, gram, outside), 0
    for m in lengths:
        if len(h) >= m:
            one, two = _whole(h, m)
            yield one, np.arange(len(one)), two[:, None], m


def item_prints(items: DataFrame, id_col: str, text_col: str, span: int, gram: int) -> DataFrame:
    """(fp, short, ctx, item): one row per fingerprint; `short` is the length of a short item or 0."""
    kind = items.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                h, _, _, first = words(body, begins, NO_ALNUM)
                fp, short, ctx, row = [], [], [], []
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    n = b - a
                    lengths = [int(n)] if 0 < n < span else []
                    for f, _, c, m in _fingerprints(h[a:b], span, gram, lengths, _OUTSIDE_ITEM):
                        fp.append(f)
                        ctx += [r.tobytes() for r in c]
                        short += [m] * len(f)
                        row += [i] * len(f)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64()))
                values = signed(np.concatenate(fp)) if fp else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values), pa.array(short, pa.int32()), pa.array(ctx, pa.binary()), ids],
                    names=["fp", "short", "ctx", "item"],
                )

    schema = T.StructType(
        [*T.StructType.fromDDL("fp long, short int, ctx binary"), T.StructField("item", kind)]
    )
    return narrow(items, id_col, text_col).mapInArrow(run, schema).distinct()


def _bit_map(prints: DataFrame) -> bytes:
    """2^MAP_BITS bits, one set for each fingerprint. Gathered as at most 2^MAP_BITS / 64 words."""
    bit = F.col("fp").bitwiseAND((1 << MAP_BITS) - 1)
    cells = (
        prints.select(F.shiftright(bit, 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(fp & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return table.tobytes()


def document_prints(
    docs: DataFrame, text_col: str, id_col: str, span: int, gram: int, lengths: list[int], bits: bytes
) -> DataFrame:
    """(row, id, n_words, prints): per document the fingerprints whose bit is set.

    Equal fingerprints with equal surroundings are one entry with all their positions.
    """
    kind = docs.schema[id_col].dataType
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = np.frombuffer(held.value, np.uint64)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                h, _, _, first = words(body, begins, NO_ALNUM)
                entries: list[list[dict]] = []
                for a, b in zip(first, first[1:]):
                    own: dict[tuple, list[int]] = {}
                    for f, at, ctx, m in _fingerprints(h[a:b], span, gram, lengths, _OUTSIDE_DOC):
                        bit = f & U64((1 << MAP_BITS) - 1)
                        for k in np.flatnonzero((table[bit >> U64(6)] >> (bit & U64(63))) & U64(1)):
                            key = (int(f[k].view(np.int64)), m, ctx[k].tobytes())
                            own.setdefault(key, []).append(int(at[k]))
                    entries.append(
                        [dict(fp=f, short=m, ctx=c, at=at) for (f, m, c), at in own.items()]
                    )
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0).slice(lo, n),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(entries, _PRINTS),
                    ],
                    names=["row", "id", "n_words", "prints"],
                )
                row += n

    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", kind),
            *T.StructType.fromDDL(
                "n_words long, prints array<struct<fp: long, short: int, ctx: binary, at: array<int>>>"
            ),
        ]
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


_PRINTS = pa.list_(
    pa.struct(
        [("fp", pa.int64()), ("short", pa.int32()), ("ctx", pa.binary()), ("at", pa.list_(pa.int32()))]
    )
)


def _extended(pairs: DataFrame, span: int, gram: int) -> DataFrame:
    """(row, item, starts, length) of the joined fingerprints that extend to a whole window."""
    reach = span - gram
    wide = 2 * span - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column(2).to_numpy(zero_copy_only=False)
            shift = np.zeros(len(short), np.int32)
            length = short.astype(np.int32)
            whole = short > 0
            mine, theirs = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            ok = np.array([bool(w) and x == y for w, x, y in zip(whole, mine, theirs)], bool)
            long = np.flatnonzero(~whole)
            if len(long):
                x = np.frombuffer(b"".join(mine[k] for k in long), np.uint64).reshape(-1, wide)
                y = np.frombuffer(b"".join(theirs[k] for k in long), np.uint64).reshape(-1, wide)
                same = x == y
                left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, reach + gram :], axis=1).sum(axis=1)
                ok[long] = same[:, reach : reach + gram].all(axis=1) & (left + gram + right >= span)
                shift[long], length[long] = left, left + gram + right
            kept = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(5), pa.array(shift), pa.array(length)],
                names=["row", "item", "at", "back", "length"],
            )
            yield kept.filter(pa.array(ok))

    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("item", pairs.schema["item"].dataType),
            *T.StructType.fromDDL("at array<int>, back int, length int"),
        ]
    )
    return pairs.select("row", "item", "short", "ctx", "item_ctx", "at").mapInArrow(run, schema)


def _covered(hits: DataFrame) -> DataFrame:
    """(row, n_hit): words inside the union of a document's hits.

    The intervals of a document are made distinct before they meet, however many items share them.
    """
    spans = hits.select(
        "row", F.explode("at").alias("at"), "back", "length"
    ).select("row", (F.col("at") - F.col("back")).alias("lo"), "length")
    spans = spans.groupBy("row", "lo").agg(F.max("length").alias("length"))

    @F.pandas_udf("long")
    def union(column: pd.Series) -> pd.Series:
        out = []
        for items in column:
            lo = np.array([r["lo"] for r in items], np.int64)
            hi = lo + np.array([r["length"] for r in items], np.int64)
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            out.append(int((hi - np.maximum(lo, np.concatenate([[0], hi[:-1]]))).clip(0).sum()))
        return pd.Series(out, dtype="int64")

    grouped = spans.groupBy("row").agg(F.collect_list(F.struct("lo", "length")).alias("spans"))
    return grouped.select("row", union("spans").alias("n_hit"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as text), contaminated.

    `contaminated` holds if at least one word and at least 5 % of the words are hit. NULL and empty
    texts have no words and are clean, items without words match nothing, an item without an id counts
    for the hit words but is not listed. Repeated rows each get a row. Empty tables give no rows, or clean
    ones if only the benchmark is empty.
    """
    theirs = stage(item_prints(items, item_id_col, item_text_col, span, gram), "item-prints")
    lengths = [r[0] for r in theirs.where("short > 0").select("short").distinct().collect()]
    found = document_prints(docs, text_col, id_col, span, gram, sorted(lengths), _bit_map(theirs))
    rows = stage(found, "document-prints")
    single = rows.where("size(prints) > 0").select("row", F.explode("prints").alias("p"))
    pairs = single.select("row", "p.*").join(
        theirs.select("fp", "short", F.col("ctx").alias("item_ctx"), "item"), ["fp", "short"]
    )
    hits = stage(_extended(pairs, span, gram), "hits")
    listed = hits.groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    joined = rows.drop("prints").join(_covered(hits), "row", "left").join(listed, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that are not contaminated, all columns.

    An id is dropped if one of its rows is contaminated; rows without an id are judged together.
    `drop_contaminated_rows` judges each row by itself.
    """
    bad = contamination(docs, items, id_col, text_col).where("contaminated")
    mark = fresh(docs, "bad_id")
    bad = bad.select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(mark)), "left_anti")


def drop_contaminated_rows(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, all columns. Each is judged by its own text, whatever its id.

    A verdict follows from the text alone, so it comes back to its rows by the SHA-256 of the text.
    """
    flat = numbered(docs)
    text = flat.columns[docs.columns.index(text_col)]
    flat = flat.withColumn("mark", F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
    bad = contamination(flat, items, "mark", text).where("contaminated")
    bad = bad.groupBy(F.col("doc_id").alias("mark")).agg(F.count(F.lit(1)).alias("n_rows"))
    kept = attach_facts(flat, bad, ["mark"], "n_rows").where("n_rows is null")
    return kept.drop("mark", "n_rows").toDF(*docs.columns)
