"""Toxic passages: maximum-scoring segments of token log-odds.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lowered. A word is known by itself and by
its first 4 to 8 bytes, for a stem may be toxic with any ending. Words and beginnings are hashed into
`BUCKETS` buckets, so that what is learned has a known size: in how many texts of each class a
bucket occurs. A bucket's score is the log-odds ratio of toxic against other texts, in bits, under a
Dirichlet prior that has the shares of all texts; it counts only if the bucket is in more toxic texts than
chance explains (`MIN_Z` standard deviations). A word takes the best score of its buckets, or a small
negative one, so that the expected score of an ordinary word is negative.

A scan in linear time finds every maximal segment of a text, that is each passage whose score nothing
around or inside it beats. As in sequence alignment, the chance that n ordinary words hold a segment of
score S or more is 1 - exp(-K n exp(-lambda S)); lambda solves sum(p exp(lambda s)) = 1 over ordinary words.
A text's evidence is the summed surprise of its significant segments, and a logistic curve fitted on
the labelled texts makes a probability of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import NO_ALNUM, U64, narrow, pieces, rows_with_ids, words
from tidemark.session import stage

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
PRIOR_TEXTS = 4.0  # weight of the prior, in texts
MIN_Z = 5.0
MIN_TEXTS = 4
MIN_LIFT = 2.0  # bits
MISS = -0.35
SCORE_BINS = 16 * 4
K = 0.2
CURVE_BINS = 64


class Model(NamedTuple):
    scores: np.ndarray  # by bucket
    decay: float  # lambda
    slope: float
    offset: float


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(44)).astype(np.int64) & (BUCKETS - 1)


def _features(h: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text's words and their beginnings."""
    return np.unique(_bucket(h[h != 0]))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, label) of all labelled texts, written once."""
    known = narrow(labels, id_col, label_col).toDF("id", "label")
    known = known.where("id is not null and label in (0, 1)")
    known = known.select("id", F.col("label").cast("int").alias("label")).distinct()
    texts = narrow(docs, id_col, text_col).toDF("id", "text")
    return stage(rows_with_ids(texts, known).select("text", "label"), "labelled")


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), from left to right, in linear time.

    Only positive scores open a candidate. Each candidate knows the sum before it and up to its end; a new
    one joins back to the last candidate with a lower sum before it, if that one's end lies lower too.
    """
    at = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, before, after, earlier
    for i in at.tolist():
        start, end, before, after = i, i + 1, sums[i], sums[i + 1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, end, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(hi - lo)) for a, b, lo, hi, _ in stack]


def surprise(score: float, n: int, decay: float) -> float:
    """-log of the chance that `n` ordinary words hold such a segment."""
    x = np.log(K * max(n, 1)) - decay * score
    # log(1 - exp(-exp(x))), also where exp(x) is tiny
    return float(-x) if x < -20 else float(-np.log(-np.expm1(-np.exp(min(x, 30.0)))))


def evidence(model: Model, values: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed surprise of the segments that have less than an even chance, and these segments."""
    found = [
        (a, b, surprise(s, len(values), model.decay)) for a, b, s in segments(values)
    ]
    found = [f for f in found if f[2] > np.log(2)]
    return sum(f[2] for f in found), found


def class_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many labelled texts of each class a bucket occurs, and the number of texts of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, body, begins in pieces(batch.column(0)):
                h, _, _, first = words(body, begins, NO_ALNUM, PREFIXES)
                for c, a, b in zip(label[lo:hi], first, first[1:]):
                    sums[c][_features(h[a:b])] += 1
                    texts[c] += 1
        for c in (0, 1):
            at = np.flatnonzero(sums[c])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(at, -1)),
                    pa.array(np.full(len(at) + 1, c, np.int32)),
                    pa.array(np.append(sums[c][at], texts[c])),
                ],
                names=["bucket", "label", "n"],
            )

    counted = labelled.mapInArrow(run, "bucket long, label int, n long")
    # At most two rows a bucket, whatever the amount of text.
    table = counted.groupBy("bucket", "label").agg(F.sum("n").alias("n")).toArrow()
    counts, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    bucket, label, n = (table[c].to_numpy() for c in ("bucket", "label", "n"))
    real = bucket >= 0
    counts[label[real], bucket[real]] = n[real]
    texts[label[~real]] = n[~real]
    return counts, texts


def bucket_scores(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Log-odds ratios in bits where they are clearly above zero, else `MISS`."""
    both = counts.sum(axis=0)
    share = texts[1] / texts.sum()
    alpha = both / texts.sum() * PRIOR_TEXTS + 1e-3
    rate = (counts + alpha) / (texts[:, None] + PRIOR_TEXTS + 2e-3)
    bits = np.log2(rate[1] / (1 - rate[1])) - np.log2(rate[0] / (1 - rate[0]))
    z = (counts[1] - share * both) / np.sqrt(np.maximum(share * (1 - share) * both, 1e-9))
    sure = (z >= MIN_Z) & (bits >= MIN_LIFT) & (counts[1] >= MIN_TEXTS)
    return np.where(sure, np.minimum(bits, 12), MISS).astype(np.float32)


def decay_of(scores: np.ndarray, weight: np.ndarray) -> float:
    """The positive lambda with sum(p exp(lambda s)) = 1 for scores with these weights, by bisection."""
    p = weight / max(weight.sum(), 1)
    if not (p[scores > 0] > 0).any():
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (lo, mid)
    return lo


def _values(model: Model, body: np.ndarray, begins: np.ndarray):
    h, start, end, first = words(body, begins, NO_ALNUM, PREFIXES)
    best = model.scores[_bucket(h[:, 0])]
    for k in range(1, h.shape[1]):
        np.maximum(best, np.where(h[:, k] != 0, model.scores[_bucket(h[:, k])], MISS), out=best)
    return best, start, end, first


def _histogram(labelled: DataFrame, model: Model, bins: int, of) -> np.ndarray:
    """Counts by class and bin over all labelled texts; `of` gives the bins of a run of texts and their rows.

    Each task sends one row a class and bin, so what comes to the driver has a fixed size.
    """
    held = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sums = np.zeros((2, bins), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, body, begins in pieces(batch.column(0)):
                at, row = of(model, body, begins)
                np.add.at(sums, (label[lo:hi][row], at), 1)
        c, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[c, at])],
            names=["label", "bin", "n"],
        )

    counted = labelled.mapInArrow(run, "label int, bin int, n long")
    table = counted.groupBy("label", "bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, bins))
    out[table["label"].to_numpy(), table["bin"].to_numpy()] = table["n"].to_numpy()
    return out


def _score_bins(model: Model, body: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, _, _, first = _values(model, body, begins)
    at = np.where(values > 0, np.minimum(4 * values, SCORE_BINS - 2) + 1, 0).astype(np.int64)
    return at, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _evidence_bins(model: Model, body: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.array(list(_evidence_of(model, body, begins)))
    return np.minimum(4 * np.log1p(found), CURVE_BINS - 1).astype(np.int64), np.arange(len(found))


def fit_curve(counts: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over binned evidence, by Newton's method."""
    x = (np.arange(CURVE_BINS) + 0.5) / 4
    x[0] = 0
    both = counts.sum(axis=0) / max(counts.sum(), 1)
    toxic = counts[1] / max(counts.sum(), 1)
    slope, offset = 0.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        w = both * p * (1 - p)
        hess = np.array([[(w * x * x).sum(), (w * x).sum()], [(w * x).sum(), w.sum()]])
        hess += 1e-4 * np.eye(2)
        gap = both * p - toxic
        step = np.linalg.solve(hess, [(gap * x).sum() + 1e-4 * slope, gap.sum() + 1e-4 * offset])
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -1, 1)
    return float(max(slope, 0.0)), float(offset)


def _evidence_of(model: Model, body: np.ndarray, begins: np.ndarray) -> Iterator[float]:
    values, _, _, first = _values(model, body, begins)
    hits = np.concatenate([[0], np.cumsum(values > 0)])
    for a, b in zip(first, first[1:]):
        yield evidence(model, values[a:b])[0] if hits[b] > hits[a] else 0.0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Learn from all labelled texts of `docs`; labels other than 0 and 1 are not used."""
    labelled = _labelled(docs, labels, id_col, text_col, label_col)
    counts, texts = class_counts(labelled)
    if not texts[1] or not texts[0]:
        # One class only: its share is all there is to know.
        return Model(np.full(BUCKETS, MISS, np.float32), 1.0, 0.0, 3.0 if texts[1] else -3.0)
    model = Model(bucket_scores(counts, texts), 1.0, 1.0, 0.0)
    of_words = _histogram(labelled, model, SCORE_BINS, _score_bins)[0]
    middle = np.append(MISS, (np.arange(SCORE_BINS - 1) + 0.5) / 4)
    model = model._replace(decay=decay_of(middle, of_words))
    slope, offset = fit_curve(_histogram(labelled, model, CURVE_BINS, _evidence_bins))
    return model._replace(slope=slope, offset=offset)


def probability(model: Model, found: float) -> float:
    x = model.slope * np.log1p(found) + model.offset
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3
) -> DataFrame:
    """One row per document: doc_id, score, predicted, passages.

    `passages` lists the significant segments: first byte, byte behind the last, surprise. Texts that are NULL,
    empty or without a toxic word have none and share the lowest score. Repeated rows each get a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surprise", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                values, start, end, first = _values(model, body, begins)
                hits = np.concatenate([[0], np.cumsum(values > 0)])
                probs, lists = [], []
                for row, (a, b) in enumerate(zip(first, first[1:])):
                    total, found = evidence(model, values[a:b]) if hits[b] > hits[a] else (0.0, [])
                    probs.append(probability(model, total))
                    zero = begins[row]
                    lists.append(
                        [
                            dict(start=int(start[a + x] - zero), end=int(end[a + y - 1] - zero), surprise=s)
                            for x, y, s in found
                        ]
                    )
                probs = np.array(probs)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(probs),
                        pa.array((probs >= threshold).astype(np.int32)),
                        pa.array(lists, passage),
                    ],
                    names=["doc_id", "score", "predicted", "passages"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *T.StructType.fromDDL(
                "score double, predicted int, "
                "passages array<struct<start: long, end: long, surprise: double>>"
            ),
        ]
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)
