"""Quality classifier: a byte-level convolutional network in numpy.

A text is read as bytes in overlapping chunks that cover all of it. In each chunk `FILTERS` learned filters of
four bytes slide over byte embeddings and over one more input plane that marks bytes whose next eight
bytes stood there up to 40 bytes before (a filter alone can't see a repetition). Each filter's largest
response in the chunk goes through a small dense layer, the chunks of a text are averaged, and a
logistic unit makes one probability of it.

The network is fitted in the driver on a bounded sample: up to `SAMPLE` labelled texts (`most` of `train`), half of
each label as far as there are any. Both fitting and scoring read every chunk of a text; fitting does so in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import narrow, numbered, pieces

HALF = 128  # a chunk is two halves; neighbours share one
WIDTH = 4
FILTERS = 16
HIDDEN = 8
EMBED = 8
ECHO_LAGS = 40
ECHO_BYTES = 8
SAMPLE = 2000
STEPS = 320  # of 64 texts each, at least; whole passes over the sample
BLOCK = 1 << 15  # bytes per step, a multiple of HALF
FIT_HALVES = 1024  # halves of chunks that fitting looks at in one go


class Network(NamedTuple):
    first: np.ndarray  # responses to the first two bytes of a filter, by pair
    last: np.ndarray  # to the other two
    echo: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: float


def echoes(data: np.ndarray) -> np.ndarray:
    """Whether the eight bytes from each position stood there 1 to `ECHO_LAGS` bytes before."""
    found = np.zeros(len(data), bool)
    if len(data) <= ECHO_BYTES:
        return found
    code = data.astype(np.uint64)
    for step in (1, 2, 4):
        code = code[:-step] | (code[step:] << np.uint64(8 * step))
    for lag in range(1, min(ECHO_LAGS, len(code) - 1) + 1):
        found[lag : len(code)] |= code[lag:] == code[:-lag]
    return found


def _halves(net: Network, data: np.ndarray) -> np.ndarray:
    """Largest response of each filter in every half, before the bias."""
    out = []
    n = max(len(data), 1)
    echo = echoes(data)
    padded = np.zeros(n + WIDTH - 1, np.uint8)
    padded[: len(data)] = data
    for lo in range(0, n, BLOCK):
        hi = min(lo + BLOCK, n)
        part = padded[lo : hi + WIDTH - 1].astype(np.uint16)
        pair = (part[:-1] << np.uint16(8)) | part[1:]
        seen = np.take(net.first, pair[: hi - lo], axis=0)
        seen += np.take(net.last, pair[2 : 2 + hi - lo], axis=0)
        marked = np.flatnonzero(echo[lo:hi])
        seen[marked] += net.echo
        out.append(np.maximum.reduceat(seen, np.arange(0, hi - lo, HALF), axis=0))
    return np.concatenate(out)


def score_text(net: Network, data: np.ndarray) -> float:
    half = _halves(net, data)
    chunk = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
    hidden = np.tanh(np.maximum(chunk + net.bias, 0) @ net.dense + net.dense_bias)
    logit = float(hidden.mean(axis=0) @ net.out + net.out_bias)
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


class Sample(NamedTuple):
    """A labelled text as fitting reads it: all its bytes in pairs, padded to whole halves."""

    label: int
    pairs: np.ndarray  # two bytes from each position
    echo: np.ndarray
    size: int  # positions of the text, at least one

    @property
    def halves(self) -> int:
        return len(self.echo) // HALF

    @classmethod
    def of(cls, label: int, data: np.ndarray) -> Sample:
        size = max(len(data), 1)
        n = -(-size // HALF) * HALF
        padded = np.zeros(n + WIDTH - 1, np.uint16)
        padded[: len(data)] = data
        echo = np.zeros(n, bool)
        echo[: len(data)] = echoes(data)
        return cls(label, (padded[:-1] << np.uint16(8)) | padded[1:], echo, size)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> list[Sample]:
    """A sample of at most `most` labelled texts, whole, in the driver.

    The sample goes by a hash of the id, so it is the same in every run. Both labels get half of it;
    what one label can't fill the other may.
    """
    known = narrow(labels, id_col, label_col).toDF("_id", "_label").where("_id is not null and _label in (0, 1)")
    known = known.select("_id", F.col("_label").cast("int").alias("_label")).distinct()
    order = [F.xxhash64("_id"), F.col("_id"), F.col("_label")]
    per = {v: known.where(F.col("_label") == v).orderBy(*order).limit(most) for v in (0, 1)}
    have = {v: df.count() for v, df in per.items()}
    share = {v: min(have[v], max(most // 2, most - have[1 - v])) for v in (0, 1)}
    chosen = per[0].limit(share[0]).unionByName(per[1].limit(share[1]))
    texts = narrow(docs, id_col, text_col).toDF("_id", "_text")
    # At most `most` ids: bounded by the parameter.
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text")

    got = rows.orderBy(F.xxhash64("_id"), "_text").limit(most).collect()
    return [Sample.of(r["_label"], np.frombuffer((r["_text"] or "").encode(), np.uint8)) for r in got]


def fit(sample: list[Sample], share_of_one: float | None = None, steps: int = STEPS, seed: int = 3) -> Network:
    """Adam on the logistic loss. Without both labels the network says 1 (or the only label)."""
    rng = np.random.default_rng(seed)
    table = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "filters": rng.normal(0, 0.5, (WIDTH, EMBED, FILTERS)),
        "echo": rng.normal(0, 0.5, FILTERS),
        "bias": np.zeros(FILTERS),
        "dense": rng.normal(0, 0.4, (FILTERS, HIDDEN)),
        "dense_bias": np.zeros(HIDDEN),
        "out": rng.normal(0, 0.4, HIDDEN),
        "out_bias": np.zeros(1),
    }
    table = {k: v.astype(np.float32) for k, v in table.items()}
    target = np.array([s.label for s in sample], np.float32)
    if len(sample) == 0 or target.min() == target.max():
        table["out"][:] = 0
        table["out_bias"][:] = 3 if len(sample) == 0 or target[0] == 1 else -3
        return _tables(table, 0.0)
    first = {k: np.zeros_like(v) for k, v in table.items()}
    second = {k: np.zeros_like(v) for k, v in table.items()}
    step, epochs = 0, -(-steps // -(-len(sample) // 64))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(sample))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            slopes = _gradients(table, [sample[r] for r in rows], target[rows])
            step += 1
            for k, g in slopes.items():
                g = g + 1e-4 * table[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                table[k] = (table[k] - rate * change).astype(np.float32)
    # The sample holds both labels alike; move the threshold back to how they really are.
    shift = 0.0
    if share_of_one is not None:
        real, here = (np.clip(s, 0.01, 0.99) for s in (share_of_one, target.mean()))
        shift = float(np.log(real / (1 - real)) - np.log(here / (1 - here)))
    return _tables(table, shift)


def _byte_tables(table: dict) -> np.ndarray:
    return np.einsum("be,wef->wbf", table["embed"], table["filters"]).astype(np.float32)


def _strongest(table: dict, rows: list[Sample]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each half and filter the largest response and the bytes and the echo at its place: (halves, filters).

    Looks at `FIT_HALVES` halves in one go, so a long text needs no more memory than its own bytes and a few
    numbers for each half.
    """
    b = _byte_tables(table)
    first = (b[0][:, None, :] + b[1][None, :, :]).reshape(-1, FILTERS)
    last = (b[2][:, None, :] + b[3][None, :, :]).reshape(-1, FILTERS)
    out = []
    for r in rows:
        for lo in range(0, r.halves, FIT_HALVES):
            hi = min(lo + FIT_HALVES, r.halves)
            one, two = r.pairs[lo * HALF : hi * HALF], r.pairs[lo * HALF + 2 : hi * HALF + 2]
            echo = r.echo[lo * HALF : hi * HALF]
            seen = np.take(first, one, axis=0)
            seen += np.take(last, two, axis=0)
            seen[echo] += table["echo"]
            # Positions behind the end are not part of the text.
            seen[max(0, r.size - lo * HALF) :] = -1e9
            seen = seen.reshape(-1, HALF, FILTERS)
            top = seen.argmax(axis=1)
            place = np.arange(hi - lo)[:, None] * HALF + top
            value = np.take_along_axis(seen, top[:, None, :], axis=1)[:, 0]
            out.append((value, one[place], two[place], echo[place]))
    value, one, two, echo = (np.concatenate(x) for x in zip(*out))
    return value, one, two, echo, b


def _gradients(table: dict, rows: list[Sample], target: np.ndarray) -> dict:
    value, one, two, echo, per_byte = _strongest(table, rows)
    # A chunk is two halves, the next one begins in the middle; a text of one half is one chunk.
    halves = np.array([r.halves for r in rows])
    count = np.maximum(halves - 1, 1)
    doc = np.repeat(np.arange(len(rows)), count)
    begin = np.cumsum(halves) - halves
    left = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + begin[doc]
    right = left + (halves[doc] > 1)
    later = value[right] > value[left]
    pooled = np.where(later, value[right], value[left]) + table["bias"]
    one, two, echo = (np.where(later, x[right], x[left]) for x in (one, two, echo))
    active = np.maximum(pooled, 0)
    hidden = np.tanh(active @ table["dense"] + table["dense_bias"])
    mean = np.add.reduceat(hidden, np.cumsum(count) - count, axis=0) / count[:, None]
    logit = mean @ table["out"] + table["out_bias"]
    d_logit = ((1 / (1 + np.exp(-logit))) - target) / len(rows)
    d_hidden = (d_logit[:, None] * table["out"] / count[:, None])[doc] * (1 - hidden**2)
    d_pooled = (d_hidden @ table["dense"].T) * (pooled > 0)
    d_byte = np.zeros_like(per_byte)
    column = np.arange(FILTERS)[None, :]
    for j, pair in enumerate((one >> 8, one & 255, two >> 8, two & 255)):
        flat = (pair.astype(np.int64) * FILTERS + column).ravel()
        d_byte[j] = np.bincount(flat, d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    return {
        "embed": np.einsum("wbf,wef->be", d_byte, table["filters"]),
        "filters": np.einsum("wbf,be->wef", d_byte, table["embed"]),
        "echo": (d_pooled * echo).sum(axis=0),
        "bias": d_pooled.sum(axis=0),
        "dense": active.T @ d_hidden,
        "dense_bias": d_hidden.sum(axis=0),
        "out": mean.T @ d_logit,
        "out_bias": np.array([d_logit.sum()]),
    }


def _tables(table: dict, shift: float) -> Network:
    b = _byte_tables(table)
    return Network(
        (b[0][:, None, :] + b[1][None, :, :]).reshape(-1, FILTERS),
        (b[2][:, None, :] + b[3][None, :, :]).reshape(-1, FILTERS),
        table["echo"],
        table["bias"],
        table["dense"],
        table["dense_bias"],
        table["out"],
        float(table["out_bias"][0]) + shift,
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most: int = SAMPLE,
) -> Network:
    """Fit the network on the labelled texts of `docs`. Labels other than 0 and 1 are not used."""
    shares = narrow(labels, label_col).toDF("v").where("v in (0, 1)").agg(F.avg("v")).first()[0]
    return fit(labelled_texts(docs, labels, id_col, text_col, label_col, most), shares)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score (probability of label 1), predicted.

    NULL and empty texts are scored as one chunk of padding. Repeated rows each get a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                probs = np.array([score_text(net, body[a:b]) for a, b in zip(begins, begins[1:])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(probs),
                        pa.array((probs >= 0.5).astype(np.int32)),
                    ],
                    names=["doc_id", "score", "predicted"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *T.StructType.fromDDL("score double, predicted int"),
        ]
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


def keep_good(
    docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The documents with a score of at least `threshold`, all columns, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(at)):
                good = [score_text(net, body[a:b]) >= threshold for a, b in zip(begins, begins[1:])]
                yield batch.slice(lo, hi - lo).filter(pa.array(good, pa.bool_()))

    return numbered(docs).mapInArrow(run, docs.schema)
