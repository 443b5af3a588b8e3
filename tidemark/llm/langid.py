"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lowered and read as code points; every run of one to three of them is hashed into one of
`buckets` buckets. The model is one matrix of log probabilities, languages by buckets, so its size is
known beforehand whatever the amount of text. A batch of texts is scored as a sparse product: the rows
of the matrix at the hashes of all n-grams of the batch, summed from document to document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import narrow, pieces

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
UNKNOWN = "und"
# The matrix is broadcast: languages x buckets x 4 bytes must stay within this many bytes.
MODEL_BYTES = 128_000_000
BLOCK = 1 << 17


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # buckets x languages, log P(bucket | language)
    prior: np.ndarray


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    import unicodedata

    return np.frombuffer(
        bytes(unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool
    )


_letter_table: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letter_table:
        _letter_table.append(_letters())
    return _letter_table[0][codes]


def code_points(body: np.ndarray) -> np.ndarray:
    """Code points of lowered text. Bytes that aren't UTF-8 count as U+FFFD."""
    text = body.tobytes().decode("utf-8", "replace").lower()
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _hashes(codes: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """Bucket of every n-gram, order by order. All n-grams with their starts in `codes`."""
    mask = np.uint32(buckets - 1)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    h = np.zeros(len(codes), np.uint32)
    for n in ORDERS:
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        yield ((h * np.uint32(0x9E3779B1)) >> shift) & mask


def _blocks(codes: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
    """A text in overlapping blocks that hold every n-gram once, seen from where it begins."""
    more = max(ORDERS) - 1
    for lo in range(0, len(codes), BLOCK):
        yield codes[lo : lo + BLOCK + more], lo + BLOCK < len(codes)


def bucket_counts(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Number of n-grams of a text by bucket."""
    out = np.zeros(buckets, np.int64)
    for block, goes_on in _blocks(codes):
        for h in _hashes(block, buckets):
            out += np.bincount(h[:BLOCK] if goes_on else h, minlength=buckets)
    return out


def train(labelled: DataFrame, text_col: str, lang_col: str, buckets: int = BUCKETS) -> Model:
    """Counts of all labelled texts, combined within each task before they meet.

    Rows with NULL text or language are not used. The prior of a language is its share of the texts.
    """
    given = narrow(labelled, text_col, lang_col).toDF("text", "lang").dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, _, body, begins in pieces(batch.column(0)):
                for i, (a, b) in enumerate(zip(begins, begins[1:])):
                    lang = langs[lo + i]
                    if lang not in sums:
                        sums[lang] = np.zeros(buckets, np.int64)
                    texts[lang] = texts.get(lang, 0) + 1
                    sums[lang] += bucket_counts(code_points(body[a:b]), buckets)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1), pa.string()),
                    pa.array(np.append(at, -1).astype(np.int32)),
                    pa.array(np.append(counts[at], texts[lang])),
                ],
                names=["lang", "bucket", "n"],
            )

    counted = given.mapInArrow(run, "lang string, bucket int, n long")
    total = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(r[0] for r in given.select("lang").distinct().collect())
    if len(langs) * buckets * 4 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages: the model would not fit {MODEL_BYTES} bytes")
    table = total.toArrow()
    row = {lang: i for i, lang in enumerate(langs)}
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    of = np.array([row[x] for x in table["lang"].to_pylist()], np.int64)
    counts = np.zeros((len(langs), buckets))
    grams = bucket >= 0
    counts[of[grams], bucket[grams]] = n[grams]
    prior = np.zeros(len(langs))
    prior[of[~grams]] = n[~grams]
    weights = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets))
    return Model(langs, weights.T.astype(np.float32).copy(), np.log(prior / max(prior.sum(), 1)))


def scores(model: Model, codes: np.ndarray) -> np.ndarray:
    """Log P(language) + log P(text | language)."""
    out = model.prior.astype(np.float64).copy()
    for block, goes_on in _blocks(codes):
        for h in _hashes(block, len(model.weights)):
            at = h[:BLOCK] if goes_on else h
            out += np.take(model.weights, at, axis=0).sum(axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    `score` is the probability of the language among the learned ones. A text that is NULL, or has no
    letter, or meets a model without languages, is `und` with score 0. Of equally likely languages
    the first by name is taken. Repeated rows each get a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1)):
                names, probs = [], []
                for a, b in zip(begins, begins[1:]):
                    codes = code_points(body[a:b])
                    if not model.langs or not _is_letter(codes).any():
                        names.append(UNKNOWN)
                        probs.append(0.0)
                        continue
                    s = scores(model, codes)
                    best = int(np.argmax(s))
                    names.append(model.langs[best])
                    probs.append(float(1 / np.exp(s - s[best]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(probs, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            *T.StructType.fromDDL("lang_pred string, score double"),
        ]
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)
