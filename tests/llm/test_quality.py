import numpy as np
import pytest

from tests.llm.helpers import ODD, documents, labels, sentence
from tidemark.llm import queries, quality

SF = "/root/testdata/sf0.01"


def as_bytes(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_held_out_accuracy(spark):
    got = queries.op1_quality(spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.where("held_out").join(known, "doc_id").select("predicted", "quality", "score").collect()
    assert len(rows) > 90
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def plain_score(net, data):
    """The same network, position by position."""
    raw = bytes(data) or b"\0"
    echo = quality.echoes(data)
    padded = raw + bytes(quality.WIDTH - 1)
    seen = np.array(
        [
            net.first[padded[i] * 256 + padded[i + 1]]
            + net.last[padded[i + 2] * 256 + padded[i + 3]]
            + (net.echo if i < len(data) and echo[i] else 0)
            for i in range(len(raw))
        ]
    )
    step = quality.HALF
    starts = list(range(0, max(len(raw) - step, 1), step))
    chunks = [seen[s : s + 2 * step].max(axis=0) for s in starts]
    hidden = np.tanh(np.maximum(np.array(chunks) + net.bias, 0) @ net.dense + net.dense_bias)
    return 1 / (1 + np.exp(-(hidden.mean(axis=0) @ net.out + net.out_bias)))


@pytest.mark.parametrize("n", [0, 1, 3, 127, 128, 129, 256, 300, 385, 5000])
def test_score_covers_the_whole_text(monkeypatch, n):
    rng = np.random.default_rng(n)
    sample = [quality.Sample.of(k % 2, rng.integers(0, 256, 400, dtype=np.uint8)) for k in range(8)]
    net = quality.fit(sample, steps=2)
    data = rng.integers(97, 100, n, dtype=np.uint8)
    monkeypatch.setattr(quality, "BLOCK", 1024)
    assert quality.score_text(net, data) == pytest.approx(plain_score(net, data), rel=1e-4)


def test_echoes():
    text = as_bytes("abcdefgh abcdefgh xyz")
    found = quality.echoes(text)
    assert found[9] and found.sum() == 2  # "abcdefgh" and "bcdefgh "
    assert not quality.echoes(as_bytes("short")).any()


def test_odd_documents(spark):
    docs = documents(spark)
    known = labels(spark, [(1, 1, 0), (6, 0, 0), (7, None, None), (99, 1, 0), (None, 1, 0), (12, 1, 0), (12, 1, 0)])
    net = quality.train(docs, known)
    got = quality.score(docs, net).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    kept = quality.keep_good(docs, net)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.score >= 0.5 for r in got)


def test_nothing_to_learn_from(spark):
    docs = documents(spark)
    net = quality.train(docs, labels(spark, []))
    assert all(r.predicted == 1 for r in quality.score(docs, net).collect())
    net = quality.train(docs, labels(spark, [(1, 0, 0)]))
    assert all(r.predicted == 0 for r in quality.score(docs, net).collect())
    assert quality.score(documents(spark, []), net).count() == 0


def test_sample_is_bounded(spark):
    docs = documents(spark, [(i, sentence(i, 900), "en") for i in range(30)], extra=False)
    known = labels(spark, [(i, int(i % 3 == 0), 0) for i in range(30)])
    known = known.select("doc_id", "quality")
    sample = quality.labelled_texts(docs, known, "doc_id", "text", "quality", 12)
    assert len(sample) == 12 and sum(s.label for s in sample) == 6
    # The texts are whole.
    whole = {len(sentence(i, 900).encode()) for i in range(30)}
    assert {s.size for s in sample} <= whole and all(s.halves == -(-s.size // quality.HALF) for s in sample)


def loss(table, rows, target):
    """The loss by scoring, text by text."""
    net = quality._tables(table, 0.0)
    out = 0.0
    for r, t in zip(rows, target):
        data = (r.pairs >> 8).astype(np.uint8)[: r.size]
        p = quality.score_text(net, data)
        out -= np.log(p if t else 1 - p) / len(rows)
    return out


def test_gradients_are_the_slopes_of_the_loss(monkeypatch):
    """Texts of one half, of several, with and without repeated bytes; also when they are read in small blocks."""
    rng = np.random.default_rng(5)
    sizes = [1, 60, 128, 129, 300, 700]
    rows = [quality.Sample.of(k % 2, rng.integers(97, 110 if k % 3 else 99, n, dtype=np.uint8)) for k, n in enumerate(sizes)]
    target = np.array([r.label for r in rows], np.float64)
    shapes = {
        "embed": (256, quality.EMBED), "filters": (quality.WIDTH, quality.EMBED, quality.FILTERS), "echo": (quality.FILTERS,),
        "bias": (quality.FILTERS,), "dense": (quality.FILTERS, quality.HIDDEN), "dense_bias": (quality.HIDDEN,),
        "out": (quality.HIDDEN,), "out_bias": (1,),
    }
    table = {k: rng.normal(0, 0.5, s) for k, s in shapes.items()}
    # Exact enough for differences.
    monkeypatch.setattr(quality, "_byte_tables", lambda t: np.einsum("be,wef->wbf", t["embed"], t["filters"]))
    slopes = quality._gradients(table, rows, target)
    monkeypatch.setattr(quality, "FIT_HALVES", 2)
    assert all(np.allclose(g, slopes[k]) for k, g in quality._gradients(table, rows, target).items())
    for name, slope in slopes.items():
        for place in rng.choice(np.flatnonzero(slope), min(4, np.count_nonzero(slope)), replace=False):
            step = np.zeros(slope.size)
            step[place] = 1e-5
            up, down = ({**table, name: table[name] + sign * step.reshape(slope.shape)} for sign in (1, -1))
            wanted = (loss(up, rows, target) - loss(down, rows, target)) / 2e-5
            assert slope.ravel()[place] == pytest.approx(wanted, rel=1e-3, abs=1e-7), (name, place)


def test_a_defect_between_evenly_spaced_chunks_is_learned():
    """A stretch of a tenth of the text, where none of six evenly spaced chunks would be."""
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, int(rng.integers(2, 8)), dtype=np.uint8)) for _ in range(60)]
    rows = []
    for k in range(320):
        data = np.frombuffer(b" ".join(words[i] for i in rng.integers(0, 60, 1200))[:5000], np.uint8).copy()
        if k % 2 == 0:
            at = int(rng.choice([1200, 2200, 3100, 4150]))
            data[at : at + 600] = rng.integers(33, 48, 600, dtype=np.uint8)
        rows.append((k % 2, data))
    net = quality.fit([quality.Sample.of(*r) for r in rows[:240]], 0.5)
    right = [(quality.score_text(net, data) >= 0.5) == bool(label) for label, data in rows[240:]]
    assert np.mean(right) > 0.9
