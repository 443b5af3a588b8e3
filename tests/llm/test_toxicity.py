import numpy as np
import pytest

from tests.llm.helpers import ODD, documents, labels, sentence
from tidemark.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def plain_segments(x, lo=0):
    """Best segment first, then left and right of it: the definition."""
    best = None
    for a in range(len(x)):
        total = 0.0
        for b in range(a, len(x)):
            total += x[b]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, total = best
    return plain_segments(x[:a], lo) + [(a + lo, b + lo, total)] + plain_segments(x[b:], lo + b)


def test_segments_against_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.choice([-0.37, -0.83, 1.21, 2.57], rng.integers(0, 25), p=[0.4, 0.3, 0.2, 0.1])
        x = x + rng.random(len(x)) / 1e3  # no ties
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(x)]
        assert got == [(a, b, round(s, 6)) for a, b, s in plain_segments(list(x))]


def test_decay_solves_the_equation():
    scores, weight = np.array([-0.35, 2.0, 5.0]), np.array([0.95, 0.04, 0.01])
    decay = toxicity.decay_of(scores, weight)
    assert (weight * np.exp(decay * scores)).sum() == pytest.approx(1, abs=1e-6)
    assert toxicity.decay_of(scores, np.array([1.0, 0, 0])) == 1.0


def test_surprise_grows_with_score_and_falls_with_length():
    x = [toxicity.surprise(s, 100, 1.0) for s in (1, 5, 20, 60)]
    assert x == sorted(x) and toxicity.surprise(10, 10, 1.0) > toxicity.surprise(10, 10_000, 1.0)


def test_held_out_labels(spark):
    got = queries.op6_toxicity(spark, SF)
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.where("held_out").join(known, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) > 50 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.04
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def planted():
    rows, known = [], []
    for i in range(120):
        bad = i % 3 == 0
        words = sentence(i, 60).split()
        if bad:
            words[20:22] = ["vile" + "abcdefgh"[i % 8], "rotten"]
        rows.append((i, " ".join(words), "en"))
        known.append((i, 1, int(bad)))
    return rows, known


def test_passages_point_at_the_words(spark):
    rows, known = planted()
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels(spark, known[:90]))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text, _ in rows[90:]:
        assert got[i].predicted == known[i][2]
        if known[i][2]:
            (p,) = got[i].passages
            assert text.encode()[p.start : p.end].decode().split()[-1] == "rotten"
            assert text.encode()[p.start : p.end].startswith(b"vile")


def test_odd_documents(spark):
    docs = documents(spark)
    known = labels(spark, [(1, 1, 1), (6, 1, 0), (7, 1, None), (None, 1, 1), (99, 1, 0), (8, 1, 0), (8, 1, 0)])
    got = toxicity.score(docs, toxicity.train(docs, known)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_one_class_or_none(spark):
    docs = documents(spark)
    model = toxicity.train(docs, labels(spark, []))
    assert not any(r.predicted for r in toxicity.score(docs, model).collect())
    model = toxicity.train(docs, labels(spark, [(1, 1, 1)]))
    assert all(r.predicted for r in toxicity.score(docs, model).collect())
    assert toxicity.score(documents(spark, []), model).count() == 0
