import numpy as np
import pytest

import corpus_pipeline
from tests.llm.helpers import ODD, documents, hit_words, sentence
from tidemark.llm import decontaminate

LONG = sentence(50, 60)
ITEMS = [
    (1, LONG),
    (2, sentence(51, 13)),
    (3, "tiny item"),
    (4, "single"),
    (5, ""),
    (6, None),
    (None, sentence(52, 20)),
    (10, LONG),
    (11, " ".join(LONG.split()[30:50])),
]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def cases():
    w = LONG.split()
    rows = [(i, t) for i, t, _ in ODD]
    rows += [
        (100, LONG),
        (101, sentence(60, 200) + " " + " ".join(w[5:18]) + " " + sentence(61, 40)),
        (102, sentence(60, 20) + " " + " ".join(w[5:17])),
        (103, ", ".join(w[:13]).upper() + " tiny -- ITEM single"),
        (104, sentence(52, 20)),
        (105, (" ".join(w[10:40]) + " stop ") * 3),
        (106, "single " * 30),
        (107, sentence(60, 2000) + " " + LONG),
    ]
    return rows


def test_against_all_windows(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.contamination(docs, items(spark)).collect()
    found = sorted(((r.doc_id, r.n_words, r.n_hit, r.items, r.contaminated) for r in got), key=str)
    want = []
    for i, t in rows:
        n, hit, ids = hit_words(t, ITEMS)
        want.append((i, n, hit, ids, hit > 0 and 20 * hit >= n))
    assert found == sorted(want, key=str)
    assert sum(r.contaminated for r in got) >= 6


def test_every_long_enough_span_shares_a_print():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, 60).astype(np.uint64), rng.integers(0, 6, 60).astype(np.uint64)
        b[20:33] = a[7:20]
        one = decontaminate.winnow(decontaminate.grams(a, 5), 9)
        two = decontaminate.winnow(decontaminate.grams(b, 5), 9)
        assert any(7 <= p <= 15 and p + 13 in two for p in one)


def test_winnow_takes_the_rightmost_of_equals():
    g = np.array([5, 1, 1, 7, 9, 9, 2], np.uint64)
    assert list(decontaminate.winnow(g, 3)) == [2, 3, 6]
    assert len(decontaminate.winnow(g, 8)) == 0


@pytest.mark.parametrize("rows, left", [([], len(ODD)), (ITEMS, len(ODD))])
def test_drop_keeps_columns(spark, rows, left):
    docs = documents(spark)
    kept = decontaminate.drop_contaminated(docs, items(spark, rows))
    assert kept.schema == docs.schema and kept.count() == left


def test_contaminated_documents_go(spark):
    docs = documents(spark, [(1, LONG, "en"), (2, sentence(70, 50), "en"), (None, LONG, "en"), (None, "x", "en")])
    kept = decontaminate.drop_contaminated(docs, items(spark))
    # Rows without an id are judged together.
    assert [r.doc_id for r in kept.collect()] == [2]


def test_pipeline_judges_each_row_by_itself(spark, tmp_path):
    """Clean rows stay though a contaminated one has their id, or none as they have."""
    items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(1, sentence(70, 50)), (None, "x"), (None, sentence(71, 50)), (None, None), (None, "")]
    rows = clean + [(1, LONG), (None, LONG), (None, LONG), (3, LONG)]
    docs = documents(spark, [(i, t, "en") for i, t in rows])
    kept = corpus_pipeline.drop_benchmark(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_documents(spark):
    assert decontaminate.contamination(documents(spark, []), items(spark)).count() == 0
