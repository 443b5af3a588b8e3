import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, letter_words, white_words
from tidemark.llm import common


def run_of(texts):
    column = pa.array(texts, pa.string())
    (piece,) = common.pieces(column, 1 << 40)
    return piece


def test_words_are_the_words():
    texts = [t for _, t, _ in ODD] + ["ab", "cd", "AB"]
    _, _, body, begins = run_of(texts)
    h, start, end, first = common.words(body, begins)
    raw = body.tobytes().lower()
    for i, t in enumerate(texts):
        assert [raw[start[k] : end[k]] for k in range(first[i], first[i + 1])] == white_words(t)
    assert h[first[-4]] == h[first[-2]] != h[first[-3]]


def test_letter_words():
    texts = ["It's 5é-漢 a_b", None, "x"]
    _, _, body, begins = run_of(texts)
    _, start, end, first = common.words(body, begins, common.NO_ALNUM)
    raw = body.tobytes().lower().decode
    got = [body.tobytes()[a:b].lower().decode() for a, b in zip(start, end)]
    assert got == [w for t in texts for w in letter_words(t)]
    assert callable(raw) and list(np.diff(first)) == [6, 0, 1]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    texts = ["a b cc ddd " * 50, "x" * 300 + " y", "cc ddd"]
    _, _, body, begins = run_of(texts)
    whole = common.words(body, begins)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    for a, b in zip(whole, common.words(body, begins)):
        assert (a == b).all()


def test_pieces_cover_all_rows():
    column = pa.array([t for _, t, _ in ODD] * 3, pa.string()).slice(2, 30)
    got = [
        body[a:b].tobytes().decode()
        for _, _, body, begins in common.pieces(column, 1000)
        for a, b in zip(begins, begins[1:])
    ]
    assert got == [t or "" for t in column.to_pylist()]
    assert list(common.pieces(column.slice(0, 0))) == []


def test_prefixes():
    _, _, body, begins = run_of(["abcdef abcdxy abc"])
    h, *_ = common.words(body, begins, common.WHITE, (4,))
    assert h[0, 1] == h[1, 1] != 0 and h[2, 1] == 0


def test_grams_need_enough_words():
    h = np.arange(5, dtype=np.uint64)
    assert len(common.grams(h, 6)) == 0 and len(common.grams(h, 5)) == 1


def test_rows_by_ids(spark):
    """Kept or dropped by an exact match; copies of rows stay copies; ids may be structs."""
    rows = [(k % 400, f"t{k}") for k in range(500)] + [(7, "t7")]
    docs = spark.createDataFrame(rows, "key long, id string")
    ids = spark.createDataFrame([(k,) for k in [*range(0, 90, 3), 7, 5000]], "id long")
    meant = {*range(0, 90, 3), 7}
    for has in (True, False):
        got = sorted(tuple(r) for r in common.rows_by_ids(docs, ids, "key", has).collect())
        assert got == sorted(r for r in rows if (r[0] in meant) == has)
        pair = lambda c: F.struct(F.col(c).alias("x"), F.lit("y").alias("y")).alias(c)
        named = common.rows_by_ids(docs.select(pair("key"), "id"), ids.select(pair("id")), "key", has)
        assert sorted((r.key.x, r.id) for r in named.collect()) == got
    assert common.rows_by_ids(docs, ids.limit(0), "key", False).count() == len(rows)
    assert common.rows_by_ids(docs, ids.limit(0), "key", True).count() == 0
