import numpy as np
import pytest

from tests.llm.helpers import ODD, documents
from tidemark.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op9_language(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 250 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def plain_counts(codes, buckets):
    out = np.zeros(buckets, np.int64)
    for h in langid._hashes(codes, buckets):
        np.add.at(out, h, 1)
    return out


@pytest.mark.parametrize("block", [1 << 17, 5, 8])
def test_blocks_hold_every_gram_once(monkeypatch, block):
    codes = langid.code_points("abc défg 漢字🙂 xyz abc".encode() and np.frombuffer("abc défg 漢字🙂 xyz abc".encode(), np.uint8))
    want = plain_counts(codes, 1 << 14)
    monkeypatch.setattr(langid, "BLOCK", block)
    assert (langid.bucket_counts(codes, 1 << 14) == want).all()
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(0, 1, (1 << 14, 2)).astype(np.float32), np.log([0.5, 0.5]))
    assert langid.scores(model, codes) == pytest.approx(model.prior + want @ model.weights.astype(float), rel=1e-5)


def test_odd_documents(spark):
    docs = documents(spark)
    model = langid.train(docs, "text", "lang")
    assert model.langs == ["de", "en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for i in (2, 3, 4, 5):
        assert got[i] == ("und", 0.0)
    assert got[6][0] == "fr"
    assert langid.predict(docs, model).count() == len(ODD)
    assert langid.predict(documents(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    model = langid.train(documents(spark, [(1, None, "en"), (2, "text", None)]), "text", "lang")
    assert model.langs == []
    assert {r.lang_pred for r in langid.predict(documents(spark), model).collect()} == {"und"}


def test_ties_go_to_the_first_name(spark):
    docs = documents(spark, [(1, "same text", "xx"), (2, "same text", "aa")])
    model = langid.train(docs, "text", "lang")
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"aa"}
