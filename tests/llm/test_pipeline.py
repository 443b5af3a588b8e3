import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.helpers import SF, documents, groups, hit_words, private_spans
from tidemark.llm import bpe, quality
from tidemark.llm.common import remainder
from tidemark.llm.oracles import ORACLES


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_against_sql(spark, name):
    rows, wrong = compare(spark, connect(SF), name, SF)
    assert not wrong and rows > 0


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(remainder("doc_id", 3) != 1)
    net = quality.train(docs, labels)
    rows = [r for r in rows if quality.score_text(net, np.frombuffer(r.text.encode(), np.uint8)) >= 0.5]
    named = groups([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r in rows if named[r.doc_id] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [r for r in rows if (lambda n, hit, _: not (hit and 20 * hit >= n))(*hit_words(r.text, items))]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows}
    tok = bpe.Tokenizer(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    for r in rows:
        text = tok.decode(got[r.doc_id].ids).decode()
        assert got[r.doc_id].round_trip and got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
        assert (got[r.doc_id].lang, got[r.doc_id].source) == (r.lang, r.source)
        if not private_spans(r.text):
            assert text == r.text or "<" in text
        else:
            assert not private_spans(text)


def test_stages_keep_the_columns_of_odd_documents(spark):
    docs = documents(spark)
    for name, apply in corpus_pipeline.STAGES[:-1]:
        out = apply(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        assert apply(spark, documents(spark, []), SF).count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, documents(spark), SF)
    assert all(r.round_trip for r in last.collect())


def test_the_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
