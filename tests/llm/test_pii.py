import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, PRIVATE, documents, private_spans
from tidemark.llm import pii

TEXTS = [
    "a.b@c.d_e@f.g",
    "x@y.z.",
    "@a.b a@b a@b. a@.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004",
    "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (415) 555-0100, +49 30 12, +12345678901234567",
    "ééé 🙂 a@b.cd 🙂 10.0.0.1",
    "a" * 50_000,
    "1-" * 20_000 + "1",
    "a@" * 10_000,
    "9.9.9.9 " * 3_000,
    "+" * 5_000 + "1 2",
]


def fuzz(n):
    rnd = random.Random(2)
    alphabet = [*"ab.@-_+ 0123456789().%\nZé🙂", "4111 1111 1111 1111", "1.2.3.4", "+1 (415) 555-0100", "a.b@c.d"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_against_plain_patterns(spark):
    texts = [t for _, t, _ in ODD] + TEXTS + fuzz(1500)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    for i, t in enumerate(texts):
        want = private_spans(t)
        listed = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), repr(t)[:80]
        assert set(listed) <= set(got[i].spans.split(","))
        for kind in PRIVATE:
            assert got[i][f"n_{kind}"] == sum(s[3] == kind for s in want)


@pytest.mark.parametrize(
    "text, want",
    [
        ("my iban: DE89 3704 0044 0532 0130 00.", "iban:9:36"),
        ("GB82WEST12345698765432", "iban:0:22"),
        ("GB82WEST12345698765433", ""),
        ("SSN 123-45-6789", "ssn:4:15"),
        ("no words near 123-45-6789", ""),
        ("SSN 000-45-6789", ""),
        ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "key:9:49"),
        ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", ""),
    ],
)
def test_added_kinds_need_checks_and_context(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.find(docs).select(pii.listed(F.col("spans")).alias("s")).first().s
    assert [s for s in spans.split(",") if s.split(":")[0] in ("iban", "ssn", "key")] == ([want] if want else [])


def test_context_raises_the_score(spark):
    docs = spark.createDataFrame([(1, "phone +1 415 555 0100"), (2, "xx +1 415 555 0100")], "doc_id long, text string")
    scores = {r.doc_id: r.spans[0].score for r in pii.find(docs).collect()}
    assert scores[1] > scores[2]


def test_mask(spark):
    docs = documents(spark, [(1, "a@b.cd x 10.0.0.1", "en"), (2, None, "en"), (3, "clean é", "en"), (4, "card 4111 1111 1111 1111", "en")])
    masked = pii.mask(docs)
    assert masked.schema == docs.schema
    got = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    assert got[1] == ("<EMAIL> x <IP>", 14) and got[2] == (None, None) and got[3] == ("clean é", 7)
    assert got[4][0] == "card <CARD>"
    assert pii.mask(documents(spark, [])).count() == 0


def test_running_sums_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEP", 4)
    sums = spark.range(1).select(pii._running(F.sequence(F.lit(1), F.lit(30))).alias("s")).first().s
    assert sums == [n * (n + 1) // 2 for n in range(1, 31)]


def test_no_python_in_the_plan(spark):
    plan = pii.digest(pii.find(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
