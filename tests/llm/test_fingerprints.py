import hashlib

import numpy as np
import pytest

from tests.llm.helpers import ODD, documents, sentence
from tidemark.llm import fingerprints as fp


def plain_kmers(text):
    """Occurrence-numbered k-mers."""
    seen, out, k = {}, [], min(fp.K, len(text))
    for i in range(len(text) - k + 1 if k else 0):
        gram = text[i : i + k]
        seen[gram] = seen.get(gram, -1) + 1
        out.append((gram, seen[gram]))
    return out


def test_kmers_are_numbered():
    for text in ("abcabcabcabc" * 5, "x" * 40, "é漢🙂ab", "a", "", sentence(1, 30)):
        hashes = fp.kmers(fp.code_points(text))
        want = plain_kmers(text)
        assert len(hashes) == len(want)
        assert len(set(hashes.tolist())) == len(set(want))


def plain_signs(h):
    take = min(fp.TUPLE, len(h))
    out = []
    for m, x in zip(fp._MULT, fp._XOR):
        seen = (h ^ x) * m
        seen ^= seen >> np.uint32(15)
        places = sorted(sorted(range(len(h)), key=lambda i: (seen[i], i))[:take])
        s = np.array([take], np.uint64)
        for p in places:
            s = fp.mix(s * np.uint64(3) + h[p : p + 1].astype(np.uint64))
        out.append(int(s[0] >> np.uint64(48)))
    return out


@pytest.mark.parametrize("step", [1 << 13, 7])
def test_signs_take_the_smallest_in_text_order(monkeypatch, step):
    monkeypatch.setattr(fp, "STEP", step)
    for text in (sentence(2, 20), "x" * 30, "abcdefghi", "ab"):
        codes = fp.code_points(text)
        assert fp.signs(codes).tolist() == plain_signs(fp.kmers(codes))


def test_order_matters():
    a, b = sentence(3, 300), sentence(4, 300)
    one, two = fp.signs(fp.code_points(a + " " + b)), fp.signs(fp.code_points(b + " " + a))
    edit = fp.signs(fp.code_points(a[:-5] + "other " + b))
    assert fp.likeness(one, one) == 1 and fp.likeness(one, two) < 0.8 < fp.likeness(one, edit)


def plain(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 4
        new = t[: len(t) - cut] + following[:cut]
        own, new_signs, theirs = (fp.signs(fp.code_points(x)) for x in (t, new, following))
        out.append(
            (
                i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.as_text(own), fp.as_text(new_signs),
                fp.likeness(own, new_signs), fp.likeness(own, theirs),
            )
        )
    return out


@pytest.mark.parametrize("parts", ["1", "4", "40"])
def test_against_one_sorted_list(spark, parts):
    rows = [(i, t) for i, t, _ in ODD if i not in (None, 7, 8)]
    rows += [(100 + k, sentence(k, 5 + k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(tuple(r) for r in fp.compare_with_next(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == plain(rows)


def test_odd_documents(spark):
    docs = documents(spark)
    got = fp.compare_with_next(docs).collect()
    assert len(got) == len(ODD)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 7)}) == 1
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1
    assert fp.compare_with_next(documents(spark, [])).count() == 0
    (one,) = fp.compare_with_next(documents(spark, [(5, "abcdefgh", "en")])).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    prints = {r.doc_id: r.fingerprint for r in fp.fingerprint(docs).collect()}
    assert prints[1] == next(r.fingerprint for r in got if r.doc_id == 1)
