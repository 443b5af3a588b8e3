import random

import pytest

from tests.llm.helpers import ODD, SF, documents, groups, sentence, shingles
from tidemark.llm import components, minhash


def family(seed: int, base: str, copies: int, edits: int) -> list[str]:
    rnd, out = random.Random(seed), []
    for _ in range(copies):
        w = base.split()
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def result(df):
    return [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()]


@pytest.mark.parametrize("block", [512, 4])
def test_against_all_pairs(spark, monkeypatch, block):
    """Families around the threshold, with small blocks too, so that groups are compared in parts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = []
    for k in range(6):
        texts += family(k, sentence(k, 60), 14, 3 + k)
    rows = list(enumerate(texts)) + [(900, texts[0]), (901, texts[0])]
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows, 4)
    got = result(minhash.near_duplicates(docs, shingle=4))
    assert {i: c for i, _, c, _ in got} == want
    assert all(n == len(shingles(dict(rows)[i], 4)) and k == (c == i) for i, n, c, k in got)
    assert len(set(want.values())) > 6


def test_links_of_parts_are_found():
    """Sets compared in two blocks: only links across blocks and components come out."""
    import numpy as np

    sets = [np.arange(10, dtype=np.uint64) + np.uint64(s) for s in (0, 1, 50, 51, 0)]
    group, one = np.arange(5), np.zeros(5)
    assert {frozenset(p) for p in minhash._linked(sets, group, one, 80)} == {frozenset({0, 1}), frozenset({0, 4}), frozenset({2, 3})}
    two = np.array([0, 0, 0, 1, 1])
    assert {frozenset(p) for p in minhash._linked(sets, group, two, 80)} == {frozenset({0, 4}), frozenset({1, 4}), frozenset({2, 3})}
    assert minhash._linked(sets, np.zeros(5, int), one, 80) == []


def test_a_band_has_four_permutations():
    assert all(len(set(band)) == minhash.ROWS for band in (minhash._ORDER % minhash.PERMUTATIONS).tolist())
    assert sorted(minhash._ORDER.ravel().tolist()) == list(range(2 * minhash.PERMUTATIONS))


def test_odd_documents(spark):
    got = sorted(result(minhash.near_duplicates(documents(spark), shingle=4)), key=str)
    assert len(got) == len(ODD)
    by_id = {i: (n, c, k) for i, n, c, k in got}
    assert by_id[7] == (37, 1, False) and by_id[1][1:] == (1, True)
    for i in (2, 3, 4):
        assert by_id[i] == (0, i, True)
    assert by_id[13][1] == 12 and by_id[12][0] == 1
    assert all(c is None and k for i, _, c, k in got if i is None)


def test_drop_keeps_columns_and_one_of_each(spark):
    docs = documents(spark)
    kept = minhash.drop_near_duplicates(docs, shingle=4)
    assert kept.schema == docs.schema
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    # Two texts of id 8 are not alike, so both rows stay; two equal rows of id 7 are copies of 1.
    assert ids == [1, 2, 3, 4, 5, 6, 8, 8, 11, 12]
    assert kept.where("doc_id is null").count() == 2


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    """No text goes without a link; equal rows leave one, and so do linked texts of one id."""
    one, other, third = sentence(1, 60), sentence(2, 60), sentence(3, 60)
    rows = [
        (1, one, "en"), (1, other, "en"), (1, one + " tail", "en"), (1, None, "en"), (1, None, "en"),
        (2, other, "en"), (2, third, "en"), (2, third, "en"), (3, third, "de"), (3, "few words", "en"),
    ]
    docs = documents(spark, rows)
    kept = minhash.drop_near_duplicates(docs, shingle=5)
    assert kept.schema == docs.schema
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    texts = {"one": [(1, one), (1, one + " tail")], "other": [(1, other)], "third": [(2, third)]}
    assert len(got) == 5 and (1, None) in got and (3, "few words") in got
    for choices in texts.values():
        assert sum(x in got for x in choices) == 1
    # The order of the rows does not matter.
    again = minhash.drop_near_duplicates(documents(spark, rows[::-1]).repartition(3), shingle=5)
    assert sorted(((r.doc_id, r.text) for r in again.collect()), key=str) == got


def test_drop_on_given_documents(spark):
    """With buckets whose members stay in several components, which are compared among each other."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    named = groups([(r.doc_id, r.text) for r in docs.collect()], 5)
    kept = [r.doc_id for r in minhash.drop_near_duplicates(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(i for i, root in named.items() if i == root)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.id: r.component for r in got.collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0



def test_pairs_that_cannot_be_linked_go_no_further(spark):
    """Parity maps never take a pair of sets that are alike, and do take those that are clearly not."""
    rnd = random.Random(5)
    base = sentence(1, 200).split()
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        w = base + [f"more{x}" for x in range(rnd.choice([0, 0, 300]))]
        for place in rnd.sample(range(len(w)), rnd.randint(0, 40)):
            w[place] = f"new{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    # An id with two rows: one of them is like the first.
    rows += [(500, "quite another text of some words"), (500, " ".join([*base, "end"]))]
    docs = spark.createDataFrame(rows, "id long, text string")
    sk = minhash.sketches(docs, "id", "text", 4)
    pairs = spark.createDataFrame([(0, k) for k in [*range(1, 120), 500]], "a long, b long")
    got = {r.b for r in minhash.possible(pairs, sk, 80).collect()}
    first = shingles(rows[0][1], 4)
    like = lambda t: len(first & shingles(t, 4)) / len(first | shingles(t, 4))
    best = {k: max(like(t) for i, t in rows if i == k) for k, _ in rows[1:]}
    assert {k for k, x in best.items() if x >= 0.8} <= got
    assert len({k for k, x in best.items() if x >= 0.8}) > 5
    assert not {k for k, x in best.items() if x < 0.6} & got
    assert len({k for k, x in best.items() if x < 0.6}) > 5


def test_texts_that_stay_are_not_moved(spark, tmp_path):
    """Also where the ids are too many to be broadcast: only rows whose id may be dropped go into a shuffled join."""
    rows = [(k, sentence(k, 40)) for k in range(300)] + [(300 + k, sentence(k, 40)) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash.drop_near_duplicates(spark.read.parquet(str(tmp_path / "docs")))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(300))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    joins = [line for line in plan.splitlines() if "Join Left" in line]
    # Rows without the mark of an id to drop pass by; of the others, those with the id are taken out.
    assert [("LeftAnti" in j, "rightHint=(strategy=broadcast)" in j) for j in joins] == [
        (True, True), (True, False), (False, True)
    ]
