from collections import defaultdict

import pytest

from tests.llm.helpers import ODD, documents, sentence
from tidemark.llm import sharding


def plain(df, limit):
    return [r.asDict() for r in sharding.assign(df, limit).collect()]


def narrow(spark, rows=None):
    return documents(spark, rows, extra=False)


@pytest.mark.parametrize("limit", [200, 2_000, 50_000, 1 << 30])
def test_shards_fit_and_do_not_overlap(spark, limit):
    rows = [(i, sentence(i, 3 + i % 60), "en") for i in range(300)]
    got = plain(narrow(spark, rows), limit)
    assert sorted(r["doc_id"] for r in got) == list(range(300))
    size, members = defaultdict(int), defaultdict(int)
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        members[r["shard"]] += 1
        assert len(r["shard"]) == r["depth"] and r["page"] == 0
        assert format(r["key"], "060b").startswith(r["shard"])
    assert all(size[s] <= limit or members[s] == 1 for s in size)
    for s in size:
        # The bucket it was split from did not fit.
        parent = s[:-1]
        if s:
            whole = sum(r["n_bytes"] for r in got if format(r["key"], "060b").startswith(parent))
            assert whole > limit
        assert not any(t != s and t.startswith(s) for t in size)


def test_equal_rows_go_to_pages(spark):
    rows = [(1, "x" * 40, "en")] * 10 + [(2, "y" * 500, "en"), (3, "z", "en")]
    got = plain(narrow(spark, rows), 100)
    pages = defaultdict(int)
    for r in got:
        if r["doc_id"] == 1:
            pages[r["page"]] += r["n_bytes"]
    assert len(pages) == 5 and max(pages.values()) == 80
    assert len(got) == 12


def test_odd_documents(spark):
    assert len(plain(narrow(spark), 1000)) == len(ODD)
    assert plain(narrow(spark, []), 1000) == []
    with pytest.raises(ValueError):
        sharding.assign(narrow(spark), 0)


def test_extra_columns_stay(spark):
    docs = documents(spark)
    assert sharding.assign(docs, 1000).columns == [*docs.columns, "key", "n_bytes", "depth", "shard", "page"]


def test_columns_in_the_way(spark, tmp_path):
    """Columns of the same names, in any case, are kept; the new ones give way."""
    docs = narrow(spark).withColumnRenamed("lang", "Shard").withColumnRenamed("source", "page")
    docs = docs.withColumn("n", docs["n_chars"]).withColumn("task", docs["n_chars"]).withColumn("depth", docs["n_chars"])
    docs = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1"))
    got = sharding.assign(docs, 500)
    assert got.columns == [*docs.columns, "key", "n_bytes", "depth_", "shard_", "page_"]
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {r.page_ for r in got.where("doc_id = 1").collect()} == {0, 1, 2}
    sharding.write(docs, str(tmp_path / "out"), 500)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_a_crowd_over_many_tasks(spark):
    """Equal rows that come in many tasks fill their pages one after the other."""
    rows = [(1, "x" * 40, "en")] * 997 + [(i, "y" * 30, "de") for i in range(2, 60)]
    got = plain(narrow(spark, rows).repartition(13), 400)
    pages = defaultdict(int)
    for r in got:
        if r["doc_id"] == 1:
            pages[r["page"]] += 1
    assert sorted(pages) == list(range(100)) and sorted(pages.values()) == [7] + [10] * 99


def test_files(spark, tmp_path):
    rows = [(i, sentence(i, 20), "en") for i in range(100)]
    docs = narrow(spark, rows)
    sharding.write(docs, str(tmp_path / "out"), 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100
    folders = [p for p in (tmp_path / "out").glob("shard=*/page=*")]
    assert len(folders) == sharding.assign(docs, 2000).select("shard", "page").distinct().count()
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
