"""Deduplication by row: ids that repeat, are null or clash lose no unique text and keep no copy."""

import pytest

from tintframe.llm import common, exact_dedup, jaccard, sharding

WORDS = " ".join(f"word{i}" for i in range(60))
ROWS = [(5, "aaa"), (9, "aaa"), (5, "bbb unique"), (7, "ccc"), (7, "ccc"), (None, "ddd"), (None, "ddd"), (None, "eee"), (4, None), (4, ""), (8, WORDS), (5, WORDS + " end"), (5, WORDS + " END")]


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit(c) for c in ("key", "id", "order", "n", "digest", "cluster", "__n")})


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_exact_copies_of_repeated_ids(rows):
    got = exact_dedup.drop_copies(rows)
    assert got.columns == rows.columns
    want = [(9, "aaa"), (5, "bbb unique"), (7, "ccc"), (None, "ddd"), (None, "eee"), (8, WORDS)]
    found = kept(got)
    assert [r for r in found if r[1] and "end" not in r[1].lower()] == sorted(want, key=str)
    assert len([r for r in found if not r[1]]) == 1 and len([r for r in found if r[1] and "end" in r[1].lower()]) == 1
    assert exact_dedup.drop_copies(rows.filter("false")).count() == 0


def test_near_copies_of_repeated_ids(rows):
    got = jaccard.drop_near_copies(rows)
    assert got.columns == rows.columns
    found = kept(got)
    assert sorted({t for _, t in found if t and len(t) < 20}) == ["aaa", "bbb unique", "ccc", "ddd", "eee"]
    assert len([t for _, t in found if t]) == 6 and [i for i, t in found if t and len(t) > 20] == [5]
    assert [r for r in found if r[1] == "aaa"] == [(5, "aaa")]
    assert len([t for _, t in found if not t]) == 2  # without words: no copies of each other


def test_unique_ids_need_no_numbers(spark, rows):
    from pyspark.sql import functions as F

    unique = rows.filter("doc_id = 9")
    assert common.own_key(unique, "doc_id")[1] == "doc_id"
    numbered, key = common.own_key(rows, "doc_id")
    assert key == common.ROW and numbered.select(key).distinct().count() == len(ROWS)
    one = spark.createDataFrame([(1, "same")] * 500, "doc_id long, text string").withColumn("other", F.rand(1))
    shuffled = sharding.external_shuffle(one, "doc_id", "text", 5, bucket_bytes=2000).toPandas()
    assert shuffled.groupby("shard").size().tolist() == [100] * 5 and shuffled.other.nunique() == 500


def test_intermediates_are_deleted(spark):
    import os

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    made = []

    def make():
        made.append(common.written(rows, "step"))
        return made[0].filter("doc_id = 2")

    out = common.settled(spark, make, "result")
    assert [r.doc_id for r in out.collect()] == [2]
    folder = common.shared_dir(spark).removeprefix("file://")
    assert not [d for d in os.listdir(folder) if d.startswith("step-")] and [d for d in os.listdir(folder) if d.startswith("result-")]
