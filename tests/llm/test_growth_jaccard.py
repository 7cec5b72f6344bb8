"""What near dedup moves follows the routing keys, once each, and the texts that the search compares."""

import random

import pytest

from tintframe.llm import common, jaccard


def shuffled_bytes(spark) -> int:
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def large(spark):
    """Many partitions and no small tables, as with many texts."""
    now = {"spark.sql.shuffle.partitions": "48", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i:05}" for i in range(50_000)], k=400)) for _ in range(600)]
    return texts + [t.rsplit(" ", 1)[0] + " end" for t in texts[:6]]


def test_keys_and_texts_cross_one_exchange(spark, texts, large, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    df = common.written(df, "texts")
    before = shuffled_bytes(spark)
    kept = jaccard.drop_near_copies(df).select("doc_id").toPandas()["doc_id"]
    moved = shuffled_bytes(spark) - before
    assert sorted(kept) == list(range(600))
    keys = jaccard.segment_keys(*_sets(texts), jaccard.Bands(80, 100))[1]
    # 16 bytes a key, what ids and links take, and a few texts
    assert moved < 20 * len(keys) + 60 * len(texts)


def _sets(texts):
    import pyarrow as pa

    return jaccard.shingle_sets(pa.array(texts), 5)


@pytest.mark.parametrize(("held", "known"), [(1, 1), (500, 7), (1 << 20, 2048)])
def test_shared_keys_equal_a_dictionary(spark, texts, held, known, monkeypatch):
    from collections import defaultdict

    import numpy as np

    monkeypatch.setattr(jaccard, "HELD_KEYS", held)
    monkeypatch.setattr(jaccard, "KNOWN_ROWS", known)
    some = texts[:20] + texts[-6:] + texts[:3] + ["", None, "one two"]
    bands, (offsets, hashes) = jaccard.Bands(80, 100), _sets(some)
    owner, keys, need = jaccard.segment_keys(offsets, hashes, bands)
    nodes = jaccard._set_a(offsets, hashes)[owner].astype(np.int64)
    holders = defaultdict(set)
    for node, key, n in zip(nodes.tolist(), keys.tolist(), need.tolist()):
        holders[key].add((node, n))
    want = sorted(sorted(h) for h in holders.values() if len({node for node, _ in h}) > 1)
    df = spark.createDataFrame([(t,) for t in some], "t string").repartition(3)
    got = defaultdict(set)
    for r in jaccard._shared_keys(df, "t", 5, bands, 5).collect():
        got[r.key].add((r.node, r.need))
    assert sorted(map(sorted, got.values())) == want


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_a_sieve_loses_no_id(spark, kind, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    df = spark.range(40_000).select(common.F.col("id").cast(kind).alias("doc_id"), common.F.lit(1).alias("__at"))
    df = df.unionByName(spark.createDataFrame([(None, 2)], f"doc_id {kind}, __at int"))
    ids = df.filter("__at = 1 and hash(doc_id) % 3 = 0").select("doc_id")
    n = ids.count()
    rows = common.sieved(df, "doc_id", ids, n, "maybe")
    assert rows.columns == ["doc_id", "__at", "maybe"] and rows.count() == 40_001
    assert rows.filter("maybe").join(ids, "doc_id").count() == n
    assert rows.filter("maybe").count() < n + 0.1 * 40_000
    left = common.without_ids(df, ids, "doc_id")
    assert left.columns == df.columns and left.count() == 40_001 - n and left.filter("doc_id is null").count() == 1
