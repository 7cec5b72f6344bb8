"""Importance resampling against plain Python, and the word columns it stands on."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tintframe.llm import importance, words

TEXTS = ["", None, "one", "Straße Ünï 9x9, naïve_x", "a" * 200 + " b", "The cat THE CAT the", "\x00tab\tnew\nline", *(f"w{i % 7} w{i % 3} the end {i}" for i in range(40))]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, width):
    w = split(text)
    return [" ".join(w[i : i + k]) for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, width, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in features(x, width)) for side in ([r[1] for r in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    out = []
    for i, text in rows:
        weight = sum(gain(bucket(f)) for f in features(text, width))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features(text, width)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(split(text))])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], place.get(id(r))) for r in out]


@pytest.mark.parametrize("width,percent,least", [(1, 30, 3), (3, 50, 0), (1, 100, 1), (2, 0, 2), (1, 7, 99)])
def test_against_brute_force(spark, width, percent, least):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "nobody has this id"), (3, TEXTS[3]), (None, None), (-5, "below nought is a number")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("mine") for c in ("row", "score", "rank", "high", "__at", "t", "bucket", "n")})
    target = spark.createDataFrame([(1, "the cat w1 w2"), (2, None)], "item_id long, text string")
    got = importance.importance_resample(df, target, width=width, buckets=50, percent=percent, min_words=least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(rows, ["the cat w1 w2", None], width, 50, percent, least)
    plain = lambda rs: sorted((tuple(r)[:4] for r in rs), key=str)
    found = [tuple(r) for r in got.collect()]
    assert plain(found) == plain(want)
    # rows alike in id and score may take each other's place
    ranks = lambda rs: sorted((r[4], r[3], r[0]) for r in rs if r[4])
    assert ranks(found) == ranks(want)


def test_ties_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_resample(none, none).count() == 0
    same = spark.createDataFrame([(7, "a b c")] * 100, "doc_id long, text string").repartition(4)
    got = importance.importance_resample(same, none, percent=33, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 34)) and len(got) == 100 and len({r.score for r in got}) == 1


def test_cutoff_is_exact_for_every_count(spark):
    rng = np.random.default_rng(3)
    data = [(int(a), int(b), i) for i, (a, b) in enumerate(zip(rng.integers(-4, 4, 60) * 1000, rng.integers(0, 3, 60)))]
    df = spark.createDataFrame(data, "a long, b long, c long").coalesce(1).cache()
    for k in (0, 1, 17, 18, 19, 59, 60):
        bound = importance.cutoff(df, ["a", "b", "c"], k)
        got = sorted(tuple(r) for r in df.filter(importance.within(["a", "b", "c"], bound)).collect()) if bound else []
        assert got == sorted(data)[:k]


def test_crc_and_digests():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 105, n))) for n in [*range(1, 40), 64, 65, 511, 512, 513, 5000]]
    raw, offsets = words.lowered(pa.array([" ".join(texts), None, " x "]))
    first, starts, ends = words.bounds(raw, offsets, words.ALPHANUMERIC)
    assert first.tolist() == [0, len(texts), len(texts), len(texts) + 1]
    assert words.crc32s(raw, starts, ends).tolist() == [zlib.crc32(t.encode()) for t in [*texts, "x"]]
    assert len(set(words.digests(raw, starts, ends).tolist())) == len(texts) + 1
    thue = "ab"
    while len(thue) < 65536:
        thue += thue.translate(str.maketrans("ab", "ba"))
    for n in (8, 64, 512, 1024, 4096, 32768):
        pair = f"{thue[:n]} {thue[n : 2 * n]} {thue[:n]}"
        raw, offsets = words.lowered(pa.array([pair]))
        d = words.digests(raw, *words.bounds(raw, offsets, words.VISIBLE)[1:])
        assert d[0] != d[1] and d[0] == d[2]
