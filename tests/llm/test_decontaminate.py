"""The FM-index, and decontamination against plain Python."""

import re

import numpy as np
import pytest

from tintframe.llm import decontaminate
from tintframe.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("seed", range(60))
def test_index_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    sigma, n = int(rng.integers(2, 6)), int(rng.integers(1, 80))
    text = np.append(rng.integers(0, sigma, n), 0)

    def suffix(p):
        out = []
        while text[p]:
            out.append((1, int(text[p])))
            p += 1
        return [*out, (0, int(p))]

    assert suffix_array(text, sigma).tolist() == sorted(range(n + 1), key=suffix)
    index, phrases, size = FMIndex(text, sigma, 3), rng.integers(1, sigma, (20, 4)), rng.integers(1, 5, 20)
    for low, high, p, k in zip(*index.search(phrases, size), phrases, size):
        want = [i for i in range(n + 2 - k) if text[i : i + k].tolist() == p[:k].tolist()]
        assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def split(text):
    return [(m.start(), m.end(), m[0]) for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def brute(text, items, width):
    words, hit, named = split(text), set(), set()
    for i, t in items:
        w = [x[2] for x in split(t)]
        k = min(width, len(w))
        for j in range(len(w) - k + 1) if w else ():
            for at in range(len(words) - k + 1):
                if [x[2] for x in words[at : at + k]] == w[j : j + k]:
                    hit |= set(range(at, at + k))
                    named.add(i)
    spans = []
    for at in sorted(hit):
        if spans and spans[-1][1] == at:
            spans[-1][1] = at + 1
        else:
            spans.append([at, at + 1])
    return len(words), [(a, b, words[a][0], words[b - 1][1]) for a, b in spans], sorted(str(i) for i in named if i is not None)


ITEMS = [(1, "a b c d e"), (10, "b c d e f g"), (2, "Ünï b"), (3, None), (4, " .,; "), (None, "x y z q"), (5, "a b c d e"), (7, "g")]
TEXTS = ["A b, c D e f g", None, "", "a b c d a b c d e b c d e", "ünÏ ünï B.", "nothing here", "x y z q", "é x y z, (q)", "a b c | d e " * 30, "e d c b a g g", "A" * 5000, "a b c d e\x00f g"]


@pytest.mark.parametrize("shard,width,at_once", [(1 << 19, 3, 500_000), (7, 4, 500_000), (1 << 19, 3, 4), (5, 2, 3)])
def test_against_plain_python(spark, shard, width, at_once):
    from pyspark.sql import functions as F

    rows = [(i % 9, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (None, TEXTS[0])]  # ids repeat
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("mine") for c in ("items", "spans", "key", "wid", "item", "n_words", "__t", "shared")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = decontaminate.contamination(df, items, width=width, windows_at_once=at_once, shard_words=shard)
    assert got.columns == ["doc_id", "n_words", "spans", "items"]
    found = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in got.collect()), key=str)
    want = sorted(((i, *brute(t, ITEMS, width)) for i, t in rows), key=str)
    assert found == want


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "Keep é this. a b c d e and that")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, none).collect()] == [(1, 10, [], [])]
    assert decontaminate.contamination(docs.filter("false"), none).count() == 0
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(docs, items, width=5).join(docs, "doc_id")
    assert [r.c for r in found.select(decontaminate.without_spans(found["text"], found["spans"]).alias("c")).collect()] == ["Keep é this.  and that"]
