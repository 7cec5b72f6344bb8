"""Double-array tries, and prefix statistics of conversations against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tintframe.llm import prefix_trie
from tintframe.llm.double_array import DoubleArray, dense


@pytest.mark.parametrize("seed", range(20))
def test_double_array(seed):
    rng = np.random.default_rng(seed)
    paths = sorted({tuple(int(x) for x in rng.integers(0, 2 + seed, rng.integers(1, 7))) for _ in range(80)})
    flat = np.array([x for p in paths for x in p])
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    level = np.concatenate([np.arange(len(p)) for p in paths])
    symbols = dense(flat, np.argsort(level, kind="stable"))
    assert len({(a, b) for a, b in zip(flat, symbols)}) == len(set(flat.tolist())) == symbols.max() + 1
    trie = DoubleArray(symbols, offsets)
    state = trie.walk(symbols, offsets)
    prefixes = [p[: j + 1] for p in paths for j in range(len(p))]
    assert (state > 0).all() and len(set(zip(prefixes, state.tolist()))) == len(set(prefixes)) == len(set(state.tolist()))
    assert (trie.check >= 0).sum() == len(set(prefixes))
    strange = np.full(len(symbols), symbols.max() + 1)
    assert (trie.walk(strange, offsets) == -1).all()


def words(text):
    return len([w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w])


def brute(rows, family, most=4):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {}
    for c, t in convs.items():
        digest = lambda r, x: hashlib.sha256(b"%d:" % len(r.encode()) + r.encode() + x.encode()).digest()[:16]
        own[c] = [(r, x) for _, _, r, x in sorted(t, key=lambda v: (v[0], v[1], digest(v[2], v[3])))]
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most if family else 0
        paths[c] = tuple(own.get(c - c % family, [])[:h] + own[c][h:]) if family else tuple(own[c])
    members, kids = defaultdict(list), defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
            if d:
                kids[p[: d - 1]].add(p[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * words(p[-1][1]) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if paths[c] == p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), up, len(cs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.choice(60, 45, replace=False):
        n = int(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 13]))
        for t in range(n):
            rows.append((int(c), t, ["user", None, "é"][t % 3], [None, "", "a  b", "c\td e\n"][int(rng.integers(0, 4 if t < 4 else 2))]))
    rows += [(7, None, "first", "null turn"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (None, 1, "user", "nobody"), (100, 3, None, None)]
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(30) for t in range(9)]
    return rows


@pytest.mark.parametrize("family,segment,shard", [(20, 256, 2 << 20), (20, 4, 300), (0, 5, 150)])
def test_against_plain_python(spark, family, segment, shard):
    from pyspark.sql import functions as F

    rows = made(segment + family)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({c: F.lit("mine") for c in ("place", "digest", "tokens", "seg", "n", "key", "part", "depth")})
    got = prefix_trie.conversation_trie(df, family=family, segment=segment, shard_bytes=shard)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, family)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(none, family=20).count() == 0
