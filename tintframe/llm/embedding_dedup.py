"""Embedding near-dedup by Euclidean p-stable hashing (operator 6).

Normalised vectors are projected on Gaussian directions, shifted and quantised; ``hashes`` quantised projections make a
table's bucket, and ``tables`` independent tables are used. What goes through the tables is a sketch of each vector, of one byte a
part, with its error: sketches in a bucket whose cosine may reach the threshold join their vectors to a cluster. Vectors
themselves are sent once for each cluster, and all its pairs are checked by their exact cosine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, keyed_groups, mix, written
from .components import connected_components, roots

WIDTH = 2.0
RECALL = 0.98
#: Unrelated vectors of one label in a bucket, at most, on average.
UNRELATED = 256
#: Rows of a block; larger buckets and clusters are compared in pairs of blocks.
BLOCK = 256
#: One in so many vectors is drawn to foresee which buckets need blocks: a matter of layout alone.
DRAWN = 4
SEED = 66
#: Tables of large buckets or cluster sizes up to this many rows (of 40 bytes) are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 100_000


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two points at this distance (Datar and others, 2004)."""
    t = width / distance
    below = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def parameters(n: int, cosine: float, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """(hashes, tables) for ``n`` vectors of a label: unrelated vectors share a bucket with ``UNRELATED`` others at most, on average; a
    pair at the least cosine is found with probability ``recall``, closer ones with more. Tables grow as n to the power of 0.22."""
    near, far = collision(math.sqrt(2 - 2 * cosine), width), collision(math.sqrt(2), width)
    hashes = max(1, math.ceil(math.log(max(n, 2) / UNRELATED) / -math.log(far)))
    return hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


def normalised(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # first, so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray) -> np.ndarray:
    """Rows of bytes: each part in 8 bits of the largest, then as float32 the step and the distance to the vector itself."""
    step = (np.abs(x).max(axis=1) / 127).astype(np.float32)
    q = np.rint(x / step[:, None]).astype(np.int8)
    error = np.linalg.norm(x - q * step[:, None].astype(np.float64), axis=1).astype(np.float32) * np.float32(1.001)
    return np.concatenate([q.view(np.uint8), np.stack([step, error], axis=1).view(np.uint8)], axis=1)


def may_link(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of sketches may be of vectors with at least this cosine: no such pair is missed, as |xy - uv| <= |x-u| + |u| |y-v|."""
    parts = [(s[:, :-8].view(np.int8).astype(np.float32), s[:, -8:].copy().view(np.float32)) for s in (a, b)]
    (u, (su, eu)), (v, (sv, ev)) = [(q, (t[:, 0], t[:, 1])) for q, t in parts]
    return (u @ v.T) * su[:, None] * sv >= np.float32(cosine - 1e-5) - eu[:, None] - (1 + eu[:, None]) * ev


def _sketched(classes: DataFrame, hashes: int, tables: int, seed: int) -> DataFrame:
    """(cls, sketch, keys): one bucket key for each table, of label, vector length and table."""

    def bucket(batches):
        import pandas as pd

        for pdf in batches:
            size = pdf["embedding"].map(len).to_numpy()
            for d in np.unique(size):
                part = pdf.iloc[np.flatnonzero(size == d)]
                x = normalised(part["embedding"].tolist())
                rng = np.random.Generator(np.random.PCG64([seed, int(d)]))
                axes, shift = rng.standard_normal((d, hashes * tables)), rng.random(hashes * tables) * WIDTH
                cell = np.floor((x @ axes + shift) / WIDTH).astype(np.int64).astype(U64).reshape(len(part), tables, hashes)
                h = part["label_hash"].to_numpy().astype(U64)[:, None] ^ mix(np.arange(tables).astype(U64) + U64(int(d) << 32))
                for k in range(hashes):
                    h = mix(h * U64(31) + cell[:, :, k])
                yield pd.DataFrame({"cls": part["cls"].to_numpy(), "sketch": [s.tobytes() for s in sketches(x)], "keys": list(h.astype(np.int64))})

    return classes.mapInPandas(bucket, "cls long, sketch binary, keys array<bigint>")


def _in_blocks(rows: DataFrame, large: DataFrame, key: str, own: str) -> DataFrame:
    """``rows`` with the block pairs (a, b) that each takes part in; ``second`` where it is of the pair's second block. ``large``: key, blocks
    for those keys that have several."""
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    i = F.pmod(F.xxhash64(own), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1),
        lambda j: F.struct(F.least(i, j).alias("a"), F.greatest(i, j).alias("b"), (i > j).alias("second")),
    )
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("second")))
    dealt = rows.join(large, key, "left").withColumn("task", F.explode(F.when(F.col("blocks").isNull(), alone).otherwise(pairs)))
    return dealt.select(*rows.columns, "task.*").repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")


def _tasks(batches, key: str):
    """From rows sorted by (key, a, b): each task's rows, and index arrays of its left and right side; equal ones mean all pairs within."""
    parts = [key, "a", "b"]
    for pdf in keyed_groups(batches, parts):
        keys, second = pdf[parts].to_numpy(), pdf["second"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
        for p, q in zip(cuts, cuts[1:]):
            if q - p > 1:
                every = np.arange(q - p)
                yield pdf.iloc[p:q], *((every[~second[p:q]], every[second[p:q]]) if keys[p][1] != keys[p][2] else (every, every))


def _pairs(left: np.ndarray, right: np.ndarray, near) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs for which ``near`` (of two index arrays) holds, each once, found tile by tile."""
    out = []
    for s in range(0, len(left), 1024):
        for t in range(0, len(right), 1024):
            a, b = left[s : s + 1024], right[t : t + 1024]
            if left is right and t < s:
                continue
            hit = near(a, b)
            i, j = np.nonzero(np.triu(hit, 1) if left is right and s == t else hit)
            out.append((a[i], b[j]))
    return (np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])) if out else (left[:0], right[:0])


def _candidates(named: DataFrame, cosine: float, seed: int) -> DataFrame:
    """(cls, cluster): classes that share a bucket with one that their sketch may link to, directly or through others."""
    most = named.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sketched = written(_sketched(named.withColumn("label_hash", F.xxhash64("label")), *parameters(most, cosine), seed), "sketches")
    dealt = sketched.select("cls", "sketch", F.explode("keys").alias("key"))
    drawn = sketched.filter(F.pmod(F.xxhash64("cls"), F.lit(DRAWN)) == 0).select(F.explode("keys").alias("key"))
    blocks = F.ceil(F.count("*") * DRAWN / BLOCK).cast("int").alias("blocks")
    large = written(drawn.groupBy("key").agg(F.count("*").alias("n"), blocks).filter(F.col("n") * DRAWN >= 2 * BLOCK).drop("n"), "large")

    def compare(batches):
        import pandas as pd

        for part, left, right in _tasks(batches, "key"):
            size = part["sketch"].map(len).to_numpy()
            if (size != size[0]).any():  # keys of two vector lengths that are equal by chance: lengths are compared apart
                raise RuntimeError("bucket keys of vectors of different length are equal; choose another seed")
            s = np.frombuffer(b"".join(part["sketch"]), dtype=np.uint8).reshape(len(part), -1)
            i, j = _pairs(left, right, lambda a, b: may_link(s[a], s[b], cosine))
            if len(i):
                cls, root = part["cls"].to_numpy(), roots(len(part), i, j)
                leaf = np.flatnonzero(root != np.arange(len(part)))
                yield pd.DataFrame({"u": cls[leaf], "v": cls[root[leaf]]})

    stars = _in_blocks(dealt, large, "key", "cls").mapInPandas(compare, "u long, v long")
    return connected_components(stars).select(F.col("node").alias("cls"), F.col("component_id").alias("cluster"))


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, seed: int = SEED
) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id, kept.

    Rows link when their labels are equal and not null and the cosine in double precision is at least ``cosine``. A
    vector that is null, empty, zero or holds null or non-finite parts, and one without a label, links with nothing; nor do vectors of different length.
    Equal vectors of a label are one class, compared once. A cluster over ``BLOCK`` classes is compared in pairs of blocks, so no task
    holds more; its links go out as sums and spanning stars, never as pairs. Rows that repeat an id count each, as vectors of their own. Rows
    without an id link too; a component is named by its least id, and where it has none, its rows are all kept and have a null component.
    """
    v = F.col(vector_col)
    ok = (
        F.col(label_col).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.when(ok, v).alias("embedding"))
    same = ["h1", "h2"]
    rows = rows.withColumns(
        {h: F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(h), "label", F.col("embedding").cast("array<double>"))) for h in same}
    )
    classes = (
        rows.filter("embedding is not null")
        .groupBy(*same)
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    )
    # numbered where they are written: ids may be null or repeated
    named = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    clusters = _candidates(named, cosine, seed)
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    members = named.select("cls", "n", "label", "embedding").join(clusters, "cls")

    def check(batches):
        import pandas as pd

        for part, left, right in _tasks(batches, "cluster"):
            label, n = part["label"].to_numpy(), part["n"].to_numpy()
            x = normalised(part["embedding"].tolist())
            i, j = _pairs(left, right, lambda a, b: (x[a] @ x[b].T >= cosine) & (label[a][:, None] == label[b]))
            if len(i):
                links = np.bincount(i, weights=n[j], minlength=len(part)) + np.bincount(j, weights=n[i], minlength=len(part))
                cls, root, some = part["cls"].to_numpy(), roots(len(part), i, j), np.flatnonzero(links)
                yield pd.DataFrame({"u": cls[some], "v": cls[root[some]], "links": links[some].astype(np.int64)})

    checked = _in_blocks(members, written(sizes, "large"), "cluster", "cls").mapInPandas(check, "u long, v long, links long")
    found = written(checked, "links")
    sums = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "cls")
    groups = connected_components(found.select("u", "v")).withColumnRenamed("node", "cls")
    names = groups.join(named.select("cls", "rep"), "cls").groupBy("component_id").agg(F.min("rep").alias("name"))
    groups = groups.join(written(names, "names"), "component_id").select("cls", "name")
    sized = (
        named.select(*same, "cls", "rep", "n")
        .join(sums, "cls", "left")
        .join(groups, "cls", "left")
        .select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("name", "rep").alias("component_id"))
    )
    # written: a join of two plain exchanges is one that adaptive execution splits where a class has many copies
    out = rows.select("vec_id", *same).join(written(sized, "sized"), same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.col("component_id").isNull()).alias("kept"),
    )


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b
  ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS least FROM embeddings UNION SELECT v, least FROM reach JOIN links ON u = vec_id WHERE least < v),
names AS (SELECT vec_id, min(least) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN names USING (vec_id) LEFT JOIN counts ON u = e.vec_id
"""
