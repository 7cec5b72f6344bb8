"""Importance resampling towards a target distribution (operator 11).

Hashed n-gram counts of all documents and of the target give each bucket a gain; a task holds the gains as one array and scores
its texts by it. The scored rows are written once; repeated exact count jobs over them narrow the score, and then the id among its ties,
to the cutoff of the draw, and the rows within it are ranked by ranges.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .words import ALPHANUMERIC, bounds, crc32s, lowered

BUCKETS = 10_000
MIN_WORDS = 20
SEED = "2024"
#: Thresholds of one count job: the range of a key narrows this many-fold plus one.
WAYS = 15
#: Bytes of text that a task hashes at once, and about how many ranked rows make a range.
AT_ONCE, RANGE_ROWS = 1 << 22, 1_000_000


def feature_buckets(array, width: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, bucket) of every run of 1 to ``width`` words, and the texts' numbers of words. A run's bucket is the CRC-32 of its
    words, joined by one space, modulo ``buckets``."""
    raw, offsets = lowered(array)
    first, starts, ends = bounds(raw, offsets, ALPHANUMERIC)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)
    crc, alive = crc32s(raw, starts, ends), np.arange(len(starts))
    docs, found = [doc], [crc % np.uint32(buckets)]
    blank = np.full(1, 32, np.uint8)
    for k in range(1, width):
        more = alive + k < first[doc[alive] + 1]
        alive, crc = alive[more], crc[more]
        spaces = np.zeros(len(alive), np.int64)
        crc = crc32s(raw, starts[alive + k], ends[alive + k], crc32s(blank, spaces, spaces + 1, crc))
        docs.append(doc[alive])
        found.append(crc % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(found).astype(np.int64), words


def _parts(column):
    """Slices of a string column of about ``AT_ONCE`` bytes, of whole texts."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in slices(sizes, lambda n: n + 32, AT_ONCE):
        yield column.slice(i, j - i)


def bucket_counts(df: DataFrame, text_col: str, width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts are in each bucket. A task sums in one array and sends its non-empty buckets; at most
    ``buckets`` rows come to the driver."""

    def counted(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in _parts(b.column(0)):
                total += np.bincount(feature_buckets(part, width, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    texts = df.select(F.col(text_col).cast("string").alias("t"))
    rows = texts.mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares), a whole number for each bucket."""
    k, s, t = len(source), source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def scored(df: DataFrame, gains: np.ndarray, id_col: str, text_col: str, width: int = 1, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score): the gains' sum over a text's features, and that plus Gumbel noise of its id."""

    def weighed(batches):
        import pyarrow as pa

        for b in batches:
            cols: list = [[], [], []]
            for part in _parts(b.column(1)):
                doc, bucket, words = feature_buckets(part, width, len(gains))
                sums = np.zeros(len(words), np.int64)
                np.add.at(sums, doc, gains[bucket])
                for c, v in zip(cols, (words, np.bincount(doc, minlength=len(words)), sums)):
                    c.append(v)
            cols = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64)) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_words", "n_features", "weight"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows = texts.mapInArrow(weighed, f"doc_id {kind}, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def cutoff(rows: DataFrame, keys: list[str], k: int) -> list[int] | None:
    """Bounds c such that exactly ``k`` rows are at or before c in the order of the whole-number columns ``keys``, which tell all rows
    apart; None where k is 0. Each key's range is cut by ``WAYS`` thresholds in one count job, and the part that holds the k-th row
    is cut again, until one value is left; the next key decides among its ties."""
    if k <= 0:
        return None
    found: list[int] = []
    for key in keys:
        col = F.col(key)
        low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if k == n:  # all ties stay: later keys need no bound
            return [*found, high]
        while low < high:
            steps = min(WAYS, high - low)
            marks = sorted({low + (high - low) * i // (steps + 1) for i in range(1, steps + 1)} | {low})
            counts = rows.agg(*(F.count(F.when(col <= F.lit(m), 1)) for m in marks)).first()
            reached = [m for m, c in zip(marks, counts) if c >= k]
            missed = [m for m, c in zip(marks, counts) if c < k]
            low, high = (missed[-1] + 1 if missed else low), (reached[0] if reached else high)
        found.append(low)
        k -= rows.filter(col < F.lit(low)).count()
        rows = rows.filter(col == F.lit(low))
    return found


def within(keys: list[str], bound: list[int]):
    """Whether a row is at or before ``bound`` in the order of ``keys``."""
    last = F.col(keys[len(bound) - 1]) <= F.lit(bound[-1])
    earlier = list(zip(keys, bound))[:-1]
    return reduce(lambda rest, kb: (F.col(kb[0]) < F.lit(kb[1])) | ((F.col(kb[0]) == F.lit(kb[1])) & rest), reversed(earlier), last)


def ranked(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``rows`` (n of them) with rank, from 1 in the order of ``order``: ranges of rows are sorted apart, and a rank is the sum of the earlier
    ranges' sizes and the place there."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / RANGE_ROWS))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")  # ranges are drawn anew each time they are computed
    part = F.shiftright("__at", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    rank = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("rank", rank).drop("__at", "__part", "__before")


def importance_resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    width: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null where not drawn).

    Of the rows with ``min_words`` words or more, the floor of ``percent`` in a hundred with the highest scores are drawn; ties go to the smaller id.
    Ids are whole numbers. A null id hashes as an empty one and loses ties to all others; rows alike in score and id are told
    apart by their place in the written table. Null and empty texts have no features and weigh 0; an empty input gives no
    rows, an empty target gains of a target without features. Other columns are not looked at.
    """
    gains = bucket_gains(bucket_counts(df, text_col, width, buckets), bucket_counts(target, target_col, width, buckets))
    rows = scored(df, gains, id_col, text_col, width, seed).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows.withColumns({"high": -F.col("score"), "anon": F.col("doc_id").isNull().cast("int"), "least": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}), "scored")
    keys = ["high", "anon", "least", "row"]
    able = rows.filter(F.col("n_words") >= min_words)
    k = able.count() * percent // 100
    bound = cutoff(able, keys, k)
    out = [F.col(c).cast("long") if c != "doc_id" else F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if bound is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = (F.col("n_words") >= min_words) & within(keys, bound)
    return ranked(rows.filter(drawn), keys, k).select(*out, "rank").unionByName(
        rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    )


def op11_importance_resample(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return importance_resample(read("documents"), read("benchmark"))


#: CRC-32 by eight shifts a byte, on distinct words.
_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
OP11_SQL = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
),
once AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
crcs AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * i - 1, 2))::BIGINT for i in range(1, len(x) // 2 + 1)],
    lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: {_STEP})), 4294967295) % 10000 AS bucket FROM once
),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN crcs USING (w) GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS total_s, sum(t)::DOUBLE AS total_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (total_s + 10000) / ((s + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT id AS doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM words JOIN crcs USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scores AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scores s LEFT JOIN places USING (doc_id)
"""
