"""Sharding by a two-pass external shuffle (operator 4).

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of their own key; pass 2 puts each bucket in
memory, shuffles it by Fisher-Yates and writes it. Buckets one after another are one random order of all records, which is cut
into shards whose counts differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, ROW, fresh_path, own_key, written

BUCKET_BYTES = 8 << 20
SEED = 20240607
#: Buckets of a run in the two-level sums of their counts.
RUN = 4096


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1 by Fisher and Yates's swaps."""
    rng = np.random.Generator(np.random.PCG64(seed & (2**63 - 1)))
    out = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        out[i], out[j] = out[j], out[i]
    return out


def external_shuffle(
    df: DataFrame, id_col: str, text_col: str, n_shards: int = 40, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The rows of ``df`` with shard (0 to n_shards-1) and slot (from 0), shuffled. n_shards must be positive.

    The order depends on ids, seed and the number of buckets only, so a recomputed task gives the same. Where rows repeat an id or have none,
    their text counts too, and of rows equal in both the how-manieth each is, so that no bucket grows with them. Null texts
    weigh their fixed bytes. An empty input gives no rows. Columns named like the new ones are replaced.
    """
    hidden = ["__bucket", "__order", "__pos", "__again"]
    df, key = own_key(df.drop("shard", "slot", *hidden), id_col)
    total, n = df.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 64), F.count("*")).first()
    n_buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col(id_col))
    if key != id_col:
        again = written(_again(df.select(F.col(key).alias(ROW), F.xxhash64(id_col, text_col).alias("h"))), "again").withColumnRenamed(ROW, key)
        df = df.join(F.broadcast(again) if again.count() <= BROADCAST_IDS else again, key, "left")
        hashed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.coalesce("__again", F.lit(0)))
    bucket = F.pmod(hashed, F.lit(n_buckets)).cast("int")
    sizes = df.select(bucket.alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("__n"))
    # running sums in two levels: within runs of RUN buckets, and over the runs, which are few
    sizes = sizes.withColumn("__run", F.expr(f"__bucket div {RUN}"))
    runs = sizes.groupBy("__run").agg(F.sum("__n").alias("__sum"))
    runs = runs.select("__run", (F.sum("__sum").over(Window.orderBy("__run")) - F.col("__sum")).alias("__base"))
    within = F.sum("__n").over(Window.partitionBy("__run").orderBy("__bucket")) - F.col("__n")
    starts = sizes.join(runs, "__run").select("__bucket", (F.col("__base") + within).alias("__start"))

    def shuffled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__order", key], kind="stable")
        mixed = int(pdf["__bucket"].iloc[0]) * 0x9E3779B97F4A7C15 + seed
        pdf = pdf.iloc[fisher_yates(len(pdf), mixed)]
        return pdf.assign(__pos=np.arange(len(pdf), dtype="int64"))

    # joined before the grouping, so that both use one exchange by bucket
    scattered = df.withColumns({"__bucket": bucket, "__order": hashed}).join(starts, "__bucket")
    schema = scattered.withColumn("__pos", F.lit(0).cast("long")).schema
    placed = scattered.groupBy("__bucket").applyInPandas(shuffled, schema)
    p, k = F.col("__start") + F.col("__pos"), F.lit(n_shards)
    shard = F.expr(f"((__start + __pos + 1) * {n_shards}L - 1) div {max(n, 1)}L").cast("int")
    first = F.expr(f"(shard * {n}L) div {n_shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", p - first).drop("__start", *hidden, *({key} - {id_col}))


def _again(rows: DataFrame) -> DataFrame:
    """(ROW, __again) of all but the first rows that are alike in ``h``: 1, 2 and so on, counted within the written copy's partitions
    and from each one's start, so that no group of equal rows meets in one task."""
    part = F.shiftright(ROW, 33).alias("part")
    sizes = rows.groupBy("h", part).agg(F.count("*").alias("n"))
    within, across = Window.partitionBy("h", "part").orderBy(ROW), Window.partitionBy("h")
    starts = sizes.select("h", "part", (F.sum("n").over(across.orderBy("part")) - F.col("n")).alias("start"), F.sum("n").over(across).alias("all"))
    several = starts.filter("all > 1").drop("all")
    ranked = rows.select("*", part).join(several, ["h", "part"]).withColumn("__again", F.col("start") + F.row_number().over(within) - 1)
    return ranked.filter("__again > 0").select(ROW, F.col("__again").cast("long").alias("__again"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write Parquet folders shard=N; each bucket's rows go out as one run in slot order."""
    shuffled.write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = fresh_path(spark, "shards")
    write_shards(external_shuffle(docs, "doc_id", "text", 40), path)
    out = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
