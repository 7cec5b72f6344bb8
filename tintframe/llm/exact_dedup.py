"""Exact dedup by a heavy-hitter split (operator 7).

Misra-Gries summaries of the text digests, merged over partitions, name every digest that may be frequent; their exact
counts and winners are verified, and only those - at most ``counters + 1`` of them, whatever the input - are broadcast,
so that copies of frequent texts are settled on the map side. All other digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_key, without_ids, written

COUNTERS = 8192


def text_digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased, in UTF-8. Null texts count as empty."""

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            # bytes.lower() changes A-Z only
            raw = [hashlib.sha256((t or b"").lower()).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["doc_id", "digest"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t")).mapInArrow(
        hashed, f"doc_id {kind}, digest binary"
    )


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, at_least): a Misra-Gries summary for each partition, of at most ``counters`` digests."""

    def summarise(batches):
        import pandas as pd

        held = pd.Series(dtype="int64")
        for pdf in batches:
            held = held.add(pdf["digest"].value_counts(), fill_value=0)
            if len(held) > counters:  # take the (counters+1)-th largest count off all, as one merge of summaries
                held = held.sort_values(ascending=False)
                held = held - held.iloc[counters]
                held = held[held > 0]
        if len(held):
            yield pd.DataFrame({"digest": held.index, "at_least": held.to_numpy().astype("int64")})

    return digests.select("digest").mapInPandas(summarise, "digest binary, at_least long")


def heavy_hitters(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of verified frequent digests: every digest with over 2n/(counters+1) rows is there,
    and there are at most counters+1 rows, because the summaries' counts add up to n at most."""
    n = digests.count()
    sums = misra_gries(digests, counters).groupBy("digest").agg(F.sum("at_least").alias("at_least"))
    likely = sums.filter(F.col("at_least") * F.lit(counters + 1) >= F.lit(n)).filter("at_least > 1").select("digest")
    return (
        digests.join(F.broadcast(likely), "digest")
        .groupBy("digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. The largest id of a group stays. A null text is an empty one;
    a null id is never kept before another id. Rows that repeat an id and a text are copies: group_size counts each, and
    all rows with the kept id say ``kept``. Empty input gives an empty result; other columns are not looked at.
    """
    digests = written(text_digests(df, id_col, text_col), "digests")
    heavy = written(heavy_hitters(digests, counters), "heavy")
    split = digests.join(F.broadcast(heavy), "digest", "left")
    settled = split.filter("group_size is not null")
    rest = split.filter("group_size is null").select("digest", "doc_id")
    groups = rest.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    light = rest.join(groups, "digest")
    return settled.unionByName(light).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One whole row of ``df`` for each group of equal texts, with its columns: that of the largest id; a null id comes after all
    others. Where rows repeat an id, or have none, they are told apart by a number of their own, and of rows alike in
    text and id the one with the largest number stays. An empty input gives no rows."""
    rows, key = own_key(df, id_col)
    order = F.struct(F.col(id_col).alias("id"), F.col(key).alias("key"))
    found = exact_dedup(rows.select(order.alias("order"), text_col), "order", text_col, counters)
    dropped = found.filter(~F.col("kept")).select("doc_id.key")
    return without_ids(rows, dropped, key).select(*df.columns)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
