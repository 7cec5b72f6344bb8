"""Shared pieces of the corpus operators: written stages, free column names and Arrow strings as bytes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder serves a session
    that runs in one process (tests); on a cluster that would lose data, so it raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tintframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: For each thread, the open calls of ``settled``: lists of what ``written`` has put in the shared folder since.
_CALLS = threading.local()


def _put(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage and survives lost executors."""
    out, path = _put(df, name)
    for paths in getattr(_CALLS, "open", [])[-1:]:
        paths.append(path)
    return out


def let_go(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished steps, which it does once the driver's handles on them are collected."""
    gc.collect()
    spark._jvm.System.gc()


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """The result of ``make()``, written; what it wrote on the way there in this thread is deleted, also where it raises."""
    calls = _CALLS.__dict__.setdefault("open", [])
    calls.append([])
    try:
        out, path = _put(make(), name)
    finally:
        hadoop, configuration = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        for step in calls.pop():
            at = hadoop(step)
            at.getFileSystem(configuration).delete(at, True)
        let_go(spark)
    for paths in calls[-1:]:
        paths.append(path)
    return out


def give_back() -> None:
    """Hands memory of freed arrays back to the system; a worker that Spark reuses keeps it else, from one step to the next."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


ROW = "__row"


def own_key(df: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``df`` and a column that tells all its rows apart: ``id_col`` itself where it does, or else a new one (``ROW``, or a free name like it),
    numbered in a written copy, so that a task run again meets the same numbers."""
    repeated = df.groupBy(id_col).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(id_col).isNull())
    if repeated.isEmpty():
        return df, id_col
    row = free_name(df, ROW)
    return written(df.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


#: Lists of ids up to this many rows are broadcast, longer ones are shuffled.
BROADCAST_IDS = 500_000
#: Bits of a sieve for each id, and at most (32 MB); more ids than that let more rows through, and never fewer.
SIEVE_BITS, SIEVE_MOST = 32, 1 << 28
#: Bits of one binary that ``bitmap_construct_agg`` makes.
BITMAP = 1 << 15


def sieved(df: DataFrame, id_col: str, ids: DataFrame, n: int, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: whether a row's id may be among the ``n`` of ``ids`` (one column, of the same type). False is sure:
    the id's bit is in none of the broadcast bitmaps; true is to be looked up."""
    bits = min(SIEVE_MOST, max(BITMAP, 1 << (SIEVE_BITS * n).bit_length()))
    at, part, bitmap = (free_name(df, c) for c in ("__at", "__part", "__bitmap"))
    marks = ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(bits)).alias(at)).groupBy(F.expr(f"{at} div {BITMAP}").alias(part))
    marks = marks.agg(F.bitmap_construct_agg(F.expr(f"{at} % {BITMAP}")).alias(bitmap))
    placed = df.withColumn(at, F.pmod(F.xxhash64(id_col), F.lit(bits))).withColumn(part, F.expr(f"{at} div {BITMAP}"))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.expr(f"int({at} % {BITMAP} div 8) + 1"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.expr(f"int({at} % 8)")) == 1
    return placed.join(F.broadcast(marks), part, "left").select(*df.columns, F.coalesce(bit, F.lit(False)).alias(name))


def without_ids(df: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is not in ``dropped`` (one column); rows with a null id stay."""
    dropped = written(dropped.toDF(id_col).dropna().distinct(), "dropped")
    n = dropped.count()
    if n <= BROADCAST_IDS:
        return df.join(F.broadcast(dropped), id_col, "left_anti").select(*df.columns)
    # only rows whose id may be dropped are shuffled
    name = free_name(df, "__maybe")
    rows = sieved(df, id_col, dropped, n, name)
    stay, maybe = rows.filter(f"not {name}").select(*df.columns), rows.filter(name).select(*df.columns)
    return stay.unionByName(maybe.join(dropped, id_col, "left_anti").select(*df.columns))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of an Arrow string array; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    array = pc.fill_null(array, "").cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(array) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


class Spans:
    """64-bit polynomial hashes of any spans of a byte array, from prefix sums modulo 2**64. Fit for looking up short spans: texts built like the Thue-Morse
    word collide from 1,024 bytes on."""

    def __init__(self, raw: np.ndarray):
        power = np.full(len(raw) + 1, _BASE, dtype=U64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.prefix = np.zeros(len(raw) + 1, dtype=U64)
        np.cumsum((raw.astype(U64) + U64(1)) * power[:-1], out=self.prefix[1:])
        self.inverse = np.full(len(raw) + 1, _BASE_INV, dtype=U64)
        self.inverse[0] = 1
        np.cumprod(self.inverse, out=self.inverse)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + size)


def slices(values: list, size_of, most: int):
    """Index ranges (from, to) over ``values`` whose sizes add up to about ``most``; one at least in each."""
    begin, total = 0, 0
    for i, v in enumerate(values):
        total += size_of(v)
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def keyed_groups(batches, key_names: list[str]):
    """Whole groups from pandas batches that are sorted by ``key_names``: yields frames that hold complete groups only.

    The last group of a batch is carried over to the next, so memory is one batch and one group.
    """
    import pandas as pd

    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key_names]
        tail = (keys != keys.iloc[-1]).any(axis=1).to_numpy()
        at = int(np.flatnonzero(tail)[-1]) + 1 if tail.any() else 0
        if at == 0:
            if held and not (held[-1][key_names].iloc[-1] == keys.iloc[-1]).all():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf)
            continue
        held.append(pdf.iloc[:at])
        yield pd.concat(held) if len(held) > 1 else held[0]
        held = [pdf.iloc[at:]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]
