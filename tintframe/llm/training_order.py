"""Token-ID output in training order (operator 5).

Documents are tokenised and cut into sequences of ``capacity`` ids at most. A keyed Feistel permutation with cycle-walking gives
every sequence a global slot; ranges of slots are shards, each one file of fixed-stride records, so that slot s is
at byte (s mod rows) * stride of file s div rows, and a reader can resume anywhere.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, fresh_path, mix
from .tokens import byte_level_ids, default_vocabulary

CAPACITY = 256
SHARD_ROWS = 32_768
PAD_ID = 50256
KEY = 5150
ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of ``index`` under a keyed permutation of 0..n-1: Feistel rounds on the next even power of two, walked on
    until the value is below n."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, shift = U64((1 << half) - 1), U64(half)
    keys = [mix(np.array([key], dtype=U64) * U64(2 * r + 1) + U64(r)) for r in range(ROUNDS)]

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    out = once(index.astype(U64))
    while (far := np.flatnonzero(out >= U64(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def _starts(scan: DataFrame, encode_of, capacity: int) -> dict[int, tuple[int, int]]:
    """The first sequence number and the count of each input partition; one row a partition comes to the driver."""

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, n = encode_of(), 0
        for b in batches:
            n += sum(_sequences(encode, t, capacity) for t in b.column(1).to_pylist())
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64())})

    at, out = 0, {}
    for r in sorted(scan.mapInArrow(count, "part long, n long").collect()):
        out[r["part"]] = (at, r["n"])
        at += r["n"]
    return out


def _sequences(encode, text: str | None, capacity: int) -> int:
    return -(-(len(encode(text)) + 1 if text else 1) // capacity)


def training_order(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    key: int = KEY,
    vocabulary: str | None = None,
    end_id: int = PAD_ID,
) -> DataFrame:
    """Write the shards of ``df`` and their index under ``path``; returns the index, one row per sequence: doc_id, piece, start,
    length, slot, shard, row, record_crc32.

    ``df`` must be a plain read of files, read twice: numbering sequences takes a pass that counts them, and the second pass
    fails if it meets other counts. A record is ``capacity`` uint16 ids, little-endian; the document's ids and ``end_id``,
    then ``end_id`` as padding. Null texts are empty (the end id alone); rows that repeat an id are sequences each; an empty table
    writes no shard. Files get their name only when whole, so a lost executor's part is written again.
    """
    spark = df.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    encode_of = lambda: byte_level_ids(vocabulary)
    scan = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fixed = "spark.sql.files.minPartitionNum"  # else the cores of the moment would shape the partitions
    before = spark.conf.get(fixed, None)
    spark.conf.set(fixed, before or str(spark.sparkContext.defaultParallelism))
    try:
        starts = _starts(scan, encode_of, capacity)
        total = sum(n for _, n in starts.values())
        shards = max(1, math.ceil(total / shard_rows))

        def number(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            encode, none = encode_of(), np.zeros(0, dtype="<u4")
            begin, expected = starts[TaskContext.get().partitionId()]
            at = begin
            for b in batches:
                pieces, raws = [], []
                for t in b.column(1).to_pylist():
                    ids = encode(t) if t else none
                    if ids.max(initial=0) > 65_535:
                        raise OverflowError("ids must be below 65,536")
                    raw = np.empty(len(ids) + 1, dtype="<u2")
                    raw[:-1], raw[-1] = ids, end_id
                    pieces.append(-(-len(raw) // capacity))
                    raws.append(raw)
                counts, total_ids = np.array(pieces), np.array([len(r) for r in raws])
                take = np.repeat(np.arange(len(raws)), counts)
                piece = np.arange(len(take)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(total_ids[take] - start, capacity)
                offsets = np.concatenate([[0], np.cumsum(2 * length)]).astype(np.int32)
                joined = pa.py_buffer(b"".join(raws))
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(take), [None, pa.py_buffer(offsets), joined])
                slot = feistel(np.arange(at, at + len(take)), total, key)
                at += len(take)
                columns = [b.column(0).take(pa.array(take)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32))]
                columns += [pa.array(slot), ids]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "slot", "ids"])
            if at != begin + expected:
                raise RuntimeError("the input changed between the two passes")

        kind = df.schema[id_col].dataType.simpleString()
        schema = f"doc_id {kind}, piece int, start long, length int, slot long"
        numbered = scan.mapInArrow(number, schema + ", ids binary")
        shard = F.expr(f"cast(slot div {shard_rows} as int)")
        dealt = numbered.repartitionById(shards, shard).sortWithinPartitions("slot")

        def write(batches):
            import uuid
            import zlib

            import pyarrow as pa
            from pyarrow import fs

            store, folder = fs.FileSystem.from_uri(path)
            stream, name, mine = None, None, f".{uuid.uuid4().hex}"
            padding = np.full(capacity, end_id, "<u2").tobytes()

            def close():
                if stream is not None:
                    stream.close()
                    store.move(name + mine, name)

            for b in batches:
                crcs = []
                for slot, ids in zip(b.column("slot").to_pylist(), b.column("ids").to_pylist(), strict=True):
                    if slot % shard_rows == 0:
                        close()
                        name = f"{folder}/shard-{slot // shard_rows:06d}.bin"
                        stream = store.open_output_stream(name + mine)
                    record = ids + padding[len(ids) :]
                    stream.write(record)
                    crcs.append(zlib.crc32(record))
                slots = b.column("slot").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [b.column(n) for n in ("doc_id", "piece", "start", "length", "slot")]
                    + [pa.array((slots // shard_rows).astype(np.int32)), pa.array(slots % shard_rows), pa.array(crcs, pa.int64())],
                    ["doc_id", "piece", "start", "length", "slot", "shard", "row", "record_crc32"],
                )
            close()  # not when a batch failed: a part of a file never gets its name

        _make_folder(path)
        index = dealt.mapInArrow(write, schema + ", shard int, row long, record_crc32 long")
        index.write.parquet(f"{path}/index")
    finally:
        spark.conf.unset(fixed) if before is None else spark.conf.set(fixed, before)
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def _make_folder(path: str) -> None:
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder)


def read_shards(spark: SparkSession, path: str, shards: int, first_slot: int = 0, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(slot, ids) from ``first_slot`` on, read sequentially, one task a shard; earlier shards aren't opened."""
    first = first_slot // shard_rows

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        stride = 2 * capacity
        for b in batches:
            for shard in b.column(0).to_pylist():
                with store.open_input_file(f"{folder}/shard-{shard:06d}.bin") as f:
                    at = max(0, first_slot - shard * shard_rows)
                    f.seek(at * stride)
                    while raw := f.read(4096 * stride):
                        n = len(raw) // stride
                        slots = np.arange(n) + shard * shard_rows + at
                        ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(stride), n, [None, pa.py_buffer(raw)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(slots), ids], ["slot", "ids"])
                        at += n

    return spark.range(first, shards, 1, max(1, shards - first)).mapInArrow(read, "slot long, ids binary")


def op5_training_order(spark, sf_dir: str) -> DataFrame:
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "training"))
