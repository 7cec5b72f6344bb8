"""Benchmark decontamination by an FM-index of each shard of training text (operator 12).

Benchmark texts become windows of word digests. A task cuts its documents into shards of bounded size, indexes each shard's words
over the alphabet of the windows' words (all others are breaks), finds every window by backward search, locates its occurrences and
merges them into the spans to remove.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, own_key, slices, written
from .fm_index import FMIndex
from .words import ALPHANUMERIC, bounds, digests, lowered

WIDTH = 10
#: Words of an index, bytes of text read at once, and different windows that are sent to the tasks at once (a job for each such block).
SHARD_WORDS, AT_ONCE, WINDOWS_AT_ONCE = 1 << 19, 1 << 22, 500_000


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(window, item): the word digests of every window of each item, once an item; a text of fewer words is one window."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):  # a text at a time: its windows are its size times the width
                raw, offsets = lowered(b.column(1).slice(i, 1))
                words = digests(raw, *bounds(raw, offsets, ALPHANUMERIC)[1:]).view(np.int64)
                if not len(words):
                    continue
                k = min(width, len(words))
                for j in range(0, len(words) - k + 1, 1 << 16):
                    rows = np.lib.stride_tricks.sliding_window_view(words[j : j + (1 << 16) + k - 1], k)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(rows.reshape(-1)))
                    ids = pa.array([b.column(0)[i].as_py()] * len(rows), pa.string())
                    yield pa.RecordBatch.from_arrays([lists, ids], ["window", "item"])

    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(cut, "window array<long>, item string").distinct()


class Phrases:
    """A block of windows: the sorted alphabet of their words, the windows as rows of symbols from 1, and the item of each that
    only one item has."""

    def __init__(self, rows: list, width: int, shard_words: int = SHARD_WORDS):
        self.shard_words = shard_words
        self.wid = np.array([r.wid for r in rows], np.int64)
        self.item = np.array([r.item if r.n == 1 else None for r in rows], object)
        self.shared = np.array([r.n > 1 for r in rows], bool)
        self.size = np.array([len(r.window) for r in rows], np.int64)
        flat = np.concatenate([np.array(r.window, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.alphabet, symbol = np.unique(flat.view(np.uint64), return_inverse=True)
        self.symbols = np.zeros((len(rows), width), np.int64)
        self.symbols[np.arange(width) < self.size[:, None]] = symbol + 1

    def occurrences(self, words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, window) of every occurrence among the word digests; none spans one of the ``cuts``."""
        found: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if not len(self.wid):
            return found[0][0], found[1][0]
        overlap = self.symbols.shape[1] - 1
        for begin in range(0, len(words), self.shard_words):
            part = words[begin : begin + self.shard_words + overlap]
            at = np.minimum(np.searchsorted(self.alphabet, part), len(self.alphabet) - 1)
            symbol = np.where(self.alphabet[at] == part, at + 1, 0)
            breaks = cuts[(cuts >= begin) & (cuts <= begin + len(part))] - begin
            text, place = np.insert(symbol, breaks, 0), np.insert(np.arange(len(part)), breaks, -1)
            kept = np.ones(len(text) + 1, bool)  # of breaks in a row one is enough
            kept[1:-1] = (text[1:] > 0) | (text[:-1] > 0)
            text, place = np.append(text, 0)[kept], np.append(place, -1)[kept]
            used, text = np.unique(text, return_inverse=True)  # 0 is among them
            able = np.flatnonzero((np.isin(self.symbols, used) | (self.symbols == 0)).all(axis=1))
            if not len(able):
                continue
            index = FMIndex(text, len(used))
            low, high = index.search(np.searchsorted(used, self.symbols[able]), self.size[able])
            counts = high - low
            which = np.repeat(np.arange(len(able)), counts)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
            found[0].append(place[index.locate(rows)] + begin)
            found[1].append(able[which])
        return np.concatenate(found[0]), np.concatenate(found[1])


def _merged(pairs: np.ndarray) -> np.ndarray:
    """Rows (text, start, end) with those that overlap or touch in a text made one."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    reach = pairs[:, 2] + pairs[:, 0] * (1 << 40)
    reach = np.maximum.accumulate(reach) if len(reach) else reach
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 1] + pairs[1:, 0] * (1 << 40) > reach[:-1]
    last = np.flatnonzero(np.append(new[1:], True)) if len(pairs) else np.zeros(0, np.int64)
    return np.stack([pairs[new, 0], pairs[new, 1], reach[last] - pairs[new, 0] * (1 << 40)], axis=1)


SPAN = "array<struct<first:long,last:long,start:long,end:long>>"


def _search(rows: DataFrame, key: str, text_col: str, phrases) -> DataFrame:
    """(key, n_words, spans, items, shared): for each row its merged spans (word places and code points, ends exclusive), the items that
    are told by a window of their own, and the windows found that several items share."""

    def found(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        block = phrases.value
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for i, j in slices(sizes, lambda n: n + 32, AT_ONCE):
                raw, offsets = lowered(b.column(1).slice(i, j - i))
                first, starts, ends = bounds(raw, offsets, ALPHANUMERIC)
                place, window = block.occurrences(digests(raw, starts, ends), first[1:-1])
                doc = np.searchsorted(first, place, side="right") - 1
                spans = _merged(np.stack([doc, place, place + block.size[window]], axis=1))
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                origin = points[offsets[spans[:, 0]]]
                cols = [spans[:, 1] - first[spans[:, 0]], spans[:, 2] - first[spans[:, 0]], points[starts[spans[:, 1]]] - origin, points[ends[spans[:, 2] - 1]] - origin]
                struct = pa.StructArray.from_arrays([pa.array(c) for c in cols], ["first", "last", "start", "end"])
                per = lambda d: pa.array(np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32))
                once = np.unique(doc * len(block.wid) + window)
                doc, window = np.divmod(once, max(1, len(block.wid)))
                own, both = ~block.shared[window], block.shared[window]
                items: list = [set() for _ in range(j - i)]
                for d, w in zip(doc[own].tolist(), window[own].tolist()):
                    items[d].add(block.item[w])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        pa.array(np.diff(first)),
                        pa.ListArray.from_arrays(per(spans[:, 0]), struct),
                        pa.array([sorted(s - {None}) for s in items], pa.list_(pa.string())),
                        pa.ListArray.from_arrays(per(doc[both]), pa.array(block.wid[window[both]])),
                    ],
                    [key, "n_words", "spans", "items", "shared"],
                )

    kind = rows.schema[key].dataType.simpleString()
    texts = rows.select(key, F.col(text_col).cast("string").alias("__t"))
    return texts.mapInArrow(found, f"`{key}` {kind}, n_words long, spans {SPAN}, items array<string>, shared array<long>")


def _one_row(found: DataFrame, key: str) -> DataFrame:
    """Rows of several blocks as one row a key: spans sorted and merged by an aggregate over the sorted array."""
    lists = found.groupBy(key).agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("shared")).alias("shared"),
    )

    def merged(batches):
        for pdf in batches:
            out = []
            for spans in pdf["spans"]:
                kept: list = []
                for s in spans:
                    if kept and s["first"] <= kept[-1]["last"]:
                        kept[-1] |= {k: max(s[k], kept[-1][k]) for k in ("last", "end")}
                    else:
                        kept.append(dict(s))
                out.append(kept)
            yield pdf.assign(spans=out)

    return lists.mapInPandas(merged, lists.schema)


def contamination(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    windows_at_once: int = WINDOWS_AT_ONCE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per input row: its id, n_words, spans and items.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is ``width`` words of an item in a row, or all
    words of an item with fewer; spans join the words inside any occurrence of a window (``first`` and ``last`` count words, ``start`` and
    ``end`` code points, ends exclusive), and items lists, sorted, the ids (as strings) of items with a window that occurs. Null
    and empty texts have no words; an item without words has no window; windows of an item without id give spans but no item. Rows may
    repeat ids or have none. Empty tables give no rows, or rows without spans. Other columns are not looked at.
    """
    spark = df.sparkSession
    pairs = written(benchmark_windows(items, item_col, item_text_col, width), "window-items")
    once = pairs.groupBy("window").agg(F.count("*").alias("n"), F.max("item").alias("item"))
    windows = written(once.withColumn("wid", F.monotonically_increasing_id()), "windows")
    blocks = max(1, math.ceil(windows.count() / windows_at_once))
    rows, key = (df, id_col) if blocks == 1 else own_key(df, id_col)
    found = []
    for b in range(blocks):
        block = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).collect()
        found.append(_search(rows, key, text_col, spark.sparkContext.broadcast(Phrases(block, width, shard_words))))
    if blocks > 1:
        all_blocks = found[0]
        for more in found[1:]:
            all_blocks = all_blocks.unionByName(more)
        ids = rows.select(key, F.col(id_col).alias("doc_id")) if key != id_col else None
        out = _one_row(written(all_blocks, "found"), key)
        out = out.join(ids, key).drop(key) if ids is not None else out.withColumnRenamed(key, "doc_id")
    else:
        out = found[0].withColumnRenamed(key, "doc_id")
    if windows.filter("n > 1").isEmpty():
        return out.drop("shared")
    # windows of several items: only the documents that hold one meet the table of windows
    out = written(out.withColumn("__at", F.monotonically_increasing_id()), "contamination")
    shared = windows.filter("n > 1").drop("item").join(pairs.dropna(), "window").select("wid", "item")
    shared = written(shared, "shared")
    held = out.filter(F.size("shared") > 0)
    more = held.select("__at", F.explode("shared").alias("wid")).join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "wid")
    named = more.select("__at", "item").union(held.select("__at", F.explode("items"))).groupBy("__at").agg(F.array_sort(F.collect_set("item")).alias("items"))
    held = held.drop("items").join(named, "__at", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    columns = ["doc_id", "n_words", "spans", "items"]
    return out.filter(F.size("shared") == 0).select(*columns).unionByName(held.select(*columns))


def without_spans(text, spans):
    """The text column without its spans, by code points."""
    cuts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    pieces = F.zip_with(begins, cuts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(pieces, "")


def op12_decontaminate(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = contamination(read("documents"), read("benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
grams AS (SELECT r, k, i, list_slice(w, i, i + k - 1) AS win FROM places),
found AS (SELECT r, i, windows.k, item_id FROM grams JOIN windows ON grams.win = windows.win),
hits AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS word FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
