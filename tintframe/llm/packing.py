"""Best-fit packing by bin completion (operator 2).

Documents are tokenised and cut into pieces in Spark tasks. Only the histogram of piece lengths - one count for each length
up to the capacity, however many documents there are - decides the packing: branch and bound over bins, each completed
around the largest length left by an undominated filling, pruned by waste bounds, with best-fit solutions as incumbents.
A plan is a list of bin patterns with repeat counts; pieces get their places from their rank within their length,
a distributed two-level count, so no piece is ever collected.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import byte_level_ids, default_vocabulary

CAPACITY = 1024
END_ID = 2
NODES = 2000
#: Fillings of a node, those of least waste, that are put in order before they are tried.
FIRST = 64

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The bound of Martello and Toth: for each a, lengths over capacity - a stand alone, and those over half
    of the capacity open a bin; what is at least a must fit in their rest or in more bins."""
    if not counts:
        return 0
    n = np.zeros(capacity + 2, dtype=np.int64)
    for length, c in counts.items():
        n[length] += c
    upto, volume = np.cumsum(n), np.cumsum(n * np.arange(capacity + 2))
    half, best = capacity // 2, -(-int(volume[-1]) // capacity)
    for a in range(0, half + 1):
        alone = upto[-1] - upto[capacity - a]
        large = upto[capacity - a] - upto[half]
        room = large * capacity - (volume[capacity - a] - volume[half])
        small = volume[half] - (volume[a - 1] if a else 0)
        best = max(best, int(alone + large + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on a histogram: each length goes to the fullest bins that still take it."""
    open_bins: dict[int, Counter] = {}  # room left -> patterns
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                fit = capacity // length
                full, part = divmod(left, fit)
                for times, bins in ((fit, full), (part, 1)):
                    if times and bins:
                        open_bins.setdefault(capacity - times * length, Counter())[(length,) * times] += bins
                break
            pattern, bins = next(iter(open_bins[room].items()))
            fit = min(room // length, left)
            use = min(bins, left // fit)
            open_bins[room][pattern] -= use
            if not open_bins[room][pattern]:
                del open_bins[room][pattern]
                if not open_bins[room]:
                    del open_bins[room]
            open_bins.setdefault(room - fit * length, Counter())[pattern + (length,) * fit] += use
            left -= use * fit
    return [(p, c) for bins in open_bins.values() for p, c in bins.items()]


def fillings(counts: dict[int, int], room: int, most_waste: int | None = None):
    """The undominated fillings of ``room``, of any number of parts, one by one: least waste first, then larger first lengths.
    None stands for a step of the search that gave no filling.

    A filling is dominated if another's lengths hold disjoint groups of its parts. Then a single free length, no smaller, takes
    the place of one group (of several parts, of one smaller part or of none) and still fits; this also rules out all that
    contains the group, so the search drops it at once.
    """
    lengths = sorted((k for k, c in counts.items() if c and k <= room), reverse=True)
    every = (1 << (room + 1)) - 1
    reach = [1]  # of each suffix of lengths: bit s is set if some of them sum to s
    for length in reversed(lengths):
        bits, left, step = reach[-1], min(counts[length], room // length), 1
        while left:
            use = min(step, left)
            bits |= bits << (use * length) & every
            left, step = left - use, step * 2
        reach.append(bits)
    reach.reverse()

    def smeared(bits: int, width: int) -> int:
        """Bits moved up by 0 to ``width``."""
        done = 0
        while done < width:
            by = min(done + 1, width - done)
            bits, done = bits | bits << by, done + by
        return bits

    for waste in range(room if most_waste is None else min(room, most_waste), -1, -1)[::-1]:
        if not reach[0] >> (room - waste) & 1:
            continue
        # (index of the next length, sum still to find, parts, their bits, sums of two or more, lengths that are free)
        free = sum(1 << k for k in lengths)
        todo = [(0, room - waste, (), 0, 0, free)]
        while todo:
            at, rest, parts, ones, sums, free = todo.pop()
            # that a free length fits in the waste is known at the end only: further parts may use it up
            held = smeared(sums, waste) | (smeared((ones | (not rest)) << 1, waste - 1) if waste else 0)
            if held & free:
                yield None
                continue
            if not rest:
                yield parts
                continue
            more = []
            for i in range(at, len(lengths)):
                length = lengths[i]
                if length > rest or not reach[i + 1] >> (rest - length) & 1 and not reach[i] >> (rest - length) & 1:
                    continue
                used = parts.count(length) + 1
                if used > counts[length]:
                    continue
                still = free & ~(1 << length) if used == counts[length] else free
                more.append((i, rest - length, (*parts, length), ones | 1 << length, sums | sums << length | ones << length, still))
            todo += reversed(more)
            if not more:
                yield None


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Bin patterns with repeat counts for a histogram of lengths 1 to ``capacity``.

    Depth-first: the largest length left is completed by each undominated filling in turn, repeated as often as the counts allow,
    then less often. A branch ends when the bins so far and the bound of the rest, or the waste, can't beat the incumbent, at
    first and at each node the best-fit solution of the rest. ``nodes`` bounds the work of each of two searches, which try fillings in
    different order: nodes, and steps of the search for fillings, 64 of which count as one node; the incumbent is returned
    when they are used up, so that a small gap to ``lower_bound`` may be left.
    """
    counts = {k: v for k, v in counts.items() if v}
    if any(k > capacity or k < 1 for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    if not counts:
        return []
    goal = lower_bound(counts, capacity)
    volume = sum(k * v for k, v in counts.items())
    best: Plan = best_fit(counts, capacity)
    best_bins = sum(c for _, c in best)
    seen: dict[frozenset, int] = {}

    def children(left: dict[int, int], wasted: int):
        top = max(left)
        others = {k: v - (k == top) for k, v in left.items() if v > (k == top)}
        spare = (best_bins - 1) * capacity - volume - wasted
        room, found, steps_ = capacity - top, [], 0
        every = fillings(others, room, spare) if spare >= 0 else iter(())
        for filling in every if large_parts else ():
            steps_ += 1
            yield None
            if filling is not None:
                found.append(filling)
            if len(found) == FIRST or steps_ == 4 * FIRST:
                break
        found.sort(key=lambda f: 20 * (room - sum(f)) ** 2 - sum(x * x for x in f))
        for filling in itertools.chain(found, every):
            if filling is None:
                yield None
                continue
            pattern = (top, *filling)
            need = Counter(pattern)
            for times in range(min(left[k] // c for k, c in need.items()), 0, -1):
                yield pattern, times, {k: n for k, v in left.items() if (n := v - times * need.get(k, 0))}

    def opened(left: dict[int, int], plan: Plan, bins: int, wasted: int):
        """The children of a node that may beat the incumbent; none of others."""
        nonlocal best, best_bins
        rest = best_fit(left, capacity)
        if bins + sum(c for _, c in rest) < best_bins:
            best, best_bins = plan + rest, bins + sum(c for _, c in rest)
        key = frozenset(left.items())
        if not left or seen.get(key, best_bins) <= bins or bins + lower_bound(left, capacity) >= best_bins:
            return
        seen[key] = bins
        stack.append((plan, bins, wasted, children(left, wasted)))

    # first by least waste; then, of the fillings of least waste, those of large parts first, since small parts fit anywhere later on
    for large_parts in (False, True):
        stack: list = []
        seen.clear()
        steps = 0
        opened(counts, [], 0, 0)
        while stack and best_bins > goal and steps < 64 * nodes:
            plan, bins, wasted, more = stack[-1]
            child = next(more, False)
            if child is False:
                stack.pop()
            elif child is None:
                steps += 1
            else:
                steps += 64
                pattern, times, left = child
                opened(left, [*plan, (pattern, times)], bins + times, wasted + times * (capacity - sum(pattern)))
        if not stack or best_bins <= goal:
            break  # searched whole, or optimal
    return best


def token_pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 [, ids]): a document's ids and ``end_id``, cut only if over ``capacity``,
    the shorter piece first. A null text is empty and so has the end id alone."""

    def cut(batches):
        import zlib

        import pyarrow as pa

        encode, end = byte_level_ids(vocabulary), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            whole = []
            for i, t in enumerate(b.column(1).to_pylist()):
                raw = (encode(t).tobytes() if t else b"") + end
                n = len(raw) // 4
                start, k = 0, 0
                stop = n % capacity or min(n, capacity)
                while start < n:
                    part = raw[4 * start : 4 * stop]
                    for column, value in zip(rows, (i, k, start, stop - start, zlib.crc32(part)), strict=True):
                        column.append(value)
                    if with_ids:
                        whole.append(part)
                    start, stop, k = stop, stop + capacity, k + 1
            arrays = [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(whole, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def best_fit_packing(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 [, ids as little-endian uint32], sequence_id, offset.

    Sequences are gapless from offset 0 and hold ``capacity`` ids at most. Null texts are empty, rows that repeat an id are packed each, an
    empty table gives no rows, and other columns of ``df`` are not looked at.
    """
    pieces = written(token_pieces(df, id_col, text_col, capacity, vocabulary or default_vocabulary(), end_id, with_ids), "pieces")
    n = pieces.count()
    # ranks within a length: rows are dealt to sub-groups of about 100,000 by a hash, each counted from its own start
    salts = max(1, math.ceil(n / 100_000)) * 4
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = written(salted.groupBy("length", "__salt").agg(F.count("*").alias("__n")), "sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("__n")).collect()}  # capacity rows at most
    by_length = Window.partitionBy("length").orderBy("__salt")
    starts = sizes.select("length", "__salt", (F.sum("__n").over(by_length) - F.col("__n")).alias("__start"))
    inner = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.join(starts, ["length", "__salt"])
        .withColumn("__rank", F.col("__start") + F.row_number().over(inner) - 1)
        .drop("__salt", "__start")
    )
    lookup = _place_table(bin_completion(counts, capacity))

    def place(batches):
        for pdf in batches:
            key = (pdf["length"].to_numpy().astype(np.int64) << 44) + pdf["__rank"].to_numpy()
            row = lookup[:, np.searchsorted(lookup[0], key, side="right") - 1]
            within = key - row[0]
            length = pdf["length"].to_numpy()
            yield pdf.drop(columns="__rank").assign(
                sequence_id=row[2] + within // row[1], offset=row[3] + within % row[1] * length
            )

    columns = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema]
    out = ranked.select(*pieces.columns, "__rank")
    return out.mapInPandas(place, ", ".join(columns) + ", sequence_id long, offset long")


def _place_table(plan: Plan) -> np.ndarray:
    """Rows key of the first rank, copies in a bin, first bin, first offset: which ranks of a length each pattern takes."""
    rows, used, bins = [], Counter(), 0
    for pattern, times in plan:
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            rows.append(((length << 44) + used[length], copies, bins, offset))
            used[length] += copies * times
            offset += length * copies
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
