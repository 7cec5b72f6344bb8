"""N-gram Jaccard join by T-occurrence search (operator 10), exact at any size of group.

1. Each text becomes its set of shingle hashes; texts with equal sets are one class, named by its least id.
2. Routing, without loss: two linked sets differ in at most D shingles, D known from their size band. The shingles are dealt to
   more than D segments by hash, so that at least one segment is equal in both; classes that share a segment are routed to the same cluster.
3. Within a cluster - split into blocks and block pairs of bounded size where it is large - a T-occurrence search runs for each
   set: the DivideSkip way, its short inverted lists are merged (by sorting their ascending runs in one array, which does what a heap
   would), and candidates that reach the threshold less the number of long lists are probed in those by binary search. Where a search
   has more than ``PROBED`` candidates that it must try, the long lists are counted in one pass for all of them instead, which is exact
   as well. Sets that reach the needed overlap are linked.
4. Connected components of the links give each document its group. Copies and near copies never become all pairs:
   a set is not compared again with sets that the search has already joined to it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, give_back, keyed_groups, let_go, mix, own_key, sieved, slices, without_ids, written
from .components import connected_components
from .words import shingle_sets

CHARS_AT_ONCE = 1 << 18
#: Sets and shingles of a block; a cluster beyond either is compared in pairs of blocks, whose rows are alike in number.
BLOCK_SETS = 256
BLOCK_SHINGLES = 300_000
#: Cluster tables up to this many rows (of at most 100 bytes) are broadcast, larger ones are shuffled, with the texts that they may name.
BROADCAST_ROWS = 200_000
#: Sets that a task remembers to route copies once.
REMEMBERED = 200_000
#: Routing keys that a task of the routing holds before it deals them out, and those of a bucket, on average at most.
HELD_KEYS = 1 << 18
BUCKET_KEYS = 1 << 20
#: Buckets of routing keys, at most: their number and 48 bits of the key tell keys apart.
BUCKETS = 1 << 16
#: The need of an entry whose row is known; larger needs are lowered below it, which routes more pairs and loses none.
MET = 0xFFFF
#: Known rows that go along at once.
KNOWN_ROWS = 2048
#: Candidates of a search that are probed one by one.
PROBED = 4
#: Sets in one Spark task of the search, on average.
TASK_ROWS = 1000
#: Segments beyond those that differences can touch, at least; up to so many empty ones don't count for routing.
SPARE = 2


class Bands:
    """Size bands, and for each the number of segments: one more than the differences of a linked pair can touch, and ``spares`` beyond
    that, so that such a pair agrees in spares + 1 segments at least.

    A pair belongs to the band of its smaller set. ``num``/``den`` is the least similarity.
    """

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        low, lows, segments, spares = 1, [], [], []
        while low <= largest:
            high = max(low, low * 137 // 100, low * den // num)
            lows.append(low)
            differ = (high + high * den // num) * (den - num) // (den + num)
            spare = SPARE + differ // 8
            segments.append(1 if differ == 0 else differ + 1 + spare)
            spares.append(spare)
            low = high + 1
        self.lows, self.segments, self.spares = np.array(lows), np.array(segments), np.array(spares)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1


def segment_keys(offsets: np.ndarray, hashes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set index, routing key, need): equal keys mean an equal segment of the same band. ``need`` is twice the number of keys of a
    band that a set shares with any set that it is linked to there, plus 1 for the lower of its two bands."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    own = bands.of(np.maximum(sizes, 1))
    least = -(-sizes * bands.num // bands.den)  # the least size of a partner
    keys_doc, keys, needs = [], [], []
    for lower, (band, wanted) in enumerate(((own, sizes > 0), (own - 1, (own > 0) & (least < bands.lows[own]) & (sizes > 0)))):
        segments = np.where(wanted, bands.segments[np.maximum(band, 0)], 0)
        segments[segments == 1] = 0  # only equal sets link there, and those are one class already
        base = np.cumsum(segments) - segments
        use = segments[doc] > 0
        d, h = doc[use], hashes[use]
        slot = base[d] + (mix(h + U64(0x5851F42D4C957F2D)) % segments[d].astype(U64)).astype(np.int64)
        total = int(segments.sum())
        sums, filled = np.zeros(total, dtype=U64), np.zeros(total, dtype=bool)
        np.add.at(sums, slot, mix(h))
        filled[slot] = True
        owner = np.repeat(np.arange(n), segments)
        empties = np.bincount(owner[~filled], minlength=n)
        # empty segments may be among those that agree: they count as keys only where that is likely enough to matter
        spare = bands.spares[np.maximum(band, 0)]
        take = filled | (empties[owner] > spare[owner])
        needs.append((2 * (spare + 1 - np.minimum(empties, spare)) + lower)[owner[take]])
        place = (np.arange(total) - base[owner] + (band[owner] << 32)).astype(U64)
        keys.append(mix(sums + mix(place))[take])
        keys_doc.append(owner[take])
    return np.concatenate(keys_doc), np.concatenate(keys), np.concatenate(needs)


def t_occurrence_links(offsets: np.ndarray, hashes: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) between sets that connect all linked sets; not every link within what is connected.

    ``side``: sets of side 1 are searched among those of side 0; where all are of one side, all among all.
    """
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    words, where = np.unique(hashes, return_inverse=True)
    indexed = np.ones(len(doc), dtype=bool) if (side == side[0]).all() else side[doc] == 0
    within = bool((side == side[0]).all())
    entries = np.sort(where[indexed] * n + doc[indexed])  # the inverted lists one after another, each ascending
    lists = entries % n
    length = np.bincount(where[indexed], minlength=len(words))
    begin = np.cumsum(length) - length
    group = np.arange(n)
    links: list[tuple[int, int]] = []
    for q in range(n):
        if not size[q] or not (within or side[q]):
            continue
        mine = where[offsets[q] : offsets[q + 1]]
        mine = mine[length[mine] > int(within)]  # a list with no other set can't help
        need = -(-int(size[q]) * num // den)  # overlap is at least num/den of the larger set
        if len(mine) < need:
            continue
        mine = mine[np.argsort(-length[mine], kind="stable")]
        longest = int(length[mine[0]])
        n_long = min(int(need / (0.0085 * math.log2(longest + 1) + 1)), need - 1)
        long, short = mine[:n_long], mine[n_long:]
        size_of = length[short]
        runs = lists[np.repeat(begin[short] - np.cumsum(size_of) + size_of, size_of) + np.arange(size_of.sum())]
        runs.sort(kind="stable")  # merges the ascending runs
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        found, count = runs[first], np.diff(np.append(first, len(runs)))
        likely = (count >= need - n_long) & (found != q) & (size[found] * den >= size[q] * num) & (size[q] * den >= size[found] * num)
        if within:
            likely &= found > q
        found, count = found[likely], count[likely]
        order = np.argsort(-count, kind="stable")
        found, count = found[order], count[order]
        similar = lambda both, s: both * den >= num * (size[q] + size[s] - both)
        for tries in range(PROBED + 1):
            other = group[found] != group[q]
            found, count = found[other], count[other]
            if not len(found):
                break
            if tries < PROBED:
                s, probe = int(found[0]), long * n + int(found[0])
                at = np.minimum(np.searchsorted(entries, probe), len(entries) - 1)  # one binary probe in each long list
                linked = [s] if similar(int(count[0]) + int((entries[at] == probe).sum()), s) else []
                found, count = found[1:], count[1:]
            else:  # many candidates: counting the long lists is cheaper than probing them for each
                size_of = length[long]
                runs = lists[np.repeat(begin[long] - np.cumsum(size_of) + size_of, size_of) + np.arange(size_of.sum())]
                linked = found[similar(count + np.bincount(runs, minlength=n)[found], found)].tolist()
            for s in linked:
                if group[s] != group[q]:
                    links.append((q, s))
                    group[group == group[s]] = group[q]
    return links


def _set_rows(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """For each text its set: doc_id, n_shingles, set_a, set_b."""

    def sets(batches):
        import pyarrow as pa

        for ids, offsets, hashes in _shingled(batches, width):
            edge = np.concatenate([[U64(0)], np.cumsum(mix(hashes ^ U64(0xA0761D6478BD642F)))])
            set_b = (edge[offsets[1:]] - edge[offsets[:-1]]).astype(np.int64)
            columns = [ids, pa.array(np.diff(offsets)), pa.array(_set_a(offsets, hashes).astype(np.int64)), pa.array(set_b)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(sets, f"doc_id {kind}, n_shingles long, set_a long, set_b long")


def _shingled(batches, width: int):
    """(first column, offsets, hashes) of slices of Arrow batches whose last column is a text."""
    import pyarrow.compute as pc

    give_back()
    for b in batches:
        texts = b.column(b.num_columns - 1)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, j in slices(lengths, lambda n: n + 64, CHARS_AT_ONCE):
            yield b.column(0).slice(i, j - i), *shingle_sets(texts.slice(i, j - i), width)
    give_back()


def _set_a(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    edge = np.concatenate([[U64(0)], np.cumsum(hashes)])
    return edge[offsets[1:]] - edge[offsets[:-1]]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and how long they are."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return first, np.diff(np.append(first, len(values)))


def _packed(nodes: np.ndarray, keys: np.ndarray, needs: np.ndarray) -> bytes:
    """Entries column by column: 8 bytes of the node, the low 6 of the key (those above are the bucket's), 2 of the need."""
    low = np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return nodes.astype("<u8").tobytes() + low.tobytes() + needs.astype("<u2").tobytes()


def _unpacked(entries: bytes, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(entries) // 16
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :6] = np.frombuffer(entries, np.uint8, 6 * n, 8 * n).reshape(n, 6)
    keys = keys.view("<u8").ravel() | U64(bucket << 48)
    return np.frombuffer(entries, "<u8", n), keys, np.frombuffer(entries, "<u2", n, 14 * n)


def _shared_keys(df: DataFrame, text_col: str, width: int, bands: Bands, buckets: int) -> DataFrame:
    """(node, key, need), some of them twice: the sets' hashes with those of their routing keys that another set has too.

    Keys cross one exchange, once, as packed entries of a bucket, ``buckets`` at most ``BUCKETS``. Of a key that several sets of a task
    have, one entry goes, marked as ``MET``: their rows are known and go along in any bucket, so a hot key is a few entries a task.
    """

    def dealt(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = (TaskContext.get().partitionId() * 977) % buckets  # the next bucket for rows that are known
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def batch():
            nonlocal at
            nodes, keys, needs = map(np.concatenate, zip(*held))
            bucket = ((keys >> U64(32)) * U64(buckets)) >> U64(32)
            keys = (bucket << U64(48)) | (keys & U64((1 << 48) - 1))
            order = np.argsort(keys, kind="stable")
            nodes, keys, needs = nodes[order], keys[order], np.minimum(needs[order], MET - 3 + needs[order] % 2)
            first, size = _runs(keys)
            met = np.minimum.reduceat(nodes, first) < np.maximum.reduceat(nodes, first)
            several = np.repeat(met, size)
            rows = [], [], []
            known = nodes[several], keys[several], needs[several].astype("<u2")
            for i in range(0, len(known[0]), KNOWN_ROWS):
                for column, value in zip(rows, (at, True, b"".join(x[i : i + KNOWN_ROWS].tobytes() for x in known))):
                    column.append(value)
                at = (at + 1) % buckets
            nodes, keys, needs = nodes[first], keys[first], np.where(met, MET, needs[first])
            begin, size = _runs(keys >> U64(48))
            for i, n in zip(begin.tolist(), size.tolist()):
                part = slice(i, i + n)
                for column, value in zip(rows, (int(keys[i]) >> 48, False, _packed(nodes[part], keys[part], needs[part]))):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "known", "entries"])

        for _, offsets, hashes in _shingled(batches, width):
            size, nodes = np.diff(offsets), _set_a(offsets, hashes)
            new = np.zeros(len(size), dtype=bool)
            for k, h in enumerate(nodes.tolist()):
                new[k] = size[k] and h not in seen
                seen.add(h)
            if len(seen) > REMEMBERED:
                seen.clear()
            owner, keys, needs = segment_keys(np.concatenate([[0], np.cumsum(size[new])]), hashes[np.repeat(new, size)], bands)
            if len(keys):
                held.append((nodes[new][owner], keys, needs))
                count += len(keys)
            if count >= HELD_KEYS:
                yield batch()
                held.clear()
                count = 0
        if held:
            yield batch()

    def meet(batches):
        import pyarrow as pa

        def rows(nodes, keys, needs):
            for i in range(0, len(nodes), 100_000):
                columns = [pa.array(x[i : i + 100_000].astype(kind)) for x, kind in ((nodes, np.int64), (keys, np.int64), (needs, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "key", "need"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            for bucket, known, entries in zip(*(c.to_pylist() for c in b.columns)):
                if known:
                    n = len(entries) // 18
                    yield from rows(np.frombuffer(entries, "<u8", n), np.frombuffer(entries, "<u8", n, 8 * n), np.frombuffer(entries, "<u2", n, 16 * n))
                else:
                    held.append(_unpacked(entries, bucket))
        if held:
            nodes, keys, needs = map(np.concatenate, zip(*held))
            held.clear()
            order = np.argsort(keys, kind="stable")
            nodes, keys, needs = nodes[order], keys[order], needs[order]
            first, size = _runs(keys)
            met = np.minimum.reduceat(nodes, first) < np.maximum.reduceat(nodes, first)
            met |= np.maximum.reduceat(needs, first) == MET
            keep = np.repeat(met, size) & (needs != MET)
            yield from rows(nodes[keep], keys[keep], needs[keep])
        give_back()

    texts = df.select(F.col(text_col).cast("string").alias("t"))
    packed = texts.mapInArrow(dealt, "bucket int, known boolean, entries binary")
    return packed.repartitionById(buckets, "bucket").mapInArrow(meet, "node long, key long, need int")


def _routed(shared: DataFrame) -> DataFrame:
    """(node, component_id): sets that share a routing key, directly or through others."""
    # a set that shares fewer keys than a link takes has none: a common passage alone seldom gives enough
    agreed = F.count("*").over(Window.partitionBy("node", "need"))
    met = shared.repartition("node", "need").distinct().withColumn("agreed", agreed).filter(F.col("agreed") >= F.expr("need div 2"))
    met = written(met.select("node", "key"), "met")
    let_go(met.sparkSession)
    hubs = met.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    # written: a join of two plain exchanges is one that adaptive execution can split at a hot key
    hubs = written(hubs.select("key", "hub"), "hubs")
    return connected_components(met.join(hubs, "key").filter("node > hub").select(F.col("node").alias("u"), F.col("hub").alias("v")))


def _tasks(clusters: DataFrame, num: int, den: int) -> DataFrame:
    """(class_id, cluster, a, i, b, j, side): which bounded block pairs each class takes part in.

    A small cluster is one task (0, 0, 0, 0). A large one is cut by size band - linked sets are of one band or
    neighbouring ones - and each band into blocks by hash; each pair of blocks that may hold links is one task.
    """
    whole = Window.partitionBy("cluster")
    step = math.log(1.01 * den / num)
    rows = clusters.withColumn("band", F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / F.lit(step)).cast("int"))
    per_band = rows.groupBy("cluster", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("m") / BLOCK_SHINGLES)).cast("int")
    fits = (F.sum("n").over(whole) <= BLOCK_SETS) & (F.sum("m").over(whole) <= BLOCK_SHINGLES)
    order = whole.orderBy("band")
    per_band = per_band.select("cluster", "band", blocks.alias("blocks"), fits.alias("fits"))
    for name, f in (("below", F.lag), ("above", F.lead)):
        near = F.abs(f("band").over(order) - F.col("band")) == 1
        per_band = per_band.withColumn(name, F.when(near, f("blocks").over(order)).otherwise(0))
    i = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    rows = rows.join(per_band, ["cluster", "band"]).withColumn("i", i)

    def task(a, i, b, j, side):
        return F.struct(*(x.cast("int").alias(n) for n, x in (("a", a), ("i", i), ("b", b), ("j", j), ("side", side))))

    band, own, zero = F.col("band"), F.col("i"), F.lit(0)
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    many = F.concat(
        F.transform(upto("blocks"), lambda j: task(band, F.least(own, j), band, F.greatest(own, j), (own > j).cast("int"))),
        F.transform(upto("above"), lambda j: task(band, own, band + 1, j, zero)),
        F.transform(upto("below"), lambda j: task(band - 1, j, band, own, F.lit(1))),
    )
    tasks = F.when(F.col("fits"), F.array(task(zero, zero, zero, zero, zero))).otherwise(many)
    return rows.select("class_id", "cluster", F.explode(tasks).alias("t")).select("class_id", "cluster", "t.*")


def jaccard_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable by links).

    Words are split at ASCII white space after lower-casing A-Z; two texts link when den * intersection >= num * union
    of their sets of ``width``-word shingles. A null text, an empty one or one without words has no shingles and links with
    nothing; one with fewer words is one shingle. Rows that repeat an id are one document there; a row with a null id
    takes its class's component and is never a component's name. Other columns are not looked at.
    """
    bands = Bands(num, den)
    sets = written(_set_rows(df, id_col, text_col, width), "sets")
    same = ["n_shingles", "set_a", "set_b"]
    # written: a join of two plain exchanges is one that adaptive execution splits where a class has many copies
    named = written(sets.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("class_id")), "named")
    members = written(sets.join(named, same, "left").select("doc_id", "n_shingles", "class_id"), "members")
    # a set is named by one of its hashes here; sets that share it are in one cluster, and told apart by the search
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shingles = sets.agg(F.sum("n_shingles")).first()[0] or 0  # keys are seldom more
    routed = _routed(_shared_keys(df, text_col, width, bands, min(BUCKETS, max(parts, math.ceil(shingles / BUCKET_KEYS)))))
    routed = routed.select(F.col("node").alias("set_a"), F.col("component_id").alias("cluster"))
    clusters = named.join(routed, "set_a").groupBy("class_id", "cluster").agg(F.max("n_shingles").alias("n_shingles"))
    tasks = written(_tasks(clusters, num, den), "tasks")
    n_tasks = tasks.count()
    texts = df.select(F.col(id_col).alias("class_id"), F.col(text_col).cast("string").alias("text"))
    if n_tasks <= BROADCAST_ROWS:
        work = texts.join(F.broadcast(tasks), "class_id")
    else:  # texts of no task stay where they are
        texts = sieved(texts, "class_id", tasks.select("class_id"), n_tasks, "maybe").filter("maybe").drop("maybe")
        work = texts.join(tasks, "class_id")
    key = ["cluster", "a", "i", "b", "j"]

    def search(batches):
        import pandas as pd
        import pyarrow as pa

        for pdf in keyed_groups(batches, key):
            text = pa.array(pdf["text"], pa.string())
            size, chunks = [], []
            for i, j in slices(pdf["text"].tolist(), lambda t: len(t or "") + 64, CHARS_AT_ONCE):
                o, h = shingle_sets(text.slice(i, j - i), width)
                size.append(np.diff(o))
                chunks.append(h)
            offsets, hashes = np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(chunks)
            keys = pdf[key].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            ids, side, out = pdf["class_id"].to_numpy(), pdf["side"].to_numpy(), []
            for i, j in zip(cuts, cuts[1:]):
                part = offsets[i : j + 1] - offsets[i]
                for q, s in t_occurrence_links(part, hashes[offsets[i] : offsets[j]], side[i:j], num, den):
                    out.append((ids[i + q], ids[i + s]))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
        give_back()

    kind = df.schema[id_col].dataType.simpleString()
    n_parts = max(parts, math.ceil(n_tasks / TASK_ROWS))
    dealt = work.repartition(n_parts, *key).sortWithinPartitions(*key)
    links = dealt.mapInPandas(search, f"u {kind}, v {kind}")
    groups = connected_components(links).withColumnRenamed("node", "class_id")
    return members.join(groups, "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "class_id", "doc_id").alias("component_id")
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One whole row of ``df`` for each group of near copies: that of the least id; a null id comes after all others. Where rows
    repeat an id, or have none, they are told apart by a number of their own, and of those alike in id the one
    with the least number stays. Rows without words are no group and all stay."""
    rows, key = own_key(df, id_col)
    groups = jaccard_groups(rows, key, text_col, width, num, den)
    if key != id_col:
        # groups are named by row numbers here: the row to stay is the one with the least id
        named = written(groups.filter("n_shingles > 0").join(rows.select(F.col(key).alias("doc_id"), F.col(id_col).alias("id")), "doc_id"), "groups")
        order = F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("key"))
        stay = written(named.groupBy("component_id").agg(F.min(order)["key"].alias("stay")), "stay")
        dropped = named.join(stay, "component_id").filter("doc_id != stay")
    else:
        dropped = groups.filter("doc_id != component_id")
    return without_ids(rows, dropped.select("doc_id"), key).select(*df.columns)


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) END AS s FROM words
),
classes AS (SELECT s, min(doc_id) AS cls FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT cls, unnest(s) AS h FROM classes),
sizes AS (SELECT cls, len(s) AS n FROM classes),
pairs AS (SELECT a.cls AS u, b.cls AS v, count(*) AS common FROM items a JOIN items b ON a.h = b.h AND a.cls < b.cls GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.cls = u JOIN sizes y ON y.cls = v WHERE 100*common >= 90*(x.n + y.n - common)),
either AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT cls, cls AS least FROM classes UNION SELECT v, least FROM reach JOIN either ON u = reach.cls WHERE least < v),
names AS (SELECT cls, min(least) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN names USING (cls)
"""
