"""Statistics of every shared prefix of conversations, by double-array tries of prefix shards (operator 13).

Equal conversations become one path of turn digests. Paths sorted by their digests are cut into shards of bounded size; a shard's trie is
packed into BASE and CHECK over dense turn ids and traversed. Only nodes on a shard's first and last path can occur in other shards too:
their parts are merged globally, all others are whole. Paths are cut every ``SEGMENT`` turns, and what hangs below a cut
is handed up a level at a time, so that neither a long conversation nor a common one is ever in one row or one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, written
from .double_array import DoubleArray, dense
from .words import VISIBLE, bounds, lowered

#: Turns of a path in one trie, and bytes of paths in a shard.
SEGMENT, SHARD_BYTES = 256, 2 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digests(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, digest, tokens): 16 bytes of SHA-256 of role and text, and the text's words between ASCII white space."""

    def digested(batches):
        import pyarrow as pa

        for b in batches:
            role, text = (b.column(i).to_pylist() for i in (2, 3))
            raw, offsets = lowered(b.column(3))
            tokens = np.diff(bounds(raw, offsets, VISIBLE)[0])
            own = [hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest()[:16] for r, t in zip(role, text)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary()), pa.array(tokens.astype(np.int64))], ["conv_id", "turn", "digest", "tokens"])

    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")

    rows = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), filled(role_col).alias("r"), filled(text_col).alias("x"))
    kind = df.schema[turn_col].dataType.simpleString()
    return rows.mapInArrow(digested, f"conv_id long, turn {kind}, digest binary, tokens long")


def with_places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with place, from 0 in each group (a whole number) by ``order``: sorted ranges count within tasks, and a group torn between
    ranges adds the sizes of its earlier parts, of which there are no more than two a range."""
    kept = [c for c in rows.columns if c != group]

    def numbered(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            at = np.arange(len(ids))
            new = np.append(ids[0] != last, ids[1:] != ids[:-1])
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            first = np.argmax(new) if new.any() else len(ids)
            place[:first] = at[:first] + held
            last, held = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place), pa.array(np.full(len(ids), part))], [group, *kept, "place", "part"])

    ranged = rows.select(group, *kept).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = written(ranged.mapInArrow(numbered, f"{fields}, place long, part long"), "placed")
    ends = placed.groupBy("part").agg(F.min(group).alias("a"), F.max(group).alias("z"))
    torn = ends.select("part", F.explode(F.array_distinct(F.array("a", "z"))).alias(group)).groupBy(group).agg(F.count("*").alias("n"))
    torn = torn.filter("n > 1").select(group)
    sizes = placed.join(F.broadcast(torn), group).groupBy(group, "part").agg(F.count("*").alias("n"))
    before = sizes.select(group, "part", (F.sum("n").over(Window.partitionBy(group).orderBy("part")) - F.col("n")).alias("before"))
    out = placed.join(F.broadcast(before), [group, "part"], "left")
    return out.withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("part", "before")


def rebuilt(placed: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, digest, tokens) and conversations (conv_id) where each conversation c takes over the first h turns of conversation
    c - c % family, and goes on with its own after its first h; h is the CRC-32 of c's digits modulo ``most``."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % family
    turn = F.struct("place", "digest", "tokens")
    heads = placed.filter((F.col("conv_id") == base) & (F.col("place") < most - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = placed.filter("place = 0").select("conv_id", base.alias("base"), h.cast("int").alias("h"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = written(convs.select("conv_id", "h", head.alias("head")), "heads")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    # own turns move up where fewer than h were taken over
    short = convs.filter(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).cast("long").alias("short"))
    own = placed.filter(F.col("place") >= h).join(short, "conv_id", "left")
    own = own.withColumn("place", F.col("place") - F.coalesce("short", F.lit(0)))
    return taken.select("conv_id", "place", "digest", "tokens").unionByName(own.select("conv_id", "place", "digest", "tokens")), convs.select("conv_id")


def _segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, seq, tokens, sha, k1, k2, n1, n2): the digests and tokens of each stretch of ``segment`` turns, and keys of the path before
    it and with it. Every conversation ends in a stretch of fewer turns, be it of none."""
    place = F.col("place")
    turn = F.struct("place", F.hex("digest").alias("digest"), "tokens")
    rows = turns.select("conv_id", F.floor(place / segment).alias("seg"), turn.alias("t"))
    none = F.lit(None).cast(rows.schema["t"].dataType).alias("t")
    starts = convs.select("conv_id", F.lit(0).cast("long").alias("seg"), none)
    nexts = turns.filter((place + 1) % segment == 0).select("conv_id", F.floor((place + 1) / segment).alias("seg"), none)
    lists = rows.unionByName(starts).unionByName(nexts).groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list("t")).alias("t"))
    out = lists.select(
        "conv_id",
        "seg",
        F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("seq"),
        F.transform("t", lambda t: t["tokens"]).alias("tokens"),
    )
    out = written(out.withColumn("sha", F.unhex(F.sha2("seq", 256))), "segments")
    lanes = {f"x{i}": F.xxhash64(F.lit(i), "seg", "sha") for i in (1, 2)}
    if not (out.agg(F.max("seg")).first()[0] or 0):
        zero = F.lit(0).cast("long")
        return out.withColumns({"k1": zero, "k2": zero, "n1": zero, "n2": zero})
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns(lanes)
    out = out.withColumns({f"k{i}": F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0).cast("long")) for i in (1, 2)})
    return out.withColumns({f"n{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}).drop("x1", "x2")


def _ends(segments: DataFrame, classes: DataFrame) -> DataFrame:
    """(seg, least, ends): the SHA-256 of the ascending ids of each class of several conversations that end there. Sorted ranges join
    their ids to texts, so that a class's last task hashes a few long pieces."""
    names = ["seg", "k1", "k2", "sha"]
    many = written(classes.filter("n > 1 and ended").select(*names, "least"), "many")
    few = many.count() <= BROADCAST_IDS
    rows = segments.select(*names, "conv_id").join(F.broadcast(many) if few else many, names).select("least", "seg", "conv_id")

    def joined(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            least, seg = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(least):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (seg[1:] != seg[:-1]), [True]]))
            ids = b.column(2).to_pylist()
            texts = [",".join(map(str, ids[i:j])) for i, j in zip(cuts, cuts[1:])]
            at = cuts[:-1]
            places = pa.array(np.arange(no, no + len(at)))
            no += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(least[at]), pa.array(seg[at]), pa.array(np.full(len(at), part)), places, pa.array(texts, pa.string())], ["least", "seg", "part", "no", "ids"])

    ranged = rows.repartitionByRange("least", "seg", "conv_id").sortWithinPartitions("least", "seg", "conv_id")
    pieces = written(ranged.mapInArrow(joined, "least long, seg long, part long, no long, ids string"), "ids")

    def hashed(batches):
        import pyarrow as pa

        key, state = None, None
        for b in batches:
            out: list = [[], [], []]
            for least, seg, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))):
                if (least, seg) != key:
                    if key:
                        for c, v in zip(out, (*key, state.hexdigest())):
                            c.append(v)
                    key, state = (least, seg), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"least": pa.array(out[0], pa.int64()), "seg": pa.array(out[1], pa.int64()), "ends": pa.array(out[2], pa.string())})
        if key:
            yield pa.RecordBatch.from_pydict({"least": [key[0]], "seg": [key[1]], "ends": [state.hexdigest()]})

    return pieces.repartition("least", "seg").sortWithinPartitions("least", "seg", "part", "no").mapInArrow(hashed, "least long, seg long, ends string")


NODE = (
    "shared boolean, key binary, path array<binary>, parent_key binary, k1 long, k2 long, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, tokens long, below boolean, ends string"
)


def shard_nodes(pdf, segment: int):
    """The nodes of one shard's trie as a pandas frame of ``NODE``: whole ones, and the shard's parts of those that may be shared."""
    import pandas as pd

    start = pdf[["k1", "k2"]].to_numpy(dtype=">i8")
    paths = [s.tobytes() + q for s, q in zip(start, pdf["seq"])]
    length = np.array([len(p) // 16 for p in paths])
    offsets = np.concatenate([[0], np.cumsum(length)])
    items = np.frombuffer(b"".join(paths), "V16")
    owner, level = np.repeat(np.arange(len(paths)), length), np.arange(len(items)) - np.repeat(offsets[:-1], length)
    symbols = dense(items, np.lexsort((owner, level)))
    trie = DoubleArray(symbols, offsets)
    state, size = trie.walk(symbols, offsets), len(trie.check)
    n, children, leaves, saved, tokens, depth = (np.zeros(size, np.int64) for _ in range(6))
    least = np.full(size, np.iinfo(np.int64).max)
    np.add.at(n, state, pdf["n"].to_numpy()[owner])
    np.minimum.at(least, state, pdf["least"].to_numpy()[owner])
    own = [np.append(0, t) for t in pdf["tokens"]]
    tokens[state], depth[state] = np.concatenate(own), level
    shared, below = np.zeros(size, bool), np.zeros(size, bool)
    shared[state[: offsets[1]]] = shared[state[offsets[-2] :]] = True
    last = state[offsets[1:] - 1]
    ends = np.full(size, None, object)
    ends[last] = pdf["ends"].to_numpy(object)
    on = pdf["x_children"].notna().to_numpy()
    below[last[on]] = True
    for total, name in ((children, "x_children"), (leaves, "x_leaves"), (saved, "x_saved")):
        total[last[on]] = pdf[name].to_numpy()[on].astype(np.int64)
    node = np.flatnonzero(trie.check >= 0)
    whole = node[~shared[node]]
    inner = whole[depth[whole] > 0]
    np.add.at(children, trie.check[inner], 1)
    leaves[whole] += (children[whole] == 0) & ~below[whole]
    saved[whole] += (n[whole] - 1) * tokens[whole]
    for d in range(int(depth[whole].max(initial=0)), 0, -1):  # from the leaves up
        at = inner[depth[inner] == d]
        np.add.at(leaves, trie.check[at], leaves[at])
        np.add.at(saved, trie.check[at], saved[at])
    keys, path = np.full(size, None, object), np.full(size, None, object)
    for i in {0, len(paths) - 1}:
        running, above = hashlib.sha256(), []
        for j, s in enumerate(state[offsets[i] : offsets[i + 1]]):
            running.update(paths[i][16 * j : 16 * j + 16])
            keys[s], path[s] = running.digest()[:16], list(above)
            above.append(keys[s])
    parent = np.where(depth[node] > 0, trie.check[node], 0)
    lanes = np.zeros((size, 2), np.int64)
    lanes[state[offsets[:-1]]] = start
    up = [int(least[p]) if p and not shared[p] else None for p in parent]
    columns = {"shared": shared[node], "key": keys[node], "path": path[node], "parent_key": keys[parent], "k1": lanes[node, 0], "k2": lanes[node, 1]}
    columns |= {"depth": depth[node], "conv_id": least[node], "parent_conv_id": pd.array(up, "Int64"), "n_convs": n[node], "n_children": children[node]}
    columns |= {"n_leaves": leaves[node], "saved_tokens": saved[node], "tokens": tokens[node], "below": below[node], "ends": ends[node]}
    return pd.DataFrame(columns)


def _tries(classes: DataFrame, segment: int, shard_bytes: int) -> DataFrame:
    ranged = classes.repartitionByRange("k1", "k2", "seq").sortWithinPartitions("k1", "k2", "seq")
    columns = ["k1", "k2", "seq", "tokens", "n", "least", "ends", "x_children", "x_leaves", "x_saved"]

    def nodes(batches):
        import pandas as pd

        held, size = [], 0
        for pdf in batches:
            weight = np.cumsum(pdf["seq"].map(len).to_numpy() + 96)
            shard, begin = (weight + size) // shard_bytes, 0
            for at in np.flatnonzero(np.append(shard[1:] != shard[:-1], False)) + 1:
                yield shard_nodes(pd.concat([*held, pdf.iloc[begin:at]]), segment)
                held, begin = [], at
            held.append(pdf.iloc[begin:])
            size = int(weight[-1] + size) % shard_bytes if len(weight) else size
        held = [h for h in held if len(h)]
        if held:
            yield shard_nodes(pd.concat(held), segment)

    return ranged.select(*columns).mapInPandas(nodes, NODE)


def _level(classes: DataFrame, level: int, segment: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of one level: the nodes below the starts of its stretches, and the starts themselves with their keys k1 and k2."""
    out = written(_tries(classes, segment, shard_bytes), "tries")
    merged = out.filter("shared").groupBy("key").agg(
        *(F.first(c).alias(c) for c in ("path", "parent_key", "k1", "k2", "depth", "tokens")),
        F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        F.max("below").alias("below"),
        F.max("ends").alias("ends"),
    )
    merged = written(merged, "merged")
    kids = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    own_leaf = ((F.col("n_children") == 0) & ~F.col("below")).cast("long")
    merged = written(
        merged.withColumns({"n_leaves": F.col("n_leaves") + own_leaf, "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("tokens")}).drop("kids"), "shared"
    )
    up = merged.select(F.explode(F.concat("path", F.array("key"))).alias("key"), "n_leaves", "saved_tokens")
    totals = up.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    merged = written(merged.drop("n_leaves", "saved_tokens").join(totals, "key"), "upper")
    rest = ["k1", "k2", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    nodes = out.filter("not shared").select(*rest, "parent_key").unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*rest, "parent_key"))
    nodes = nodes.join(names, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    tops = nodes.filter("depth = 0").select(*rest)
    deeper = F.col("depth") + level * segment
    return nodes.filter("depth > 0").select(*rest).withColumn("depth", deeper), tops


def prefix_nodes(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per distinct prefix of the conversations ``convs`` (conv_id, each once), whose turns are (conv_id, place, digest, tokens) with
    places from 0: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Digests of 16 bytes stand for turns, and two 64-bit hashes for a path at a cut. An empty input gives no rows.
    """
    segments = written(_segments(turns, convs, segment), "paths")
    names = ["seg", "k1", "k2", "sha"]
    classes = segments.groupBy(*names).agg(
        *(F.first(c).alias(c) for c in ("seq", "tokens", "n1", "n2")), F.count("*").alias("n"), F.min("conv_id").alias("least")
    )
    classes = written(classes.withColumn("ended", F.octet_length("seq") < 16 * segment), "classes")
    alone = F.when(F.col("ended") & (F.col("n") == 1), F.sha2(F.col("least").cast("string"), 256))
    classes = classes.join(_ends(segments, classes).withColumnRenamed("ends", "several"), ["seg", "least"], "left").withColumn("ends", F.coalesce("several", alone))
    classes = written(classes.drop("several"), "classes")
    out, tops = None, None
    for level in range(classes.agg(F.max("seg")).first()[0] or 0, -1, -1):
        rows = classes.filter(F.col("seg") == level)
        if tops is None:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("x_children", "x_leaves", "x_saved")})
        else:
            below = tops.select(
                F.col("k1").alias("n1"),
                F.col("k2").alias("n2"),
                F.col("n_children").alias("x_children"),
                F.col("n_leaves").alias("x_leaves"),
                F.col("saved_tokens").alias("x_saved"),
                F.col("ends").alias("x_ends"),
                F.lit(False).alias("ended"),
            )
            rows = rows.join(below, ["n1", "n2", "ended"], "left").withColumn("ends", F.coalesce("ends", "x_ends"))
        nodes, tops = _level(rows, level, segment, shard_bytes)
        tops = written(tops, "tops")
        out = nodes if out is None else out.unionByName(nodes)
    out = out.unionByName(tops)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*columns, F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 0, most: int = 4, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The nodes of ``prefix_nodes`` of a table of turns.

    A conversation's turns go by turn, null first; rows alike in it go by the digest of role and text, and rows alike in all are as many
    turns. A null role or text is an empty one; rows without conv_id (a whole number) are of no conversation. With ``family`` each
    conversation starts with turns of the first of its family (see ``rebuilt``). Other columns are not looked at; no rows give no nodes.
    """
    placed = with_places(written(turn_digests(df, conv_col, turn_col, role_col, text_col), "turns"), "conv_id", ["turn", "digest"])
    if family:
        turns, convs = rebuilt(written(placed, "turns"), family, most)
    else:
        turns, convs = placed, placed.filter("place = 0").select("conv_id")
    return prefix_nodes(turns.select("conv_id", "place", "digest", "tokens"), convs, segment, shard_bytes)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), family=20, most=4)


_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, list(t ORDER BY place) AS own, hex(encode(conv_id::VARCHAR)) AS x,
    xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(x, 2 * i - 1, 2))::BIGINT for i in range(1, len(x) // 2 + 1)],
      lambda a, b: list_reduce([xor(a, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: {_STEP})), 4294967295) % 4 AS h
  FROM turns GROUP BY conv_id
),
paths AS (SELECT c.conv_id, coalesce(list_slice(b.own, 1, c.h), []) || list_slice(c.own, c.h + 1, len(c.own)) AS p FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
members AS (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS depth FROM paths),
named AS (SELECT *, sha256(depth || ':' || list_slice(p, 1, depth)::JSON::VARCHAR) AS node, CASE WHEN depth > 0 THEN sha256((depth - 1) || ':' || list_slice(p, 1, depth - 1)::JSON::VARCHAR) END AS parent FROM members),
nodes AS (
  SELECT node, any_value(parent) AS parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(p) = depth), '') AS ends,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(any_value(p)[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS tokens
  FROM named GROUP BY node, depth
),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT n.node, a.node AS top FROM named n JOIN named a ON a.conv_id = n.conv_id AND a.depth <= n.depth),
sums AS (
  SELECT top AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * tokens)::BIGINT AS saved_tokens
  FROM above JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""
