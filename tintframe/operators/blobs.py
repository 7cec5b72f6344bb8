"""Bright patches of an image and the lattice they lie on: components by tiles, proximity groups and fits, over all frames at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import eliminated
from ..sources.shared import written
from .components import connected_components

# The luminance levels patches are looked for at, and what a blob, a group and a lattice must be.
LEVELS = (0.045, 0.075, 0.11, 0.16, 0.23, 0.32, 0.44)
MAX_BLOBS, MIN_SIDE, MAX_SHARE, ASPECT, FILL = 1500, 5, 0.2, (0.6, 1.6), 0.4
SIZE_RATIO, REACH, GROUP = (0.7, 1.43), 1.6, (14, 24)
COHERENCE, MIN_SPAN, SHAPE, PIVOT = 0.75, 48.0, (1.15, 2.20), 1e-9
COLUMNS, ROWS = 6, 4


#: Side of the square tiles in which patches are first looked for.
TILE = 256


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each of ``n`` nodes' components under the edges u, v: larger roots go to smaller ones until none is left."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v = u[apart], v[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def tile_parts(light: DataFrame, levels: tuple[float, ...] = LEVELS, tile: int = TILE) -> DataFrame:
    """frame, level, y, x, x0, x1, y0, y1, area, rim: the components of the pixels of ``light`` (frame, y, x, light) above each level within square tiles,
    named by their first pixel; rim are the pixels on a tile's border, which may go on in the next one. A task holds one tile."""
    steps = sorted(set(levels))

    def parts(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["y", "x"])
        py, px, above = pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["light"].to_numpy()
        level, at = np.nonzero((above > np.array(steps)[:, None]) | np.isnan(above))  # a NaN is above all in Spark
        y, x = py[at], px[at]
        first = np.ones(len(y), dtype=bool)
        first[1:] = (level[1:] != level[:-1]) | (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
        run = np.cumsum(first) - 1
        dense = np.full((len(steps), py.max() - py.min() + 2, px.max() - px.min() + 1), -1)
        top, left = y - py.min(), x - px.min()
        dense[level, top, left] = run
        below = dense[level, top + 1, left]
        name = _joined(int(first.sum()), run[below >= 0], below[below >= 0])
        heads, part = np.unique(name[run], return_inverse=True)
        head = np.flatnonzero(first)[heads]
        out = {"frame": pdf["frame"].iloc[0], "level": np.array(steps)[level[head]], "y": y[head], "x": x[head]}
        for c, v in (("x", x), ("y", y)):
            out[f"{c}0"], out[f"{c}1"] = np.full(len(head), v.max(initial=0)), np.full(len(head), v.min(initial=0))
            np.minimum.at(out[f"{c}0"], part, v)
            np.maximum.at(out[f"{c}1"], part, v)
        out["area"] = np.bincount(part, minlength=len(head))
        rims = [[] for _ in head]
        border = ((x % tile == 0) & (x > 0)) | (x % tile == tile - 1) | ((y % tile == 0) & (y > 0)) | (y % tile == tile - 1)
        for i in np.flatnonzero(border):
            rims[part[i]].append({"y": int(y[i]), "x": int(x[i])})
        return pd.DataFrame(out | {"rim": rims})

    kind = light.schema["frame"].dataType.simpleString()
    bright = light.select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("light").cast("double").alias("light")).filter(F.col("light") > steps[0])
    tiles = bright.groupBy("frame", F.expr(f"y div {tile}").alias("ty"), F.expr(f"x div {tile}").alias("tx"))
    return tiles.applyInPandas(parts, f"frame {kind}, level double, y long, x long, x0 long, x1 long, y0 long, y1 long, area long, rim array<struct<y:long,x:long>>")


def blobs(light: DataFrame, sizes: DataFrame, levels: tuple[float, ...] = LEVELS, tile: int = TILE) -> DataFrame:
    """frame, level, blob, cx, cy, size: the components of each level that may be one patch. ``sizes`` (frame, width, height) are the images'. A
    frame with more than ``MAX_BLOBS`` at a level has none there. Parts of tiles that go on beyond them are joined by connected components."""
    parts = written(tile_parts(light, levels, tile), "parts")
    boxes = parts.drop("rim").withColumn("blob", F.struct("y", "x")).drop("y", "x")
    node = F.struct("frame", "level", "y", "x")
    rims = parts.filter(F.size("rim") > 0).select("frame", "level", node.alias("part"), F.explode("rim").alias("at")).select("frame", "level", "part", "at.y", "at.x")
    if not rims.isEmpty():
        ahead = F.explode(F.array(F.struct("y", (F.col("x") + 1).alias("x")), F.struct((F.col("y") + 1).alias("y"), "x"))).alias("to")
        edges = rims.select("frame", "level", F.col("part").alias("u"), ahead).select("frame", "level", "u", "to.y", "to.x")
        edges = edges.join(rims.withColumnRenamed("part", "v"), ["frame", "level", "y", "x"]).select("u", "v").filter("u <> v")
        named = parts.drop("rim").withColumn("node", node).join(connected_components(edges), "node", "left").withColumn("whole", F.coalesce("component", "node"))
        low, high = (F.min(c).alias(c) for c in ("x0", "y0")), (F.max(c).alias(c) for c in ("x1", "y1"))
        boxes = named.groupBy("frame", "level", F.struct("whole.y", "whole.x").alias("blob")).agg(*low, *high, F.sum("area").alias("area"))
    w, h, area = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1, F.col("area")
    inside = (F.col("x0") > 0) & (F.col("y0") > 0) & (F.col("x1") + 1 < F.col("width")) & (F.col("y1") + 1 < F.col("height"))
    fair = (F.least(w, h) >= MIN_SIDE) & (F.greatest(w, h) <= MAX_SHARE * F.greatest("width", "height")) & (w / h).between(*ASPECT) & (area >= FILL * w * h)
    kept = boxes.join(sizes, "frame").filter(inside & fair)
    n = F.count("*").over(Window.partitionBy("frame", "level"))
    centre = {"cx": (F.col("x0") + F.col("x1") + 1) * 0.5, "cy": (F.col("y0") + F.col("y1") + 1) * 0.5, "size": F.sqrt(area.cast("double"))}
    kept = kept.withColumn("n", n).filter(F.col("n") <= MAX_BLOBS).withColumns(centre)
    return kept.select("frame", "level", F.struct(F.col("blob.y").cast("int").alias("y"), F.col("blob.x").cast("int").alias("x0")).alias("blob"), "cx", "cy", "size")


def groups(blobs: DataFrame) -> DataFrame:
    """``blobs`` with group, those of proximity groups of as many blobs as a chart may show: blobs of like size that touch as neighbours of a lattice do.
    A frame's level has at most ``MAX_BLOBS`` blobs, so all its pairs are bounded; a task holds one frame."""

    def grouped(pdf):
        import pandas as pd

        out = []
        for _, rows in pdf.groupby("level"):
            rows = rows.sort_values(["y", "x"])
            cx, cy, size = (rows[c].to_numpy() for c in ("cx", "cy", "size"))
            us, vs = [], []
            for i in range(len(rows) - 1):
                ratio, dx, dy = size[i] / size[i + 1 :], cx[i] - cx[i + 1 :], cy[i] - cy[i + 1 :]
                near = (ratio >= SIZE_RATIO[0]) & (ratio <= SIZE_RATIO[1]) & (np.sqrt(dx * dx + dy * dy) <= REACH * np.maximum(size[i], size[i + 1 :]))
                met = np.flatnonzero(near) + i + 1
                us.append(np.full(len(met), i))
                vs.append(met)
            name = _joined(len(rows), np.concatenate(us), np.concatenate(vs)) if us else np.zeros(1, np.int64)
            n = np.bincount(name, minlength=len(rows))[name]
            rows = rows.assign(gy=rows["y"].to_numpy()[name], gx=rows["x"].to_numpy()[name])
            out.append(rows[(n >= GROUP[0]) & (n <= GROUP[1])])
        return pd.concat(out)

    kind = blobs.schema["frame"].dataType.simpleString()
    flat = blobs.select("frame", "level", "blob.y", F.col("blob.x0").alias("x"), "cx", "cy", "size")
    found = flat.groupBy("frame").applyInPandas(grouped, f"frame {kind}, level double, y int, x int, cx double, cy double, size double, gy int, gx int")
    at = lambda y, x: F.struct(F.col(y).alias("y"), F.col(x).alias("x0"))
    return found.select("frame", "level", at("y", "x").alias("blob"), "cx", "cy", "size", at("gy", "gx").alias("group"))


def lattices(members: DataFrame) -> DataFrame:
    """frame, level, group, pitch, theta, coherence and x0 to y3: the chart corners of each group of blobs (``groups``) that lies on a lattice of six by
    four, by a bilinear fit to the cells its blobs fall in; groups that do not are left out. Theta is the circular mean of the quadrupled
    angles to nearest neighbours, so a quarter turn makes no difference."""
    key = ["frame", "level", "group"]
    members = written(members, "members")  # met twice below
    other = members.select(*key, F.col("blob").alias("to"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    # no more than 24 a group, so these pairs are few
    pairs = members.join(other, key).filter("blob != to").withColumns({"dx": F.col("tx") - F.col("cx"), "dy": F.col("ty") - F.col("cy")})
    pairs = pairs.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    best = pairs.groupBy(*key, "blob").agg(F.min(F.struct("d", "to", "dx", "dy")).alias("near")).select(*key, "near.*")
    turn = 4 * F.atan2("dy", "dx")
    sums = best.groupBy(*key).agg(F.sum(F.sin(turn)).alias("s"), F.sum(F.cos(turn)).alias("c"), F.count("*").alias("n"), F.array_sort(F.collect_list("d")).alias("ds"))
    middle = F.element_at("ds", F.floor(F.col("n") / 2).cast("int") + 1)
    axes = sums.select(*key, "n", F.hypot("s", "c").alias("h"), middle.alias("pitch"), (F.atan2("s", "c") / 4).alias("theta")).withColumn("coherence", F.col("h") / F.col("n"))
    axes = axes.filter(F.col("coherence") >= COHERENCE).drop("h")
    rows = members.join(axes, key).withColumns({"p": F.col("cx") * F.cos("theta") + F.col("cy") * F.sin("theta"), "q": F.col("cy") * F.cos("theta") - F.col("cx") * F.sin("theta")})
    whole = Window.partitionBy(*key)
    rows = rows.withColumns({f"{n}_{c}": f(c).over(whole) for c in "pq" for n, f in (("low", F.min), ("high", F.max))})
    flat = (F.col("high_p") - F.col("low_p")) < (F.col("high_q") - F.col("low_q"))
    rows = rows.withColumn("turned", flat)
    # the longer extent is u; a turn by a right angle makes the other axis negative
    u = F.when(F.col("turned"), F.col("q") - F.col("low_q")).otherwise(F.col("p") - F.col("low_p"))
    v = F.when(F.col("turned"), F.col("high_p") - F.col("p")).otherwise(F.col("q") - F.col("low_q"))
    rows = rows.withColumns({"col": F.round(u / F.col("pitch")).cast("int"), "row": F.round(v / F.col("pitch")).cast("int")})
    b = {"b0": F.lit(1.0), "b1": (F.col("col") + 0.5) / COLUMNS, "b2": (F.col("row") + 0.5) / ROWS}
    rows = rows.withColumns(b).withColumn("b3", F.col("b1") * F.col("b2"))
    products = [F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"e{i}{j}") for i in range(4) for j in range(i, 4)]
    products += [F.sum(F.col(f"b{i}") * F.col(c)).alias(f"{s}{i}") for i in range(4) for s, c in (("f", "cx"), ("g", "cy"))]
    place = F.col("row") * COLUMNS + F.col("col")
    fits = rows.groupBy(*key).agg(
        *(F.first(c).alias(c) for c in ("pitch", "theta", "coherence")),
        F.bool_and(F.col("col").between(0, COLUMNS - 1) & F.col("row").between(0, ROWS - 1)).alias("inside"),
        (F.count_distinct(place) == F.count("*")).alias("apart"),
        (F.max("col") == COLUMNS - 1).alias("wide"),
        (F.max("row") == ROWS - 1).alias("tall"),
        *products,
    )
    fits = fits.filter("inside and apart and wide and tall")
    system = F.array(*(F.array(*(F.col(f"e{min(i, j)}{max(i, j)}") for j in range(4)), F.col(f"f{i}"), F.col(f"g{i}")) for i in range(4)))
    fits = fits.withColumn("fit", eliminated(system, 4, PIVOT)).filter("fit is not null")
    at = lambda k, *basis: sum((F.col("fit")[i][k] * b for i, b in enumerate(basis) if b), F.lit(0.0))
    corners = {f"{a}{i}": at(k, 1, cu, cv, cu * cv) for i, (cu, cv) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for k, a in enumerate("xy")}
    fits = fits.withColumns(corners)
    length = lambda i, j: F.sqrt(F.pow(F.col(f"x{i}") - F.col(f"x{j}"), 2) + F.pow(F.col(f"y{i}") - F.col(f"y{j}"), 2))
    width, height = (length(0, 1) + length(2, 3)) * 0.5, (length(0, 3) + length(1, 2)) * 0.5
    return fits.filter((width >= MIN_SPAN) & (width / height).between(*SHAPE)).select(*key, "pitch", "theta", "coherence", *corners)
