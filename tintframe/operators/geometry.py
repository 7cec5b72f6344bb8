"""Patch polygons from a chart's corners, and the containment join of pixels with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.chart import COLUMNS, ROWS

TILE = 32
#: The corners of a patch within its cell: the central 60 %.
PATCH_ENDS = ((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8))


def bilinear(corners: list[tuple[Column, Column]], u: Column, v: Column) -> tuple[Column, Column]:
    """The image point of chart coordinates; corners in the order top left, top right, bottom right, bottom left."""
    tl, tr, br, bl = corners
    return tuple((1 - u) * (1 - v) * tl[k] + u * (1 - v) * tr[k] + u * v * br[k] + (1 - u) * v * bl[k] for k in (0, 1))  # type: ignore[return-value]


def patch_polygons(quads: DataFrame) -> DataFrame:
    """``quads``: frame, x0, y0 ... x3, y3. For each of the 24 patches the central 60 % of its cell, as px0, py0 ... px3, py3, with the
    bounds min_x, max_x, min_y, max_y of pixels that may lie inside."""
    cells = quads.select("*", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS * ROWS - 1))).alias("patch_idx"))
    corners = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    column, row = F.col("patch_idx") % COLUMNS, F.expr(f"patch_idx div {COLUMNS}")
    at = lambda cell, share, n: (cell + share) / float(n)
    out = cells
    for i, (du, dv) in enumerate(PATCH_ENDS):
        x, y = bilinear(corners, at(column, du, COLUMNS), at(row, dv, ROWS))
        out = out.withColumns({f"px{i}": x, f"py{i}": y})
    for axis in "xy":
        points = [F.col(f"p{axis}{i}") for i in range(4)]
        out = out.withColumns(
            {f"min_{axis}": F.floor(F.least(*points)).cast("int"), f"max_{axis}": F.ceil(F.greatest(*points)).cast("int")}
        )
    return out.drop(*(f"{a}{i}" for a in "xy" for i in range(4)))


def inside() -> Column:
    """Whether the pixel centre (x + .5, y + .5) is in the polygon px, py: on one side of all its edges, borders included."""
    turns = []
    for i in range(4):
        j = (i + 1) % 4
        ax, ay, bx, by = (F.col(n) for n in (f"px{i}", f"py{i}", f"px{j}", f"py{j}"))
        turns.append((bx - ax) * (F.col("y") + 0.5 - ay) - (by - ay) * (F.col("x") + 0.5 - ax))
    return (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)


def pixels_in_patches(pixels: DataFrame, polygons: DataFrame, on: list[str]) -> DataFrame:
    """Pixels (x, y and ``on``) joined with the polygons that hold them.

    Both sides carry the number of a square tile of ``TILE`` pixels, of which a polygon has all that its bounds touch, so the join is
    an equality and a pixel meets only the polygons of its tile.
    """
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    tiled = polygons.withColumn("__ty", F.explode(F.sequence(tile("min_y"), tile("max_y"))))
    tiled = tiled.withColumn("__tx", F.explode(F.sequence(tile("min_x"), tile("max_x"))))
    placed = pixels.withColumns({"__tx": tile("x"), "__ty": tile("y")})
    return placed.join(tiled, [*on, "__tx", "__ty"]).filter(inside()).drop("__tx", "__ty")
