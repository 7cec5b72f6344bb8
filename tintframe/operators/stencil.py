"""Neighbourhood operators on mosaics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

RADIUS = 5


def clip_spread(sites: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``sites`` (frame, y, x, saturated; RGGB) with spread: bit 0, 1, 2 where a saturated red, green or blue site lies within ``radius``
    rows and columns. Two range windows, first along columns and then along rows, instead of a join of neighbours."""
    colour = F.when((F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), 1).when((F.col("y") % 2 == 1) & (F.col("x") % 2 == 1), 4).otherwise(2)
    down = Window.partitionBy("frame", "x").orderBy("y").rangeBetween(-radius, radius)
    across = Window.partitionBy("frame", "y").orderBy("x").rangeBetween(-radius, radius)
    bits = F.when(F.col("saturated"), colour).otherwise(0)
    return (
        sites.withColumn("bits", bits)
        .withColumn("bits", F.bit_or("bits").over(down))
        .withColumn("spread", F.bit_or("bits").over(across))
        .drop("bits")
    )


def oriented(sites: DataFrame, orientation: int, width: int, height: int) -> DataFrame:
    """``sites`` with up_x, up_y: the upright position for an EXIF orientation from 1 to 8."""
    x, y = F.col("x"), F.col("y")
    right, bottom = width - 1 - x, height - 1 - y
    to = {1: (x, y), 2: (right, y), 3: (right, bottom), 4: (x, bottom), 5: (y, x), 6: (bottom, x), 7: (bottom, right), 8: (y, right)}
    return sites.withColumns(dict(zip(("up_x", "up_y"), to[orientation], strict=True)))


def normalised(sites: DataFrame, black: list[int], white: list[int]) -> DataFrame:
    """``sites`` with value, a float from 0 on, by the levels of each of the four mosaic positions."""
    at = (F.col("y") % 2) * 2 + F.col("x") % 2 + 1
    level = lambda v: F.element_at(F.array(*map(F.lit, v)), at.cast("int"))
    return sites.withColumn("value", F.greatest((F.col("raw") - level(black)) / (level(white) - level(black)), F.lit(0.0)).cast("float"))


TILE = 256
#: Rows of tiles in a task, on average: their windows sort them again and again with all columns found so far.
TASK_ROWS = 100_000


def with_halo(sites: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """``sites`` (frame, y, x) dealt to square tiles, with tile_y, tile_x and home: a tile also gets the ``radius`` rows and columns around it, each
    once, as rows that are not at home there. One exchange serves all windows by tile that follow; its tasks follow the rows, not the bytes, which are few here
    and many once the windows have added their columns."""
    sites = written(sites, "sites")
    for axis in ("y", "x"):
        first = F.greatest(F.floor((F.col(axis) - radius) / tile), F.lit(0))
        sites = sites.withColumn(f"tile_{axis}", F.explode(F.sequence(first, F.floor((F.col(axis) + radius) / tile))))
    home = (F.floor(F.col("y") / tile) == F.col("tile_y")) & (F.floor(F.col("x") / tile) == F.col("tile_x"))
    sites = sites.withColumn("home", home)
    tasks = max(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sites.count() // TASK_ROWS))
    return sites.repartition(tasks, "frame", "tile_y", "tile_x")


def _line(axis: str) -> Window:
    """Sites of a tile in one row (axis x) or column (axis y), which need no exchange once tiles are together."""
    return Window.partitionBy("frame", "tile_y", "tile_x", "y" if axis == "x" else "x").orderBy(axis)


def shifted(value: str, axis: str, by: int):
    """The value ``by`` sites further along ``axis``, null beyond the tile and its halo."""
    return F.max(value).over(_line(axis).rangeBetween(by, by))


def around(value: str, axis: str, radius: int = 1):
    """The sum over ``radius`` sites to both sides along ``axis``."""
    return F.sum(value).over(_line(axis).rangeBetween(-radius, radius))


def reflected(sites: DataFrame, value: str, axis: str, by: int, name: str) -> DataFrame:
    """``sites`` with two columns: the value ``by`` sites further along ``axis`` (name_p) and as many back (name_m). One that is missing is its
    mirror image, and where both are, the site's own."""
    sites = sites.withColumns({f"{name}_p": shifted(value, axis, by), f"{name}_m": shifted(value, axis, -by)})
    p, m, own = F.col(f"{name}_p"), F.col(f"{name}_m"), F.col(value)
    return sites.withColumns({f"{name}_p": F.coalesce(p, m, own), f"{name}_m": F.coalesce(m, p, own)})


def cfa_colour(pattern: str = "RGGB"):
    """R, G or B of a site of a Bayer mosaic whose first two rows start with ``pattern``."""
    if sorted(pattern) != ["B", "G", "G", "R"] or pattern[0] == pattern[3] != "G" or (pattern[0] != "G" and pattern[1] != pattern[2]):
        raise ValueError(f"not a Bayer pattern: {pattern}")
    at = (F.col("y") % 2) * 2 + F.col("x") % 2 + 1
    return F.element_at(F.array(*map(F.lit, pattern)), at.cast("int"))


DIRECTIONS = {"h": "x", "v": "y"}


def directional_greens(sites: DataFrame, pattern: str = "RGGB") -> DataFrame:
    """Sites of tiles (value) with site, the colour there, and g_h, g_v: green interpolated along the row and along the column, corrected by the
    curvature of the site's own colour."""
    sites = sites.withColumn("site", cfa_colour(pattern))
    for d, axis in DIRECTIONS.items():
        sites = reflected(reflected(sites, "value", axis, 1, "one"), "value", axis, 2, "two")
        green = (F.col("one_p") + F.col("one_m")) * 0.5 + (2.0 * F.col("value") - F.col("two_p") - F.col("two_m")) * 0.25
        sites = sites.withColumn(f"g_{d}", F.when(F.col("site") == "G", F.col("value")).otherwise(green)).drop("one_p", "one_m", "two_p", "two_m")
    return sites


def directional_colours(sites: DataFrame) -> DataFrame:
    """Sites with r_h, b_h, r_v, b_v: both directions' red and blue from the mean colour difference of the nearest sites of that colour. At a corner
    that has one diagonal neighbour alone, it stands for all four."""
    site = F.col("site")
    for d in DIRECTIONS:
        sites = sites.withColumn("diff", F.col("value") - F.col(f"g_{d}"))
        sites = reflected(reflected(sites, "diff", "x", 1, "row"), "diff", "y", 1, "col")
        sites = sites.withColumns({"left": shifted("diff", "x", -1), "right": shifted("diff", "x", 1)})
        corners = {f"{side}_{to}": shifted(side, "y", by) for side in ("left", "right") for to, by in (("up", -1), ("down", 1))}
        sites = sites.withColumns(corners)
        opposite = {"left_up": "right_down", "right_up": "left_down", "left_down": "right_up", "right_down": "left_up"}
        alone = [F.col(c) for c in ("left_up", "right_up", "left_down", "right_down")]
        diagonal = sum((F.coalesce(F.col(c), F.col(o), *alone, F.col("diff")) for c, o in list(opposite.items())[1:]), F.coalesce("left_up", "right_down", *alone, "diff")) / 4
        row, col = (F.col("row_m") + F.col("row_p")) / 2, (F.col("col_m") + F.col("col_p")) / 2
        sites = sites.withColumns({"beside": row, "below": col, "diagonal": diagonal})
        for c, wanted in (("r", "R"), ("b", "B")):
            here = F.col(f"g_{d}")
            near = F.when(site == "G", F.when(F.col("beside_site") == wanted, F.col("beside")).otherwise(F.col("below"))).otherwise(F.col("diagonal"))
            sites = sites.withColumn(f"{c}_{d}", F.when(site == wanted, F.col("value")).otherwise(here + near))
        sites = sites.drop("diff", "row_p", "row_m", "col_p", "col_m", "left", "right", *corners, "beside", "below", "diagonal")
    return sites


# The linear RGB to XYZ metric by which directions are compared, and Lab's threshold and slope there.
METRIC = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.119192, 0.9503041))
METRIC_WHITE = (0.95047, 1.0, 1.08883)
THRESHOLD, SLOPE = 0.008856452, 7.787037


def homogeneity_votes(sites: DataFrame, places: int | None = None) -> DataFrame:
    """Sites with vote_h, vote_v: how many of the four neighbours (the site itself beyond the image) differ in lightness and chroma by no more than the
    tolerance: the smaller of the row's largest difference in the h image and the column's in the v image. Lab is rounded to ``places`` if given."""
    near = lambda v: v if places is None else F.round(v, places)
    f = lambda t: F.when(t > THRESHOLD, F.cbrt(t)).otherwise(SLOPE * t + 16.0 / 116.0)
    sides = [("x", -1), ("x", 1), ("y", -1), ("y", 1)]
    for d in DIRECTIONS:
        xyz = {f"_{i}": f(sum((METRIC[i][j] * F.col(f"{c}_{d}") for j, c in ((1, "g"), (2, "b"))), METRIC[i][0] * F.col(f"r_{d}")) / METRIC_WHITE[i]) for i in range(3)}
        sites = sites.withColumns(xyz)
        sites = sites.withColumns({"_l": near(116 * F.col("_1") - 16), "_a": near(500 * (F.col("_0") - F.col("_1"))), "_b": near(200 * (F.col("_1") - F.col("_2")))})
        sites = sites.withColumns({f"{c}{k}": F.coalesce(shifted(c, axis, by), F.col(c)) for c in ("_l", "_a", "_b") for k, (axis, by) in enumerate(sides)})
        light = {f"dl{k}_{d}": F.abs(F.col("_l") - F.col(f"_l{k}")) for k in range(4)}
        square = lambda c, k: (F.col(c) - F.col(f"{c}{k}")) * (F.col(c) - F.col(f"{c}{k}"))
        sites = sites.withColumns(light | {f"dc{k}_{d}": square("_a", k) + square("_b", k) for k in range(4)})
        sites = sites.drop(*xyz, "_l", "_a", "_b", *(f"{c}{k}" for c in ("_l", "_a", "_b") for k in range(4)))
    for kind in ("dl", "dc"):
        row, col = F.greatest(f"{kind}0_h", f"{kind}1_h"), F.greatest(f"{kind}2_v", f"{kind}3_v")
        sites = sites.withColumn(f"{kind}_most", F.least(row, col))
    votes = {}
    for d in DIRECTIONS:
        alike = [((F.col(f"dl{k}_{d}") <= F.col("dl_most")) & (F.col(f"dc{k}_{d}") <= F.col("dc_most"))).cast("int") for k in range(4)]
        votes[f"vote_{d}"] = alike[0] + alike[1] + alike[2] + alike[3]
    return sites.withColumns(votes).drop("dl_most", "dc_most", *(f"{kind}{k}_{d}" for kind in ("dl", "dc") for k in range(4) for d in DIRECTIONS))


def demosaicked(mosaic: DataFrame, pattern: str = "RGGB", tile: int = TILE, places: int | None = None) -> DataFrame:
    """One row per site of ``mosaic`` (frame, y, x, value; whole images of three rows and columns or more): frame, y, x, both directions' colours,
    votes and their sums over three rows and columns (score_h, score_v), and r, g, b of the direction with more votes, or of both in the mean."""
    sites = with_halo(mosaic.select("frame", "y", "x", "value"), RADIUS, tile)
    sites = directional_greens(sites, pattern)
    sites = sites.withColumn("beside_site", F.coalesce(shifted("site", "x", 1), shifted("site", "x", -1)))
    sites = homogeneity_votes(directional_colours(sites), places)
    sites = sites.withColumns({f"score_{d}": around(f"vote_{d}", "x") for d in DIRECTIONS})
    sites = sites.withColumns({f"score_{d}": around(f"score_{d}", "y") for d in DIRECTIONS})
    h, v = F.col("score_h"), F.col("score_v")
    best = {c: F.when(h > v, F.col(f"{c}_h")).when(h < v, F.col(f"{c}_v")).otherwise((F.col(f"{c}_h") + F.col(f"{c}_v")) * 0.5) for c in "rgb"}
    colours = [f"{c}_{d}" for d in DIRECTIONS for c in "rgb"]
    return sites.withColumns(best).filter("home").select("frame", "y", "x", *colours, "vote_h", "vote_v", "score_h", "score_v", *"rgb")
