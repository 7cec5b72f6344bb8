"""Applying fitted stages to pixels: clip flags, clamping, encoding, quantisation, and wide-gamut output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import clamp01, col3, inverted, near, quantise_u16, srgb_encode

OUT = ("out_r", "out_g", "out_b")

# Chromaticities of the output spaces' primaries (all with a D65 white of x 0.3127, y 0.3290), the curve of Adobe RGB.
PRIMARIES = {
    "srgb": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)),
    "display-p3": ((0.68, 0.32), (0.265, 0.69), (0.15, 0.06)),
    "adobe-rgb": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)),
}
WHITE = (0.3127, 0.3290)
ADOBE_GAMMA = 2.19921875

# The spaces' names, default first, with how they are shown and what a colour configuration calls them.
SPACES = [("srgb", "sRGB", None), ("display-p3", "Display P3", "sRGB Encoded P3-D65"), ("adobe-rgb", "Adobe RGB (1998)", "Gamma 2.2 Encoded AdobeRGB")]


def output_spaces(spark) -> DataFrame:
    """space, place, label, config_name: the spaces that can be written, default first."""
    return spark.createDataFrame([(n, i, *rest) for i, (n, *rest) in enumerate(SPACES)], "space string, place int, label string, config_name string")


def resolved_spaces(requests: DataFrame, spaces: DataFrame) -> DataFrame:
    """``requests`` (space) with the named space's columns and error: names count exactly, and an unknown or absent one has no default."""
    unknown = F.concat(F.lit("unknown output space: "), F.coalesce("space", F.lit("")))
    return requests.join(F.broadcast(spaces), "space", "left").withColumn("error", F.when(F.col("place").isNull(), unknown))


def rgb_to_xyz_matrix(space: str) -> list[list[float]]:
    import numpy as np

    if space not in PRIMARIES:
        raise ValueError(f"unknown output space: {space}")
    p = np.array([[x / y, 1.0, (1 - x - y) / y] for x, y in PRIMARIES[space]]).T
    w = np.array([WHITE[0] / WHITE[1], 1.0, (1 - WHITE[0] - WHITE[1]) / WHITE[1]])
    return (p * np.linalg.solve(p, w)).tolist()


def from_rec709(space: str) -> list[list[float]]:
    """The column-vector matrix from linear sRGB to a space's linear light."""
    import numpy as np

    return (np.array(inverted(rgb_to_xyz_matrix(space))) @ np.array(rgb_to_xyz_matrix("srgb"))).tolist()


def clip_flags(df: DataFrame) -> DataFrame:
    """``df`` with flags: bits 0-2 for channels below 0, bits 3-5 for those above 1, before any clamp."""
    bits = [F.when(F.col(c) < 0, 1 << i).otherwise(0) + F.when(F.col(c) > 1, 1 << (i + 3)).otherwise(0) for i, c in enumerate(OUT)]
    return df.withColumn("flags", bits[0] + bits[1] + bits[2])


def encode_srgb(df: DataFrame, places: int | None = None) -> DataFrame:
    """``df`` with code_r, code_g, code_b: clamped, sRGB encoded, rounded to ``places`` if given, and quantised to 16 bits."""
    return df.withColumns({f"code_{c}": quantise_u16(near(srgb_encode(clamp01(F.col(o))), places)) for c, o in zip("rgb", OUT, strict=True)})


def to_8_bit(code: str):
    return F.expr(f"cast(({code} + 128) div 257 as int)")


def encode_space(df: DataFrame, space: str, places: int | None = None) -> DataFrame:
    """``df`` with lin_*, the unclamped linear light of ``space`` from float32 colours, and its encoded codes and ``fits``: whether
    rounding alone changes every channel. Encoded values are rounded to ``places`` first, if given."""
    m = from_rec709(space)
    v = tuple(c.cast("float").cast("double") for c in col3(*OUT))
    linear = {f"lin_{c}": m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i, c in enumerate("rgb")}
    curve = srgb_encode if space != "adobe-rgb" else lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / ADOBE_GAMMA))
    df = df.withColumns(linear).withColumns({f"enc_{c}": near(curve(F.col(f"lin_{c}")), places) for c in "rgb"})
    scaled = [F.col(f"enc_{c}") * 65535.0 for c in "rgb"]
    fits = (F.least(*scaled) >= -0.5) & (F.greatest(*scaled) <= 65535.5) & (F.least(*(F.col(f"lin_{c}") for c in "rgb")) > -1e-9)
    return df.withColumns({f"code_{c}": quantise_u16(F.col(f"enc_{c}")) for c in "rgb"}).withColumn("fits", fits)
