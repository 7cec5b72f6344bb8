"""Colour mathematics as column expressions. A colour is a tuple of three DOUBLE columns; nothing here is a UDF."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]
Matrix = list[list[float]]

# Reference whites (XYZ, Y = 1), the 4-digit XYZ to linear sRGB matrix, Bradford D50 to D65, luminance weights.
D50_XYZ = (0.9642956764295677, 1.0, 0.8251046025104602)
D65_XYZ = (0.9504559270516716, 1.0, 1.0890577507598784)
XYZ_TO_RGB: Matrix = [[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.2040, 1.0570]]
BRADFORD_D50_TO_D65: Matrix = [
    [0.9554734215, -0.0230984549, 0.0632592432],
    [-0.0283697093, 1.0099953981, 0.0210414412],
    [0.0123140149, -0.0205076493, 1.3303659262],
]
LUMINANCE = (0.2126, 0.7152, 0.0722)


def inverted(m: Matrix) -> Matrix:
    """A constant 3x3 inverse, folded once on the driver."""
    import numpy as np

    return np.linalg.inv(np.array(m)).tolist()


RGB_TO_XYZ = inverted(XYZ_TO_RGB)
BRADFORD_D65_TO_D50 = inverted(BRADFORD_D50_TO_D65)


def col3(*names: str) -> Triple:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def column_product(m, v: Triple) -> Triple:
    """m times a column vector; entries may be numbers or columns."""
    return tuple(m[i][0] * v[0] + m[i][1] * v[1] + m[i][2] * v[2] for i in range(3))  # type: ignore[return-value]


def row_product(v: Triple, m) -> Triple:
    """A row vector times m; entries may be numbers or columns."""
    return tuple(v[0] * m[0][j] + v[1] * m[1][j] + v[2] * m[2][j] for j in range(3))  # type: ignore[return-value]


def column_inverse(m) -> list[list[Column]]:
    """The inverse of a 3x3 of columns by cofactors; null where the determinant is zero."""

    def minor(i, j):
        (a, b), (c, d) = [[m[r][k] for k in range(3) if k != j] for r in range(3) if r != i]
        return a * d - b * c

    det = m[0][0] * minor(0, 0) - m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    det = F.nullif(det, F.lit(0.0))
    return [[(-1) ** (i + j) * minor(j, i) / det for j in range(3)] for i in range(3)]


def infinity_norm(m) -> Column:
    return F.greatest(*(F.abs(r[0]) + F.abs(r[1]) + F.abs(r[2]) for r in m))


def luminance(v: Triple) -> Column:
    return LUMINANCE[0] * v[0] + LUMINANCE[1] * v[1] + LUMINANCE[2] * v[2]


def chroma_proxy(v: Triple) -> Column:
    return (F.greatest(*v) - F.least(*v)) / F.greatest((v[0] + v[1] + v[2]) / 3, F.lit(1e-6))


def xyy_to_xyz(v: Triple) -> Triple:
    x, y, big_y = v
    return x * big_y / F.nullif(y, F.lit(0.0)), big_y, (1 - x - y) * big_y / F.nullif(y, F.lit(0.0))


def xyz_d50_to_d65(v: Triple) -> Triple:
    return column_product(BRADFORD_D50_TO_D65, v)


def xyz_to_linear_srgb(v: Triple) -> Triple:
    return column_product(XYZ_TO_RGB, v)


def linear_srgb_to_xyz(v: Triple) -> Triple:
    return column_product(RGB_TO_XYZ, v)


def _lab_f(t: Column) -> Column:
    delta = 6 / 29
    return F.when(t > delta**3, F.cbrt(t)).otherwise(t / (3 * delta**2) + 4 / 29)


def _lab_f_inverse(f: Column) -> Column:
    delta = 6 / 29
    return F.when(f > delta, f * f * f).otherwise(3 * delta**2 * (f - 4 / 29))


def xyz_d65_to_lab(v: Triple) -> Triple:
    """CIE Lab under D65; exact zeros give zeros."""
    fx, fy, fz = (_lab_f(c / w) for c, w in zip(v, D65_XYZ, strict=True))
    zero = (v[0] == 0) & (v[1] == 0) & (v[2] == 0)
    out = 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)
    return tuple(F.when(zero, 0.0).otherwise(c) for c in out)  # type: ignore[return-value]


def lab_to_xyz_d65(v: Triple) -> Triple:
    fy = (v[0] + 16) / 116
    parts = fy + v[1] / 500, fy, fy - v[2] / 200
    return tuple(w * _lab_f_inverse(f) for w, f in zip(D65_XYZ, parts, strict=True))  # type: ignore[return-value]


def srgb_encode(v: Column) -> Column:
    """The sRGB curve, without a clamp."""
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def srgb_decode(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow(F.greatest((v + 0.055) / 1.055, F.lit(0.0)), F.lit(2.4)))


def clamp01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def near(v: Column, places: int | None) -> Column:
    """``v`` to so many decimal places, halves up, in doubles alone; as it is for None."""
    return v if places is None else F.floor(v * 10.0**places + 0.5) / 10.0**places


def quantise_u16(v: Column) -> Column:
    """Halves up, clamped to the code range; not a number is 0."""
    return F.least(F.greatest(F.floor(v * 65535.0 + 0.5), F.lit(0)), F.lit(65535)).cast("int")


def clipped_channels(mask: Column) -> Column:
    """Names of a clip mask's channels joined by bars, or its unknown bits."""
    known = F.concat_ws("|", *(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in ((1, "R"), (2, "G"), (4, "B"))))
    return F.when(mask.bitwiseAND(7) == 0, F.format_string("unknown bits 0x%02x", mask)).otherwise(known)


def with_delta_e(df: DataFrame, a: tuple[str, str, str], b: tuple[str, str, str], out: str) -> DataFrame:
    """``df`` with the CIEDE2000 difference of two Lab triples; staged, so that no expression is repeated."""
    c, p7 = F.col, lambda x: F.pow(x, F.lit(7.0))
    hue = lambda x, y: (F.degrees(F.atan2(y, x)) + F.when(F.degrees(F.atan2(y, x)) < 0, 360.0).otherwise(0.0))
    length = lambda x, y: F.sqrt(x * x + y * y)
    l1, a1, b1 = (c(n) for n in a)
    l2, a2, b2 = (c(n) for n in b)
    stages = [
        {"_m": (length(a1, b1) + length(a2, b2)) / 2},
        {"_g": 1 + 0.5 * (1 - F.sqrt(p7(c("_m")) / (p7(c("_m")) + 25.0**7)))},
        {"_p": c("_g") * a1, "_q": c("_g") * a2},
        {"_c1": length(c("_p"), b1), "_c2": length(c("_q"), b2), "_h1": hue(c("_p"), b1), "_h2": hue(c("_q"), b2)},
        {"_grey": c("_c1") * c("_c2") == 0, "_dh": c("_h2") - c("_h1"), "_sh": c("_h1") + c("_h2")},
        {
            "_turn": F.when(c("_grey"), 0.0).when(F.abs("_dh") <= 180, c("_dh")).when(c("_dh") > 0, c("_dh") - 360).otherwise(c("_dh") + 360),
            "_hue": F.when(c("_grey"), c("_sh"))
            .when(F.abs("_dh") <= 180, c("_sh") / 2)
            .when(c("_sh") < 360, (c("_sh") + 360) / 2)
            .otherwise((c("_sh") - 360) / 2),
            "_ml": F.pow((l1 + l2) / 2 - 50, F.lit(2.0)),
            "_mc": (c("_c1") + c("_c2")) / 2,
        },
        {
            "_t": 1
            - 0.17 * F.cos(F.radians(c("_hue") - 30))
            + 0.24 * F.cos(F.radians(2 * c("_hue")))
            + 0.32 * F.cos(F.radians(3 * c("_hue") + 6))
            - 0.20 * F.cos(F.radians(4 * c("_hue") - 63)),
            "_rt": -2 * F.sqrt(p7(c("_mc")) / (p7(c("_mc")) + 25.0**7)) * F.sin(math.radians(60) * F.exp(-F.pow((c("_hue") - 275) / 25, F.lit(2.0)))),
        },
        {
            "_x": (l2 - l1) / (1 + 0.015 * c("_ml") / F.sqrt(20 + c("_ml"))),
            "_y": (c("_c2") - c("_c1")) / (1 + 0.045 * c("_mc")),
            "_z": 2 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians("_turn") / 2) / (1 + 0.015 * c("_mc") * c("_t")),
        },
        {out: F.sqrt(F.greatest(c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z") + c("_rt") * c("_y") * c("_z"), F.lit(0.0)))},
    ]
    made = [n for s in stages for n in s if n != out]
    for s in stages:
        df = df.withColumns(s)
    return df.drop(*made)
