"""The 24-patch chart: names, roles and measured colours of two revisions, and what follows from them by computation."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.colour import BRADFORD_D50_TO_D65, D65_XYZ, XYZ_TO_RGB

COLUMNS, ROWS = 6, 4
BEFORE, FROM = "classic-before-november-2014", "classic-from-november-2014"
NEUTRAL = range(18, 24)
SKIN = (0, 1)

# Patch names in reading order, and their measured xyY (D50, CIE 1931 2 degree observer) by revision.
PATCHES = (
    "dark-skin light-skin blue-sky foliage blue-flower bluish-green "
    "orange purplish-blue moderate-red purple yellow-green orange-yellow "
    "blue green red yellow magenta cyan "
    "white neutral-8 neutral-6-5 neutral-5 neutral-3-5 black"
).split()
XYY = {
    BEFORE: [
        (0.4316271709, 0.3777244481, 0.1008020776),
        (0.4196806193, 0.3744153323, 0.3495164406),
        (0.2761320266, 0.3016604182, 0.1835760299),
        (0.3703685908, 0.4499643151, 0.1325097889),
        (0.2999251953, 0.2856180163, 0.2303852718),
        (0.2848421198, 0.3911818254, 0.4178003657),
        (0.5295363989, 0.4055290094, 0.3118203265),
        (0.2305721825, 0.2106916266, 0.1126303272),
        (0.5012100808, 0.327298373, 0.1937579445),
        (0.3319105129, 0.2482859655, 0.0636901565),
        (0.3983625827, 0.5008220007, 0.4445563913),
        (0.4956930822, 0.4427267258, 0.4357127129),
        (0.2018682806, 0.1692542836, 0.057520163),
        (0.325279842, 0.5032795409, 0.2318364776),
        (0.5686011164, 0.3302987345, 0.1256541551),
        (0.4696889999, 0.4733811208, 0.5980668385),
        (0.4159013458, 0.2688328208, 0.2008661574),
        (0.2131621087, 0.3023360642, 0.1930141639),
        (0.3469803856, 0.3608110319, 0.9131354169),
        (0.3440580668, 0.3584668455, 0.5893708333),
        (0.3432249749, 0.3581749022, 0.3632301854),
        (0.3446244972, 0.3579899468, 0.1915409112),
        (0.3401816321, 0.3548212147, 0.0883056217),
        (0.3406089158, 0.3537887144, 0.031053586),
    ],
    FROM: [
        (0.4374835978, 0.3785228425, 0.098324361),
        (0.4222494415, 0.3724936851, 0.336202304),
        (0.2761474404, 0.2983815721, 0.1785519348),
        (0.3733161282, 0.4511691357, 0.1346792679),
        (0.3028905214, 0.2862869093, 0.2287175998),
        (0.2864048282, 0.3897177845, 0.4143554688),
        (0.5281477218, 0.4053349677, 0.3126416159),
        (0.2323858498, 0.2112037155, 0.1091090233),
        (0.5044475471, 0.3270647451, 0.188999956),
        (0.3334711475, 0.2505523011, 0.0627666296),
        (0.3988934508, 0.5041491488, 0.4331759409),
        (0.4935760013, 0.444283202, 0.4293377578),
        (0.2052207685, 0.1686654757, 0.0559621406),
        (0.3230379646, 0.5104181833, 0.2233437582),
        (0.5628723227, 0.3355628074, 0.127800835),
        (0.4677593492, 0.4760244337, 0.5992976803),
        (0.4213108861, 0.2669246233, 0.1895114577),
        (0.2091287188, 0.3026580149, 0.180609913),
        (0.3489144945, 0.36421258, 0.8806903203),
        (0.3455838581, 0.3598806129, 0.5899709702),
        (0.3441498292, 0.3591850701, 0.3648652066),
        (0.3457692225, 0.3590938272, 0.1906228754),
        (0.3426484326, 0.3575835154, 0.0881723483),
        (0.3437674673, 0.3560576297, 0.0315131943),
    ],
}


@lru_cache(maxsize=2)
def computed(revision: str = FROM) -> list[dict]:
    """For each patch its XYZ under D50 and D65, linear sRGB and Lab, in double precision."""
    out = []
    for i, (x, y, big_y) in enumerate(XYY[revision]):
        d50 = np.array([x * big_y / y, big_y, (1 - x - y) * big_y / y])
        d65 = np.array(BRADFORD_D50_TO_D65) @ d50
        t = d65 / np.array(D65_XYZ)
        f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
        lab = np.array([116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])])
        rgb = np.array(XYZ_TO_RGB) @ d65
        out.append({"patch_idx": i, "patch": PATCHES[i], "xyy": (x, y, big_y), "d50": d50, "d65": d65, "rgb": rgb, "lab": lab})
    return out


def chart_reference(spark: SparkSession, revision: str = FROM) -> DataFrame:
    """patch_idx, patch, is_neutral, is_skin, target colour (t_r, t_g, t_b) and its Lab (t_l, t_a, t_bb): 24 rows, so always
    small enough to broadcast."""
    rows = [
        (p["patch_idx"], p["patch"], p["patch_idx"] in NEUTRAL, p["patch_idx"] in SKIN, *map(float, p["rgb"]), *map(float, p["lab"]))
        for p in computed(revision)
    ]
    schema = "patch_idx int, patch string, is_neutral boolean, is_skin boolean, t_r double, t_g double, t_b double, t_l double, t_a double, t_bb double"
    return spark.createDataFrame(rows, schema)


def chart_xyy(spark: SparkSession) -> DataFrame:
    """revision, patch_idx, patch and the measured x, y, big_y of both revisions."""
    rows = [(r, i, PATCHES[i], *map(float, v)) for r, vs in XYY.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "revision string, patch_idx int, patch string, x double, y double, big_y double")
