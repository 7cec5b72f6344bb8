"""Pieces of the SQL that DuckDB checks the queries with: common table expressions and colour formulas as text."""

from __future__ import annotations

import math
import re

from ..functions.colour import D65_XYZ, RGB_TO_XYZ
from ..sources.chart import FROM, NEUTRAL, SKIN, XYY, computed


def reference_values() -> str:
    rows = ", ".join(
        "({}, '{}', {}, {}, {})".format(
            p["patch_idx"], p["patch"], str(p["patch_idx"] in NEUTRAL).lower(), str(p["patch_idx"] in SKIN).lower(), ", ".join(f"CAST({float(v)!r} AS DOUBLE)" for v in (*p["rgb"], *p["lab"]))
        )
        for p in computed(FROM)
    )
    return f"ref(patch_idx, patch, is_neutral, is_skin, t_r, t_g, t_b, t_l, t_a, t_bb) AS (VALUES {rows})"


def xyy_values() -> str:
    rows = ", ".join(f"('{r}', {i}, CAST({v[0]!r} AS DOUBLE), CAST({v[1]!r} AS DOUBLE), CAST({v[2]!r} AS DOUBLE))" for r, vs in XYY.items() for i, v in enumerate(vs))
    return f"xyy(revision, patch_idx, x, y, big_y) AS (VALUES {rows})"


PX = """px AS (
  SELECT f AS frame, p AS patch_idx,
    e*(0.90e0*t_r + 0.06e0*t_g + 0.02e0*t_b) + k*(l_discount - 0.05e0)*t_g AS r,
    e*(0.04e0*t_r + 0.95e0*t_g + 0.03e0*t_b) + k*(l_tax - 0.04e0)*t_g AS g,
    e*(0.01e0*t_r + 0.07e0*t_g + 0.88e0*t_b) + k*(l_quantity - 25.5e0)/500e0*t_b AS b,
    CASE WHEN f = 9 AND l_quantity >= 50 THEN 1 ELSE 0 END AS clip
  FROM (SELECT l_suppkey % 10 AS f, l_partkey % 24 AS p, 0.60e0 + 0.03e0*(l_suppkey % 10) AS e,
          CASE WHEN l_suppkey % 10 IN (7, 8) THEN 3.0e0 ELSE 0.04e0 END AS k, l_discount, l_tax, l_quantity FROM lineitem) l
  JOIN ref ON ref.patch_idx = l.p)"""

SAMPLES = """samples AS (
  SELECT frame, patch_idx, avg(r) AS mean_r, avg(g) AS mean_g, avg(b) AS mean_b,
    var_pop(r) AS var_r, var_pop(g) AS var_g, var_pop(b) AS var_b, bit_or(clip) AS clip, count(*) AS n
  FROM px GROUP BY 1, 2)"""


def lum(p: str) -> str:
    return f"(0.2126e0*{p}_r + 0.7152e0*{p}_g + 0.0722e0*{p}_b)"


def fit_ctes(keys: str = "frame", joined: str = "SELECT s.*, ref.* EXCLUDE (patch_idx) FROM samples s JOIN ref USING (patch_idx)") -> str:
    """joined, exposure, channels, sums and stages, grouped by ``keys``."""
    using = f"USING ({keys})"
    n = {c: f"mean_{c}/nullif(exposure*c_{c}, 0)" for c in "rgb"}
    a = ", ".join(f"sum(n_{x}*n_{y}) AS a{i}{j}" for i, x in enumerate("rgb") for j, y in enumerate("rgb") if j >= i)
    b = ", ".join(f"sum(n_{x}*t_{y}) AS b{i}{j}" for i, x in enumerate("rgb") for j, y in enumerate("rgb"))
    at = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    inverse = inverse_sql(at)
    m = ", ".join(" + ".join(f"i{i}{k}*b{k}{j}" for k in range(3)) + f" AS m{i}{j}" for i in range(3) for j in range(3))
    return f"""joined AS ({joined}),
exposures AS (SELECT {keys}, median({lum('mean')}/greatest({lum('t')}, 1e-12)) AS exposure FROM joined WHERE is_neutral GROUP BY ALL),
channels AS (SELECT {keys}, any_value(exposure) AS exposure, {', '.join(f"median(mean_{c}/greatest(exposure*{lum('t')}, 1e-12)) AS c_{c}" for c in 'rgb')}
  FROM joined JOIN exposures {using} WHERE is_neutral GROUP BY {keys}),
normalised AS (SELECT {keys}, exposure, c_r, c_g, c_b, t_r, t_g, t_b, {', '.join(f'{x} AS n_{c}' for c, x in n.items())} FROM joined JOIN channels {using}),
sums AS (SELECT {keys}, any_value(exposure) AS exposure, any_value(c_r) AS c_r, any_value(c_g) AS c_g, any_value(c_b) AS c_b, {a}, {b} FROM normalised GROUP BY {keys}),
solved AS (SELECT *, {inverse} FROM sums),
stages AS (SELECT {keys}, exposure, c_r, c_g, c_b, {m} FROM solved)"""


def inverse_sql(at, prefix: str = "i") -> str:
    def minor(i, j):
        (p, q), (r, s) = [[at(x, k) for k in range(3) if k != j] for x in range(3) if x != i]
        return f"({p}*{s} - {q}*{r})"

    det = f"nullif({at(0, 0)}*{minor(0, 0)} - {at(0, 1)}*{minor(0, 1)} + {at(0, 2)}*{minor(0, 2)}, 0)"
    return ", ".join(f"{'-' if (i + j) % 2 else ''}{minor(j, i)}/{det} AS {prefix}{i}{j}" for i in range(3) for j in range(3))


CORRECTED = ", ".join(
    " + ".join(f"mean_{x}/nullif(exposure*c_{x}, 0)*m{i}{j}" for i, x in enumerate("rgb")) + f" AS out_{y}" for j, y in enumerate("rgb")
)


def xyz_of(p: str) -> list[str]:
    return ["(" + " + ".join(f"({RGB_TO_XYZ[i][j]!r})*{p}_{c}" for j, c in enumerate("rgb")) + ")" for i in range(3)]


def lab_of(xyz: list[str]) -> list[str]:
    d = 6 / 29
    f = [f"(CASE WHEN {v}/{w!r} > {d**3!r} THEN cbrt({v}/{w!r}) ELSE {v}/{w!r}/{3 * d**2!r} + {4 / 29!r} END)" for v, w in zip(xyz, D65_XYZ, strict=True)]
    return [f"(116*{f[1]} - 16)", f"(500*({f[0]} - {f[1]}))", f"(200*({f[1]} - {f[2]}))"]


def delta_e_ctes(source: str, a: tuple[str, str, str], b: tuple[str, str, str], out: str = "scored") -> str:
    """CTEs from ``source`` to ``out``, which adds delta_e between two Lab triples."""
    (l1, a1, b1), (l2, a2, b2) = a, b
    k = 25.0**7
    hue = lambda x, y: f"(degrees(atan2({y}, {x})) + CASE WHEN atan2({y}, {x}) < 0 THEN 360 ELSE 0 END)"
    return f"""e1 AS (SELECT *, (sqrt({a1}*{a1} + {b1}*{b1}) + sqrt({a2}*{a2} + {b2}*{b2}))/2 AS cm FROM {source}),
e2 AS (SELECT *, 1 + 0.5*(1 - sqrt(pow(cm, 7)/(pow(cm, 7) + {k!r}))) AS gg FROM e1),
e3 AS (SELECT *, sqrt(gg*{a1}*gg*{a1} + {b1}*{b1}) AS c1, sqrt(gg*{a2}*gg*{a2} + {b2}*{b2}) AS c2, {hue(f'gg*{a1}', b1)} AS h1, {hue(f'gg*{a2}', b2)} AS h2 FROM e2),
e4 AS (SELECT *, c1*c2 = 0 AS grey, (c1 + c2)/2 AS mc, pow(({l1} + {l2})/2 - 50, 2) AS ml FROM e3),
e5 AS (SELECT *, CASE WHEN grey THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN grey THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2)/2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360)/2 ELSE (h1 + h2 - 360)/2 END AS hm FROM e4),
e6 AS (SELECT *, 1 - 0.17*cos(radians(hm - 30)) + 0.24*cos(radians(2*hm)) + 0.32*cos(radians(3*hm + 6)) - 0.20*cos(radians(4*hm - 63)) AS ht,
  -2*sqrt(pow(mc, 7)/(pow(mc, 7) + {k!r}))*sin({math.radians(60)!r}*exp(-pow((hm - 275)/25, 2))) AS rt FROM e5),
e7 AS (SELECT *, ({l2} - {l1})/(1 + 0.015*ml/sqrt(20 + ml)) AS ex, (c2 - c1)/(1 + 0.045*mc) AS ey, 2*sqrt(c1*c2)*sin(radians(dh)/2)/(1 + 0.015*mc*ht) AS ez FROM e6),
{out} AS (SELECT *, sqrt(greatest(ex*ex + ey*ey + ez*ez + rt*ey*ez, 0)) AS delta_e FROM e7)"""


def validation_ctes(samples: str = "SELECT * FROM samples", keys: str = "frame", stages: str = "stages") -> str:
    lab = lab_of([f"xyz_{c}" for c in "xyz"])
    xyz = ", ".join(f"{v} AS xyz_{c}" for v, c in zip(xyz_of("out"), "xyz", strict=True))
    return f"""v0 AS (SELECT s.*, ref.* EXCLUDE (patch_idx), st.* EXCLUDE ({keys}) FROM ({samples}) s JOIN ref USING (patch_idx) JOIN {stages} st USING ({keys})),
v1 AS (SELECT *, {CORRECTED} FROM v0),
v2 AS (SELECT *, {xyz} FROM v1),
v3 AS (SELECT *, {lab[0]} AS lab_l, {lab[1]} AS lab_a, {lab[2]} AS lab_b FROM v2),
{delta_e_ctes('v3', ('lab_l', 'lab_a', 'lab_b'), ('t_l', 't_a', 't_bb'))}"""


def with_(*ctes: str) -> str:
    text = "WITH " + ",\n".join(ctes) + "\n"
    # each once, else formulas that use earlier columns several times grow with every step
    return re.sub(r" AS \((\s*)SELECT", r" AS MATERIALIZED (\1SELECT", text)
