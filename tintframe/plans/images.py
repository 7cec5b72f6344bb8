"""Queries over images as relations of sites and pixels: directional interpolation, homogeneity votes, bright patches and their lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blobs as B
from ..operators import stencil
from ..sources import adapters
from . import sql as S
from .calibration import rounded

QUERIES: dict = {}
SQL: dict = {}


def query(text: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return put


#: A tile smaller than the test images, so that halos are exchanged; and the places Lab is rounded to, as engines differ in the last bits.
TILE, PLACES = 16, 6

BAYER = """hit AS (SELECT l_orderkey // 512 AS frame, l_orderkey % 24 AS y, (l_partkey + 5*l_linenumber) % 24 AS x, max(CAST(l_quantity*300 AS INT)) AS raw FROM lineitem GROUP BY ALL),
site AS (SELECT f.frame, a.y, b.x, coalesce(raw, 1000 + (f.frame*7919 + a.y*131 + b.x*37 + a.y*b.x*11) % 9973)/16383e0 AS v,
  CASE WHEN a.y % 2 = 0 AND b.x % 2 = 0 THEN 'R' WHEN a.y % 2 = 1 AND b.x % 2 = 1 THEN 'B' ELSE 'G' END AS site
  FROM (SELECT DISTINCT frame FROM hit) f, (SELECT range AS y FROM range(24)) a, (SELECT range AS x FROM range(24)) b LEFT JOIN hit h ON h.frame = f.frame AND h.y = a.y AND h.x = b.x)"""
_AT = {"e1": (1, 0), "w1": (-1, 0), "s1": (0, 1), "n1": (0, -1), "e2": (2, 0), "w2": (-2, 0), "s2": (0, 2), "n2": (0, -2), "nw": (-1, -1), "ne": (1, -1), "sw": (-1, 1), "se": (1, 1)}


def _joined(table: str, *names: str) -> str:
    return f"FROM {table} c " + " ".join(f"LEFT JOIN {table} {n} ON {n}.frame = c.frame AND {n}.x = c.x + {_AT[n][0]} AND {n}.y = c.y + {_AT[n][1]}" for n in names)


def _green(p: str, m: str) -> str:
    pair = lambda k: (f"coalesce({p}{k}.v, {m}{k}.v, c.v)", f"coalesce({m}{k}.v, {p}{k}.v, c.v)")
    (a, b), (d, e) = pair(1), pair(2)
    return f"CASE WHEN c.site = 'G' THEN c.v ELSE ({a} + {b})*0.5e0 + (2*c.v - {d} - {e})*0.25e0 END"


GREEN = f"green AS (SELECT c.*, {_green('e', 'w')} AS g_h, {_green('s', 'n')} AS g_v {_joined('site', 'e1', 'w1', 's1', 'n1', 'e2', 'w2', 's2', 'n2')})"


def _colour(d: str, wanted: str) -> str:
    v = lambda n: f"({n}.v - {n}.g_{d})"
    mean = lambda a, b: f"(coalesce({v(a)}, {v(b)}) + coalesce({v(b)}, {v(a)}))/2"
    alone = f"{v('nw')}, {v('ne')}, {v('sw')}, {v('se')}"
    corner = lambda a, b: f"coalesce({v(a)}, {v(b)}, {alone})"
    diagonal = f"({corner('nw', 'se')} + {corner('sw', 'ne')} + {corner('ne', 'sw')} + {corner('se', 'nw')})/4"
    return (
        f"CASE WHEN c.site = '{wanted}' THEN c.v WHEN c.site = 'G' AND coalesce(e1.site, w1.site) = '{wanted}' THEN c.g_{d} + {mean('e1', 'w1')} "
        f"WHEN c.site = 'G' THEN c.g_{d} + {mean('s1', 'n1')} ELSE c.g_{d} + {diagonal} END AS {wanted.lower()}_{d}"
    )


COLOUR = f"colour AS (SELECT c.frame, c.y, c.x, c.g_h, c.g_v, {', '.join(_colour(d, w) for d in 'hv' for w in 'RB')} {_joined('green', 'e1', 'w1', 's1', 'n1', 'nw', 'ne', 'sw', 'se')})"
_NAMES = [f"{c}_{d}" for d in "hv" for c in "rgb"]


@query(S.with_(BAYER, GREEN, COLOUR) + "SELECT CAST(frame AS INT) AS frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, " + ", ".join(f"round({n}, 6) + 0e0 AS {n}" for n in _NAMES) + " FROM colour")
def j10_neighbour_interpolation(spark, sf_dir):
    """Both directions' colours of every site of the mosaics, with reflection at the borders."""
    sites = stencil.with_halo(adapters.bayer(spark, sf_dir), 3, TILE)
    sites = stencil.directional_greens(sites).withColumn("beside_site", F.coalesce(stencil.shifted("site", "x", 1), stencil.shifted("site", "x", -1)))
    return rounded(stencil.directional_colours(sites).filter("home").select("frame", "y", "x", *_NAMES))


def _lab(d: str) -> str:
    f = [
        f"(CASE WHEN {t} > {stencil.THRESHOLD!r} THEN cbrt({t}) ELSE {stencil.SLOPE!r}*{t} + 16/116e0 END)"
        for t in ("(" + " + ".join(f"{stencil.METRIC[i][j]!r}e0*{c}_{d}" for j, c in enumerate("rgb")) + f")/{stencil.METRIC_WHITE[i]!r}e0" for i in range(3))
    ]
    return f"round(116*{f[1]} - 16, 6) AS ll_{d}, round(500*({f[0]} - {f[1]}), 6) AS la_{d}, round(200*({f[1]} - {f[2]}), 6) AS lb_{d}"


def _differences() -> str:
    out = []
    for d in "hv":
        for k, n in enumerate(("w1", "e1", "n1", "s1")):
            v = lambda c: f"(c.l{c}_{d} - coalesce({n}.l{c}_{d}, c.l{c}_{d}))"  # noqa: B023, E731
            out += [f"abs({v('l')}) AS dl{k}_{d}", f"{v('a')}*{v('a')} + {v('b')}*{v('b')} AS dc{k}_{d}"]
    return ", ".join(out)


_VOTE = lambda d: " + ".join(f"CAST(dl{k}_{d} <= ml AND dc{k}_{d} <= mc AS INT)" for k in range(4))
_LIMIT = lambda k: f"least(greatest({k}0_h, {k}1_h), greatest({k}2_v, {k}3_v))"
VOTES = (
    f"lab AS (SELECT *, {_lab('h')}, {_lab('v')} FROM colour)",
    f"apart AS (SELECT c.frame, c.y, c.x, {', '.join('c.' + n for n in _NAMES)}, {_differences()} {_joined('lab', 'w1', 'e1', 'n1', 's1')})",
    f"limits AS (SELECT *, {_LIMIT('dl')} AS ml, {_LIMIT('dc')} AS mc FROM apart)",
    f"votes AS (SELECT frame, y, x, {', '.join(_NAMES)}, {_VOTE('h')} AS vote_h, {_VOTE('v')} AS vote_v FROM limits)",
    "scores AS (SELECT c.frame, c.y, c.x, sum(n.vote_h) AS score_h, sum(n.vote_v) AS score_v FROM votes c JOIN votes n ON n.frame = c.frame AND n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 GROUP BY ALL)",
)
_BEST = ", ".join(f"round(CASE WHEN score_h > score_v THEN {c}_h WHEN score_h < score_v THEN {c}_v ELSE ({c}_h + {c}_v)*0.5e0 END, 6) + 0e0 AS {c}" for c in "rgb")


@query(S.with_(BAYER, GREEN, COLOUR, *VOTES) + f"""SELECT CAST(frame AS INT) AS frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(vote_h AS INT) AS vote_h, CAST(vote_v AS INT) AS vote_v,
  CAST(score_h AS BIGINT) AS score_h, CAST(score_v AS BIGINT) AS score_v, {_BEST} FROM votes JOIN scores USING (frame, y, x)""")
def a15_homogeneity_votes(spark, sf_dir):
    """Votes of both directions over the mosaics, their sums over three rows and columns, and the colours they choose."""
    out = stencil.demosaicked(adapters.bayer(spark, sf_dir), tile=TILE, places=PLACES)
    return rounded(out.select("frame", "y", "x", "vote_h", "vote_v", "score_h", "score_v", *"rgb"))


_W, _H = adapters.SCENE
SCENES = f"""scene AS (SELECT frame, y, x, CASE WHEN frame % 4 = 3 AND (x*7 + y*13 + frame) % 97 = 0 THEN 0.5e0 ELSE coalesce((0.2126e0*t_r + 0.7152e0*t_g + 0.0722e0*t_b)*gain, 0.02e0) END AS light
  FROM (SELECT s_suppkey AS frame, y, x, CASE WHEN s_suppkey % 9 = 4 THEN 0.04e0 ELSE 0.6e0 + (s_suppkey % 7)*0.1e0 END AS gain, x - 4 - s_suppkey % 3 AS u, y - 5 - s_suppkey % 4 AS v
    FROM supplier, (SELECT range AS y FROM range({_H})) a, (SELECT range AS x FROM range({_W})) b) p
  LEFT JOIN ref ON u BETWEEN 0 AND 53 AND v BETWEEN 0 AND 35 AND u % 9 < 7 AND v % 9 < 7 AND patch_idx = v // 9*6 + u // 9 AND NOT (frame % 6 = 1 AND patch_idx = frame % 24))"""
_LEVELS = ", ".join(map(repr, B.LEVELS))
BLOBS = (
    S.reference_values(),
    SCENES,
    f"lit AS (SELECT frame, level, y, x FROM scene, (SELECT unnest([{_LEVELS}]::DOUBLE[]) AS level) t WHERE light > level)",
    "runs AS (SELECT frame, level, y, min(x) AS x0, max(x) AS x1, row_number() OVER (ORDER BY frame, level, y, min(x)) AS id FROM (SELECT *, x - row_number() OVER (PARTITION BY frame, level, y ORDER BY x) AS k FROM lit) GROUP BY frame, level, y, k)",
    "edges AS (SELECT a.id AS u, b.id AS v FROM runs a JOIN runs b ON a.frame = b.frame AND a.level = b.level AND a.y + 1 = b.y AND a.x0 <= b.x1 AND b.x0 <= a.x1)",
    "either AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges)",
    "reach AS (SELECT id, id AS least FROM runs UNION SELECT v, least FROM reach JOIN either ON u = reach.id WHERE least < v)",
    "parts AS (SELECT id, min(least) AS part FROM reach GROUP BY id)",
    "boxes AS (SELECT r.frame, r.level, part, min(x0) AS x0, max(x1) AS x1, min(r.y) AS y0, max(r.y) AS y1, sum(x1 - x0 + 1) AS area FROM runs r JOIN parts USING (id) GROUP BY ALL)",
    f"""fair AS (SELECT *, x1 - x0 + 1 AS w, y1 - y0 + 1 AS h FROM boxes WHERE x0 > 0 AND y0 > 0 AND x1 + 1 < {_W} AND y1 + 1 < {_H} AND least(x1 - x0, y1 - y0) + 1 >= 5
  AND greatest(x1 - x0, y1 - y0) + 1 <= 0.2*{max(_W, _H)} AND (x1 - x0 + 1)/(y1 - y0 + 1)::DOUBLE BETWEEN 0.6 AND 1.6 AND area >= 0.4*(x1 - x0 + 1)*(y1 - y0 + 1))""",
    """blobs AS (SELECT f.frame, f.level, part, r.y, r.x0, (f.x0 + f.x1 + 1)*0.5e0 AS cx, (y0 + y1 + 1)*0.5e0 AS cy, sqrt(area::DOUBLE) AS size FROM fair f JOIN runs r ON r.id = part
  WHERE (SELECT count(*) FROM fair o WHERE o.frame = f.frame AND o.level = f.level) <= 1500)""",
)


def _recursive(*ctes: str) -> str:
    return S.with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1).replace("reach AS MATERIALIZED (", "reach AS (").replace("near AS MATERIALIZED (", "near AS (")


def _blobs(spark, sf_dir):
    light = adapters.scenes(spark, sf_dir)
    sizes = adapters.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("frame")).distinct().withColumns({"width": F.lit(_W), "height": F.lit(_H)})
    return B.blobs(light, sizes)


@query(_recursive(*BLOBS) + "SELECT CAST(frame AS INT) AS frame, level, CAST(y AS INT) AS y, CAST(x0 AS INT) AS x, cx, cy, round(size, 6) AS size FROM blobs")
def d02_blobs(spark, sf_dir):
    """Bright squares of every scene at seven levels."""
    return rounded(_blobs(spark, sf_dir).select("frame", "level", "blob.y", F.col("blob.x0").alias("x"), "cx", "cy", "size"))


GROUPS = (
    *BLOBS,
    """pairs AS (SELECT a.part AS u, b.part AS v FROM blobs a JOIN blobs b ON a.frame = b.frame AND a.level = b.level AND a.part < b.part
  WHERE a.size/b.size BETWEEN 0.7 AND 1.43 AND sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 1.6*greatest(a.size, b.size))""",
    "both_ways AS (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs)",
    "near AS (SELECT part AS id, part AS least FROM blobs UNION SELECT v, least FROM near JOIN both_ways ON u = near.id WHERE least < v)",
    "grouped AS (SELECT b.*, g, count(*) OVER (PARTITION BY g) AS n FROM blobs b JOIN (SELECT id, min(least) AS g FROM near GROUP BY id) m ON m.id = b.part)",
    "members AS (SELECT frame, level, g, part, cx, cy, n FROM grouped WHERE n BETWEEN 14 AND 24)",
)


@query(_recursive(*GROUPS) + """SELECT CAST(m.frame AS INT) AS frame, m.level, CAST(any_value(r.y) AS INT) AS y, CAST(any_value(r.x0) AS INT) AS x, count(*) AS blobs, round(avg(m.cx), 6) AS mean_x, round(avg(m.cy), 6) AS mean_y
FROM members m JOIN runs r ON r.id = m.g GROUP BY m.frame, m.level, m.g""")
def j11_blob_groups(spark, sf_dir):
    """Groups of 14 to 24 bright squares of like size that touch."""
    found = B.groups(_blobs(spark, sf_dir)).groupBy("frame", "level", "group").agg(F.count("*").alias("blobs"), F.avg("cx").alias("mean_x"), F.avg("cy").alias("mean_y"))
    return rounded(found.select("frame", "level", "group.y", F.col("group.x0").alias("x"), "blobs", "mean_x", "mean_y"))


def _solved() -> list[str]:
    """Elimination without pivots, which a positive definite system needs not."""
    ctes, cols = [], [[f"e{i}{j}" for j in range(4)] + [f"f{i}", f"g{i}"] for i in range(4)]
    for c in range(4):
        source = "normal" if c == 0 else f"el{c - 1}"
        new = [f"{cols[i][j]} - {cols[i][c]}/{cols[c][c]}*{cols[c][j]} AS {cols[i][j]}" for i in range(4) if i != c for j in range(6)]
        ctes.append(f"el{c} AS (SELECT frame, level, g, pitch, coherence, {', '.join(cols[c])}, {', '.join(new)} FROM {source})")
    return ctes


_POINT = lambda s, u, v: f"({s}0/e00 + {s}1/e11*{u} + {s}2/e22*{v} + {s}3/e33*{u * v})"
_CORNERS = ", ".join(f"{_POINT(s, u, v)} AS {a}{i}" for i, (u, v) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for a, s in (("x", "f"), ("y", "g")))
_LEN = lambda i, j: f"sqrt(pow(x{i} - x{j}, 2) + pow(y{i} - y{j}, 2))"
_BASIS = {"b0": "1e0", "b1": "b1", "b2": "b2", "b3": "b1*b2"}
LATTICE = (
    *GROUPS,
    """nearest AS (SELECT a.frame, a.level, a.g, a.part, sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)) AS d, 4*atan2(b.cy - a.cy, b.cx - a.cx) AS turn FROM members a JOIN members b ON a.g = b.g AND a.part <> b.part
  QUALIFY row_number() OVER (PARTITION BY a.part ORDER BY sqrt(pow(b.cx - a.cx, 2) + pow(b.cy - a.cy, 2)), b.part) = 1)""",
    """axes AS (SELECT frame, level, g, sqrt(pow(sum(sin(turn)), 2) + pow(sum(cos(turn)), 2))/count(*) AS coherence, atan2(sum(sin(turn)), sum(cos(turn)))/4 AS theta, list_sort(list(d))[count(*) // 2 + 1] AS pitch
  FROM nearest GROUP BY ALL HAVING sqrt(pow(sum(sin(turn)), 2) + pow(sum(cos(turn)), 2))/count(*) >= 0.75)""",
    "turned AS (SELECT m.*, pitch, coherence, cx*cos(theta) + cy*sin(theta) AS p, cy*cos(theta) - cx*sin(theta) AS q FROM members m JOIN axes USING (frame, level, g))",
    """spans AS (SELECT *, max(p) OVER w - min(p) OVER w < max(q) OVER w - min(q) OVER w AS tall, min(p) OVER w AS p0, max(p) OVER w AS p1, min(q) OVER w AS q0 FROM turned WINDOW w AS (PARTITION BY g))""",
    "cells AS (SELECT *, round(CASE WHEN tall THEN q - q0 ELSE p - p0 END/pitch) AS col, round(CASE WHEN tall THEN p1 - p ELSE q - q0 END/pitch) AS line FROM spans)",
    "based AS (SELECT *, (col + 0.5e0)/6 AS b1, (line + 0.5e0)/4 AS b2 FROM cells)",
    f"""normal AS (SELECT frame, level, g, any_value(pitch) AS pitch, any_value(coherence) AS coherence, {', '.join(f"sum({_BASIS[f'b{i}']}*{_BASIS[f'b{j}']}) AS e{i}{j}" for i in range(4) for j in range(4))},
  {', '.join(f"sum({_BASIS[f'b{i}']}*{c}) AS {s}{i}" for i in range(4) for s, c in (("f", "cx"), ("g", "cy")))} FROM based GROUP BY frame, level, g
  HAVING min(col) >= 0 AND max(col) = 5 AND min(line) >= 0 AND max(line) = 3 AND count(DISTINCT line*6 + col) = count(*))""",
    *_solved(),
    f"corners AS (SELECT frame, level, g, pitch, coherence, {_CORNERS} FROM el3)",
    f"shapes AS (SELECT *, ({_LEN(0, 1)} + {_LEN(2, 3)})*0.5 AS width, ({_LEN(0, 3)} + {_LEN(1, 2)})*0.5 AS height FROM corners)",
)
_XY = [f"{a}{i}" for i in range(4) for a in "xy"]


@query(_recursive(*LATTICE) + f"SELECT CAST(frame AS INT) AS frame, level, round(pitch, 6) AS pitch, round(coherence, 6) AS coherence, {', '.join(f'round({c}, 5) + 0e0 AS {c}' for c in _XY)} FROM shapes WHERE width >= 48 AND width/height BETWEEN 1.15 AND 2.2")
def d04_lattice(spark, sf_dir):
    """Chart corners from the bilinear fit of each group that lies on a lattice of six by four."""
    found = B.lattices(B.groups(_blobs(spark, sf_dir)))
    return rounded(found.select("frame", "level", "pitch", "coherence", *(F.round(c, 5).alias(c) for c in _XY)))
