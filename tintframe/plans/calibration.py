"""Queries over chart frames: sampling, gates, fits, validation, and applying the fitted stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import col3, srgb_decode, srgb_encode, with_delta_e, xyy_to_xyz, xyz_d50_to_d65, xyz_d65_to_lab, xyz_to_linear_srgb
from ..operators import calibration as C
from ..operators import geometry, transform
from ..sources import adapters
from ..sources.chart import chart_reference, chart_xyy
from ..sources.shared import BROADCAST_ROWS, written
from . import sql as S

QUERIES: dict = {}
SQL: dict = {}


def query(text: str):
    """Register a query under its function's name, with the SQL that checks it."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, negative zeros made plain: what the comparison with SQL needs."""
    return df.select(*((F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0e0 AS {n}" for n in names)


def samples(spark, sf_dir):
    """24 rows a frame, computed once for all that a query does with them."""
    return written(C.patch_samples(adapters.chart_pixels(spark, sf_dir)), "samples")


BASE = (S.reference_values(), S.PX, S.SAMPLES)
MEANS = (*C.MEAN, *C.VARIANCE)


@query(S.with_(*BASE) + f"SELECT CAST(frame AS INT) AS frame, CAST(patch_idx AS INT) AS patch_idx, {r6(*MEANS)}, clip, n FROM samples")
def a01_patch_samples(spark, sf_dir):
    return rounded(C.patch_samples(adapters.chart_pixels(spark, sf_dir))).select("frame", "patch_idx", *MEANS, "clip", "n")


QUAD = {"x0": 40.0, "y0": 40.0, "x1": 440.0, "y1": 34.0, "x2": 440.0, "y2": 280.0, "x3": 40.0, "y3": 280.0}
_CORNER = lambda a: f"(1-u)*(1-v)*{QUAD[a + '0']} + u*(1-v)*{QUAD[a + '1']} + u*v*{QUAD[a + '2']} + (1-u)*v*{QUAD[a + '3']}"
_TURN = lambda i, j: f"(px{j} - px{i})*(y + 0.5e0 - py{i}) - (py{j} - py{i})*(x + 0.5e0 - px{i})"
_TURNS = ", ".join(_TURN(i, (i + 1) % 4) for i in range(4))


@query(f"""WITH corners AS (SELECT p AS patch_idx, k, (p % 6 + CASE WHEN k IN (0, 3) THEN 0.2e0 ELSE 0.8e0 END)/6.0e0 AS u,
    (p // 6 + CASE WHEN k IN (0, 1) THEN 0.2e0 ELSE 0.8e0 END)/4.0e0 AS v FROM range(24) a(p), range(4) b(k)),
poly AS (SELECT patch_idx, {", ".join(f"max(CASE WHEN k = {k} THEN {_CORNER(a)} END) AS p{a}{k}" for a in "xy" for k in range(4))} FROM corners GROUP BY 1),
grid AS (SELECT DISTINCT (l_orderkey*7 + l_linenumber*13) % 480 AS x, (l_partkey*11 + l_suppkey) % 320 AS y FROM lineitem)
SELECT CAST(patch_idx AS INT) AS patch_idx, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM grid JOIN poly
ON least({_TURNS}) >= 0 OR greatest({_TURNS}) <= 0 GROUP BY 1""")
def j01_polygon_containment(spark, sf_dir):
    quads = spark.range(1).select(*(F.lit(v).alias(k) for k, v in QUAD.items()))
    hits = geometry.pixels_in_patches(adapters.grid_pixels(spark, sf_dir), geometry.patch_polygons(quads), [])
    return hits.groupBy("patch_idx").agg(F.count("*").alias("n"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"))


_CV = [f"sqrt(var_{c})/greatest(mean_{c}, 0.01)" for c in "rgb"]
_CHROMA = "(greatest(mean_r, mean_g, mean_b) - least(mean_r, mean_g, mean_b))/greatest((mean_r + mean_g + mean_b)/3, 1e-6)"
_NAMES = "concat_ws('|', CASE WHEN clip & 1 <> 0 THEN 'R' END, CASE WHEN clip & 2 <> 0 THEN 'G' END, CASE WHEN clip & 4 <> 0 THEN 'B' END)"
def gates_sql(pixels: str = "64", cv: str = "0.05", neutral: str = "true") -> str:
    """whole and failures, with thresholds and whether the neutral row counts as SQL text over ``samples``."""
    noisy = " ".join(
        f"UNION ALL SELECT frame, patch_idx*8 + {2 + k}, patch_idx, 'channel {k} coefficient of variation', printf('cv=%.6f', {c}) FROM whole WHERE patches = 24 AND {c} > {cv}" for k, c in enumerate(_CV)
    )
    return f"""whole AS (SELECT *, {S.lum('mean')} AS lum, {_CHROMA} AS chroma, count(*) OVER (PARTITION BY frame) AS patches FROM samples),
failures AS (
  SELECT frame, patch_idx*8 AS ord, patch_idx, 'clipped channels: ' || {_NAMES} AS reason, printf('0x%02x', clip) AS measured FROM whole WHERE patches = 24 AND clip <> 0
  UNION ALL SELECT frame, patch_idx*8 + 1, patch_idx, 'insufficient patch pixels', CAST(n AS VARCHAR) FROM whole WHERE patches = 24 AND n < {pixels}
  {noisy}
  UNION ALL SELECT DISTINCT frame, 0, NULL, 'wrong patch count', CAST(patches AS VARCHAR) FROM whole WHERE patches <> 24
  UNION ALL SELECT frame, 1000, NULL, 'neutral row reversed; rotate corners', 'non-monotonic luminance' FROM
    (SELECT frame, lum, lag(lum) OVER (PARTITION BY frame ORDER BY patch_idx) AS before FROM whole WHERE patches = 24 AND patch_idx >= 18 AND {neutral}) GROUP BY frame HAVING bool_or(before <= lum)
  UNION ALL SELECT frame, 1001, NULL, 'last row is not the neutral row; check corner order', printf('last-row-chroma=%.6f, preceding-chroma=%.6f', l, f) FROM
    (SELECT frame, greatest(max(CASE WHEN patch_idx >= 18 THEN chroma END), 0) AS l, greatest(max(CASE WHEN patch_idx < 18 THEN chroma END), 0) AS f FROM whole WHERE patches = 24 AND {neutral} GROUP BY frame)
    WHERE l >= 0.25 OR f <= 0.25)"""


GATES = gates_sql()


@query(S.with_(*BASE, GATES) + "SELECT CAST(frame AS INT) AS frame, CAST(ord AS INT) AS ord, CAST(patch_idx AS INT) AS patch_idx, reason, measured FROM failures")
def g01_gate_failures(spark, sf_dir):
    return C.gate_failures(samples(spark, sf_dir))


@query(S.with_(*BASE, GATES) + """SELECT CAST(frame AS INT) AS frame, count(DISTINCT coalesce(patch_idx, -1)) FILTER (starts_with(reason, 'clipped')) AS clipped,
  count(DISTINCT coalesce(patch_idx, -1)) FILTER (contains(reason, 'coefficient of variation')) AS noisy, bool_or(starts_with(reason, 'last row')) AS layout,
  count(DISTINCT coalesce(patch_idx, -1)) FILTER (NOT starts_with(reason, 'clipped') AND NOT contains(reason, 'coefficient of variation') AND NOT starts_with(reason, 'last row')) AS other
FROM failures GROUP BY 1""")
def a07_gate_warning_counts(spark, sf_dir):
    return C.gate_warnings(C.gate_failures(samples(spark, sf_dir)))


FIT = (*BASE, S.fit_ctes())


@query(S.with_(*FIT) + f"SELECT CAST(frame AS INT) AS frame, {r6('exposure', 'c_r', 'c_g', 'c_b')} FROM stages")
def f01_exposure_channel(spark, sf_dir):
    joined = C.with_targets(samples(spark, sf_dir), chart_reference(spark))
    return rounded(C.exposure_and_channels(joined))


MATRIX = [f"m{i}{j}" for i in range(3) for j in range(3)]


@query(S.with_(*FIT) + f"SELECT CAST(frame AS INT) AS frame, {r6(*MATRIX)} FROM stages")
def f02_color_matrix(spark, sf_dir):
    return rounded(C.fit(samples(spark, sf_dir), chart_reference(spark))).select("frame", *MATRIX)


def _pivoted(source: str, keep: str, rows: int, sides: int, least: str) -> list[str]:
    """CTEs of elimination with row pivots over columns e00.. and s00.. (a row's right sides), ending in ``el{rows - 1}`` with ``fine``."""
    width, ctes = rows + sides, []
    name = lambda i, j: f"e{i}{j}" if j < rows else f"s{i}{j - rows}"
    every = ", ".join(name(i, j) for i in range(rows) for j in range(width))
    for c in range(rows):
        top = ", ".join(f"abs({name(i, c)})" for i in range(c, rows))
        pick = " ".join(f"WHEN abs({name(i, c)}) = greatest({top}) THEN {i}" for i in range(c, rows))
        ctes.append(f"pick{c} AS (SELECT {keep}, {every}, {'fine AND ' if c else ''}greatest({top}) >= {least} AS fine, CASE {pick} END AS pick FROM {source})")
        up = {name(c, j): "CASE pick " + " ".join(f"WHEN {i} THEN {name(i, j)}" for i in range(c, rows)) + " END" for j in range(width)}
        down = {name(i, j): f"CASE WHEN pick = {i} THEN {name(c, j)} ELSE {name(i, j)} END" for i in range(c + 1, rows) for j in range(width)}
        swapped = {name(i, j): (up | down).get(name(i, j), name(i, j)) for i in range(rows) for j in range(width)}
        ctes.append(f"swap{c} AS (SELECT {keep}, fine, {', '.join(f'{v} AS {k}' for k, v in swapped.items())} FROM pick{c})")
        cleared = [name(i, j) if i == c else f"CASE WHEN fine THEN {name(i, j)} - {name(i, c)}/{name(c, c)}*{name(c, j)} END AS {name(i, j)}" for i in range(rows) for j in range(width)]
        ctes.append(f"el{c} AS (SELECT {keep}, fine, {', '.join(cleared)} FROM swap{c})")
        source = f"el{c}"
    return ctes


# How far blue is from being green alone, in five copies of every frame.
APART = (1.0, 1e-2, 1e-4, 1e-9, 0.0)
_COPIES = "copies AS (SELECT frame*5 + v AS frame, patch_idx, mean_r, mean_g, mean_g + e*(mean_b - mean_g) AS mean_b, var_r, var_g, var_b, clip, n FROM samples, (VALUES " + ", ".join(f"({i}, {e!r}::DOUBLE)" for i, e in enumerate(APART)) + ") t(v, e))"
_FITTED = S.fit_ctes(joined="SELECT s.*, ref.* EXCLUDE (patch_idx) FROM copies s JOIN ref USING (patch_idx)").split("solved AS (")[0].rstrip().rstrip(",")
_SYSTEM = "system AS (SELECT frame, " + ", ".join(f"a{min(i, j)}{max(i, j)} AS e{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"b{i}{j} AS s{i}{j}" for i in range(3) for j in range(3)) + " FROM sums)"


@query(S.with_(*BASE, _COPIES, _FITTED, _SYSTEM, *_pivoted("system", "frame", 3, 3, "1e-14")) + "SELECT CAST(frame AS INT) AS frame, CASE WHEN NOT fine THEN 'singular matrix' END AS error, " + ", ".join(f"CASE WHEN fine AND frame % 5 < 2 THEN round(s{i}{j}/e{i}{i}, 6) + 0e0 END AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM el2")
def f05_nearly_singular(spark, sf_dir):
    """Every frame in copies whose blue comes ever closer to its green: which of them can be fitted, and the matrices of those far from singular."""
    s, ref = samples(spark, sf_dir), chart_reference(spark)
    copies = s.withColumn("t", F.explode(F.array(*(F.struct(F.lit(i).alias("v"), F.lit(e).alias("e")) for i, e in enumerate(APART)))))
    blue = F.col("mean_g") + F.col("t.e") * (F.col("mean_b") - F.col("mean_g"))
    copies = written(copies.withColumns({"frame": F.col("frame") * 5 + F.col("t.v"), "mean_b": blue}).drop("t"), "copies")
    errors = C.fit_errors(copies, ref)
    fine = F.col("frame") % 5 < 2
    return rounded(errors.join(C.fit(copies, ref), "frame").select("frame", "error", *(F.when(fine, F.col(c)).alias(c) for c in MATRIX)))


def validated(spark, sf_dir):
    s, ref = samples(spark, sf_dir), chart_reference(spark)
    return C.validate(s, ref, C.fit(s, ref))


PATCH = ["out_r", "out_g", "out_b", "lab_l", "lab_a", "lab_b", "delta_e"]
VALID = (*FIT, S.validation_ctes())


@query(S.with_(*VALID) + f"SELECT CAST(frame AS INT) AS frame, CAST(patch_idx AS INT) AS patch_idx, {r6(*PATCH)} FROM scored")
def f04_patch_validation(spark, sf_dir):
    return rounded(validated(spark, sf_dir)).select("frame", "patch_idx", *PATCH)


_NORM = lambda p: "greatest(" + ", ".join("+".join(f"abs({p}{i}{j})" for j in range(3)) for i in range(3)) + ")"
REPORT = f"""conditioned AS (SELECT *, {S.inverse_sql(lambda i, j: f"m{i}{j}", "w")} FROM scored)
SELECT CAST(frame AS INT) AS frame, round(avg(delta_e), 6) AS mean_delta_e, round(median(delta_e), 6) AS median_delta_e, round(quantile_cont(delta_e, 0.95), 6) AS p95_delta_e,
  round(max(delta_e), 6) AS max_delta_e, round(coalesce(max(delta_e) FILTER (is_neutral), 0), 6) AS neutral_max_delta_e,
  round(coalesce(max(delta_e) FILTER (is_skin), 0), 6) AS skin_max_delta_e, round(any_value({_NORM('m')}*{_NORM('w')}), 6) AS condition_number, count(*) AS patch_count
FROM conditioned GROUP BY 1"""


@query(S.with_(*VALID) + ", " + REPORT)
def a03_validation_report(spark, sf_dir):
    return rounded(C.report(validated(spark, sf_dir)))


@query(S.with_(*VALID) + ", " + REPORT)
def flagship_calibration(spark, sf_dir):
    """Per frame, how well the fitted transform reproduces the chart."""
    return rounded(C.report(validated(spark, sf_dir)))


@query(
    S.with_(
        *BASE,
        S.fit_ctes("frame, held_out", "SELECT s.*, ref.* EXCLUDE (patch_idx), h.held_out FROM samples s JOIN ref USING (patch_idx) CROSS JOIN (SELECT range AS held_out FROM range(24)) h WHERE s.patch_idx <> h.held_out"),
        S.validation_ctes("SELECT *, patch_idx AS held_out FROM samples", "frame, held_out"),
    )
    + "SELECT CAST(frame AS INT) AS frame, CAST(held_out AS INT) AS held_out, round(delta_e, 5) AS delta_e FROM scored"
)
def f08_leave_one_out(spark, sf_dir):
    return rounded(C.leave_one_out(samples(spark, sf_dir), chart_reference(spark)), 5)


@query(S.with_(*FIT, "first_stages AS (SELECT * EXCLUDE (frame) FROM stages WHERE frame = 0)", "against AS (SELECT f.frame, p.* FROM (SELECT DISTINCT frame FROM samples) f, first_stages p)", S.validation_ctes(stages="against")) + ", " + REPORT)
def i04_chart_check(spark, sf_dir):
    """Frame 0's stored stages against every frame; nothing is fitted anew. The stages are one row, put in as constants."""
    s, ref = samples(spark, sf_dir), chart_reference(spark)
    stored = C.fit(s.filter("frame = 0"), ref).first()
    against = s.select("frame").distinct().withColumns({c: F.lit(stored[c] if stored else None).cast("double") for c in C.STAGES})
    return rounded(C.report(C.validate(s, ref, against)))


@query(S.with_(*VALID) + """SELECT CAST(frame AS INT) AS frame, CAST(rank AS INT) AS rank, patch, round(delta_e, 6) AS delta_e, round(delta_e/greatest(worst, 1e-12), 6) AS relative FROM
  (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY delta_e DESC, patch_idx) AS rank, max(delta_e) OVER (PARTITION BY frame) AS worst FROM scored) WHERE rank <= 5""")
def o05_weakest_patches(spark, sf_dir):
    return rounded(C.weakest(validated(spark, sf_dir))).select("frame", "rank", "patch", "delta_e", "relative")


@query(S.with_(*VALID) + """SELECT CAST(frame AS INT) AS frame, CAST(patch_idx AS INT) AS patch_idx,
  round(delta_e/greatest(max(delta_e) OVER (PARTITION BY frame), 1e-12), 6) AS relative FROM scored""")
def o06_relative_error(spark, sf_dir):
    return rounded(C.weakest(validated(spark, sf_dir), 24)).select("frame", "patch_idx", "relative")


#: Engines differ in the last bits of a power; the queries round to so many places before they quantise.
PLACES = 9


def applied(spark, sf_dir):
    """Every pixel through its frame's stages, which are one row a frame and go to the pixels where their samples say that they are few."""
    px, ref, taken = adapters.chart_pixels(spark, sf_dir), chart_reference(spark), samples(spark, sf_dir)
    stages = C.fit(taken, ref)
    few = taken.count() <= 24 * BROADCAST_ROWS
    return transform.clip_flags(C.corrected(px.join(F.broadcast(stages) if few else stages, "frame"), ("r", "g", "b")))


_OUT = S.CORRECTED.replace("mean_r", "px.r").replace("mean_g", "px.g").replace("mean_b", "px.b")
APPLY = (
    *FIT,
    f"pixels AS (SELECT px.frame, px.patch_idx, {_OUT} FROM px JOIN stages USING (frame))",
    "applied AS (SELECT *, " + " + ".join(f"CASE WHEN out_{c} < 0 THEN {1 << i} ELSE 0 END + CASE WHEN out_{c} > 1 THEN {8 << i} ELSE 0 END" for i, c in enumerate("rgb")) + " AS flags FROM pixels)",
)


@query(S.with_(*APPLY) + "SELECT CAST(frame AS INT) AS frame, CAST(flags AS INT) AS flags, count(*) AS pixels FROM applied GROUP BY 1, 2")
def t02_apply_clip_flags(spark, sf_dir):
    return applied(spark, sf_dir).groupBy("frame", "flags").agg(F.count("*").alias("pixels"))


@query(S.with_(*APPLY) + "SELECT CAST(frame AS INT) AS frame, count(*) AS pixels, count(*) FILTER (flags <> 0) AS clipped, round(count(*) FILTER (flags <> 0)/count(*), 6) AS share, count(*) FILTER (flags <> 0) > 0.01*count(*) AS warn FROM applied GROUP BY 1")
def t04_clip_counts(spark, sf_dir):
    n, clipped = F.count("*"), F.count_if(F.col("flags") != 0)
    out = applied(spark, sf_dir).groupBy("frame").agg(n.alias("pixels"), clipped.alias("clipped"))
    return rounded(out.withColumns({"share": F.col("clipped") / F.col("pixels"), "warn": F.col("clipped") > 0.01 * F.col("pixels")}))


_ENC = lambda v: f"CASE WHEN {v} <= 0.0031308 THEN 12.92*{v} ELSE 1.055*pow(greatest({v}, 0), 1/2.4e0) - 0.055 END"
_CODE = lambda c: f"CAST(least(greatest(round(round({_ENC(f'least(greatest(out_{c}, 0), 1)')}, 9)*65535), 0), 65535) AS BIGINT)"


@query(S.with_(*APPLY) + f"SELECT CAST(frame AS INT) AS frame, CAST(patch_idx AS INT) AS patch_idx, {', '.join(f'CAST(sum({_CODE(c)}) AS BIGINT) AS code_{c}' for c in 'rgb')} FROM applied GROUP BY 1, 2")
def t03_quantize_u16(spark, sf_dir):
    coded = transform.encode_srgb(applied(spark, sf_dir), PLACES)
    return coded.groupBy("frame", "patch_idx").agg(*(F.sum(f"code_{c}").alias(f"code_{c}") for c in "rgb"))


@query(S.with_(*APPLY) + f"SELECT CAST(frame AS INT) AS frame, CAST(v AS INT) AS value, count(*) AS pixels FROM (SELECT frame, ({_CODE('g')} + 128)//257 AS v FROM applied) GROUP BY 1, 2")
def k04_u16_to_u8(spark, sf_dir):
    coded = transform.encode_srgb(applied(spark, sf_dir), PLACES).withColumn("value", transform.to_8_bit("code_g"))
    return coded.groupBy("frame", "value").agg(F.count("*").alias("pixels"))


def _wide(space: str) -> str:
    m = transform.from_rec709(space)
    lin = ", ".join("+".join(f"({m[i][j]!r})*CAST(CAST(out_{x} AS FLOAT) AS DOUBLE)" for j, x in enumerate("rgb")) + f" AS lin_{c}" for i, c in enumerate("rgb"))
    curve = _ENC if space != "adobe-rgb" else lambda v: f"pow(greatest({v}, 0), {1 / transform.ADOBE_GAMMA!r})"
    enc = ", ".join(f"round({curve(f'lin_{c}')}, 9) AS enc_{c}" for c in "rgb")
    scaled = ", ".join(f"enc_{c}*65535" for c in "rgb")
    code = ", ".join(f"CAST(sum(CAST(least(greatest(round(enc_{c}*65535), 0), 65535) AS BIGINT)) AS BIGINT) AS code_{c}" for c in "rgb")
    return (
        S.with_(*APPLY, f"lin AS (SELECT *, {lin} FROM applied)", f"enc AS (SELECT *, {enc} FROM lin)")
        + f"SELECT CAST(frame AS INT) AS frame, {code}, count(*) FILTER (NOT (least({scaled}) >= -0.5 AND greatest({scaled}) <= 65535.5 AND least(lin_r, lin_g, lin_b) > -1e-9)) AS clipped FROM enc GROUP BY 1"
    )


def _wide_query(space):
    def f(spark, sf_dir):
        coded = transform.encode_space(applied(spark, sf_dir), space, PLACES)
        return coded.groupBy("frame").agg(*(F.sum(f"code_{c}").alias(f"code_{c}") for c in "rgb"), F.count_if(~F.col("fits")).alias("clipped"))

    return f


for _name, _space in (("t05_display_p3", "display-p3"), ("t05_adobe_rgb", "adobe-rgb")):
    QUERIES[_name], SQL[_name] = _wide_query(_space), _wide(_space)



def _m(m, v):
    return ["(" + " + ".join(f"({m[i][j]!r})*{v[j]}" for j in range(3)) + ")" for i in range(3)]


def _chart_sql() -> str:
    from ..functions.colour import BRADFORD_D50_TO_D65, XYZ_TO_RGB

    d65 = _m(BRADFORD_D50_TO_D65, ["d50_x", "d50_y", "d50_z"])
    rgb = _m(XYZ_TO_RGB, ["d65_x", "d65_y", "d65_z"])
    lab = S.lab_of(["d65_x", "d65_y", "d65_z"])
    names = ["d50_x", "d50_y", "d50_z", "d65_x", "d65_y", "d65_z", "lin_r", "lin_g", "lin_b", "lab_l", "lab_a", "lab_b", "enc_r", "dec_r"]
    return (
        S.with_(
            S.xyy_values(),
            "a AS (SELECT *, x*big_y/y AS d50_x, big_y AS d50_y, (1 - x - y)*big_y/y AS d50_z FROM xyy)",
            f"b AS (SELECT *, {', '.join(f'{v} AS d65_{c}' for v, c in zip(d65, 'xyz', strict=True))} FROM a)",
            f"c AS (SELECT *, {', '.join(f'{v} AS lin_{c}' for v, c in zip(rgb, 'rgb', strict=True))}, {', '.join(f'{v} AS lab_{c}' for v, c in zip(lab, 'lab', strict=True))} FROM b)",
            f"d AS (SELECT *, {_ENC('lin_r')} AS enc_r FROM c)",
            "e AS (SELECT *, CASE WHEN enc_r <= 0.04045 THEN enc_r/12.92 ELSE pow((enc_r + 0.055)/1.055, 2.4) END AS dec_r FROM d)",
        )
        + f"SELECT n.revision, CAST(patch_idx AS INT) AS patch_idx, l.orders AS uses, {r6(*names)} FROM e n JOIN (SELECT l_partkey % 24 AS p, count(*) AS orders FROM lineitem GROUP BY 1) l ON l.p = patch_idx"
    )


@query(_chart_sql())
def r01_chart_colours(spark, sf_dir):
    """Both revisions' colours from their xyY, through every space and back, with how many pixels use each patch."""
    d50, d65, lin = ("d50_x", "d50_y", "d50_z"), ("d65_x", "d65_y", "d65_z"), ("lin_r", "lin_g", "lin_b")
    put = lambda df, names, v: df.withColumns(dict(zip(names, v, strict=True)))
    df = put(chart_xyy(spark), d50, xyy_to_xyz(col3("x", "y", "big_y")))
    df = put(df, d65, xyz_d50_to_d65(col3(*d50)))
    df = put(put(df, lin, xyz_to_linear_srgb(col3(*d65))), ("lab_l", "lab_a", "lab_b"), xyz_d65_to_lab(col3(*d65)))
    df = df.withColumn("enc_r", srgb_encode(F.col("lin_r"))).withColumn("dec_r", srgb_decode(F.col("enc_r")))
    uses = adapters.chart_pixels(spark, sf_dir).groupBy("patch_idx").agg(F.count("*").alias("uses"))
    return rounded(df.join(uses, "patch_idx")).select("revision", "patch_idx", "uses", *d50, *d65, *lin, "lab_l", "lab_a", "lab_b", "enc_r", "dec_r")


@query(
    S.with_(*BASE, "labs AS (SELECT s.frame, s.patch_idx, 100*mean_r AS l1, 80*mean_g - 40 AS a1, 80*mean_b - 40 AS b1, t_l AS l2, t_a AS a2, t_bb AS b2 FROM samples s JOIN ref USING (patch_idx))", S.delta_e_ctes("labs", ("l1", "a1", "b1"), ("l2", "a2", "b2")))
    + "SELECT CAST(frame AS INT) AS frame, CAST(patch_idx AS INT) AS patch_idx, round(delta_e, 6) AS delta_e FROM scored"
)
def p08_ciede2000(spark, sf_dir):
    s = C.with_targets(C.patch_samples(adapters.chart_pixels(spark, sf_dir)), chart_reference(spark))
    labs = s.select("frame", "patch_idx", (100 * F.col("mean_r")).alias("l1"), (80 * F.col("mean_g") - 40).alias("a1"), (80 * F.col("mean_b") - 40).alias("b1"), "t_l", "t_a", "t_bb")
    return rounded(with_delta_e(labs, ("l1", "a1", "b1"), ("t_l", "t_a", "t_bb"), "delta_e")).select("frame", "patch_idx", "delta_e")
