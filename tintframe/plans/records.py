"""Queries over acceptance rules, sealed profiles, interchange texts, the library and batch runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.colour import col3, lab_to_xyz_d65
from ..operators import acceptance as A
from ..operators import batch, calibration, contract, interchange
from ..operators import records as R
from ..operators import reports
from ..operators.ordering import with_place
from ..sources import adapters
from ..sources.chart import PATCHES, chart_reference
from ..sources.shared import written
from . import sql as S
from .calibration import FIT, GATES, QUAD, REPORT, VALID, rounded, samples
from .files import ACTIVE, CAP, _CUBE, captures_of

QUERIES: dict = {}
SQL: dict = {}


def query(text: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return put


def key():
    return F.col("o_orderkey")


def orders(spark, sf_dir):
    return adapters.table(spark, sf_dir, "orders")


# --- decode contracts and cameras

_OFF = {"output_color": (3, "srgb"), "output_depth": (5, "u8"), "white_balance": (7, "camera"), "gamma": (11, "2.2 4.5"), "no_auto_bright": (13, "false"), "demosaic": (17, "vng"), "highlight": (19, "blend"), "orientation": (23, "flipped"), "no_auto_scale": (29, "true")}


@query("SELECT o_orderkey AS contract, CASE " + " ".join(f"WHEN o_orderkey % {_OFF[c][0]} = 0 THEN '{t}'" for c, _, t in A.PINNED) + " END AS error FROM orders")
def g06_contract_validation(spark, sf_dir):
    """Orders as contracts, each with settings off their pinned values where its number is a multiple of a prime."""
    settings = {c: F.when(key() % _OFF[c][0] == 0, _OFF[c][1]).otherwise(v) for c, v, _ in A.PINNED}
    return orders(spark, sf_dir).select(key().alias("contract"), *(v.alias(c) for c, v in settings.items())).select("contract", A.contract_error().alias("error"))


@query("""WITH f AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS allow, o_orderkey % 3 <> 0 AS camera, o_orderkey % 13 <> 0 AS self, o_orderstatus <> 'P' AS raw, o_orderkey % 17 <> 0 AS known,
    CASE WHEN o_orderkey % 11 = 0 THEN 'demosaic' WHEN o_orderkey % 5 = 0 THEN 'version' ELSE 'same' END AS status FROM orders),
e AS (SELECT *, CASE WHEN NOT camera AND NOT allow THEN 'camera mismatch' WHEN NOT self THEN 'profile camera decoder identity disagrees with its decode contract'
    WHEN raw AND NOT known THEN 'RAW decoder identity disagrees with its contract' WHEN status = 'demosaic' AND NOT allow THEN 'decode-contract mismatch: ' || status END AS error FROM f)
SELECT k AS pair, error, CASE WHEN error IS NULL THEN concat_ws('|', CASE WHEN NOT camera THEN 'camera mismatch allowed for library calibration' END, CASE WHEN status = 'version' THEN 'decoder version differs' END,
  CASE WHEN status = 'demosaic' THEN 'decode-contract mismatch allowed for library calibration: ' || status END) END AS warnings FROM e""")
def g08_camera_policy(spark, sf_dir):
    """Orders as pairs of a profile and an image, under either policy."""
    pairs = orders(spark, sf_dir).select(
        key().alias("pair"),
        (key() % 2 == 0).alias("allow"),
        (key() % 3 != 0).alias("camera_same"),
        (key() % 13 != 0).alias("profile_consistent"),
        (F.col("o_orderstatus") != "P").alias("raw"),
        (key() % 17 != 0).alias("decoder_known"),
        F.when(key() % 11 == 0, "demosaic").when(key() % 5 == 0, "version").otherwise("same").alias("contract_status"),
    )
    return A.camera_check(pairs).select("pair", "error", F.array_join("warnings", "|").alias("warnings"))


@query(S.with_(CAP) + "SELECT path, coalesce(make, '') = 'click' AND coalesce(model, '') = 'R3' AS same FROM caps")
def j05_camera_identity(spark, sf_dir):
    return adapters.captures(spark, sf_dir).select("path", A.same_camera(F.col("make"), F.col("model"), F.lit("click"), F.lit("R3")).alias("same"))


# --- raw frames

_RAW = """raw AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 600 END AS width, o_orderkey % 29 <> 0 AS active, o_orderkey % 2 = 0 AS cfa, o_orderkey % 23 = 0 AS odd_cfa,
  o_orderkey % 19 <> 0 AS whole, o_orderkey % 17 = 0 AS missing, o_orderkey % 13 = 0 AS odd_grid, o_orderkey % 11 = 0 AS uneven, o_orderkey % 7 = 0 AS half, CAST(o_custkey % 70000 AS INT) AS white FROM orders)"""


@query(S.with_(_RAW) + """SELECT k AS frame, CASE WHEN width = 0 THEN 'empty RAW image' WHEN NOT active THEN 'RAW crop or active area is not the full frame' WHEN cfa AND odd_cfa THEN 'only RGB Bayer CFA is supported'
  WHEN NOT whole THEN 'floating-point RAW samples are not supported' WHEN missing THEN 'RAW sample count differs from image dimensions'
  WHEN cfa AND odd_grid THEN 'unsupported CFA black-level grid' WHEN NOT cfa AND odd_grid THEN 'unsupported LinearRaw black-level grid'
  WHEN NOT cfa AND uneven THEN 'LinearRaw black level varies across the repeat grid' WHEN half THEN 'fractional or out-of-range black level'
  WHEN white > 65535 THEN 'white level exceeds 16 bits' WHEN white <= 512 THEN 'white level is not greater than black level' END AS error FROM raw""")
def s09_raw_acceptance(spark, sf_dir):
    """Orders as headers of raw frames: mosaics with a 2x2 grid of black levels, and linear frames with three components."""
    cfa, c = key() % 2 == 0, F.col
    level = F.when(key() % 7 == 0, 512.5).otherwise(512.0)
    uneven = F.when(key() % 11 == 0, level + 1).otherwise(level)
    frames = orders(spark, sf_dir).select(
        key().alias("frame"),
        F.when(key() % 31 == 0, 0).otherwise(600).alias("width"),
        F.lit(400).alias("height"),
        (key() % 29 != 0).alias("active_full"),
        F.when(cfa, "cfa").otherwise("linear").alias("photometric"),
        F.when(cfa, 1).otherwise(3).alias("components"),
        F.when(key() % 23 == 0, "RGGG").otherwise("RGGB").alias("cfa"),
        (key() % 19 != 0).alias("integer_samples"),
        F.when(cfa, F.array(*[level] * 4)).otherwise(F.array(level, level, level, uneven, level, level)).alias("black"),
        F.when(key() % 13 == 0, 3).otherwise(2).alias("black_w"),
        F.when(cfa, 2).otherwise(1).alias("black_h"),
        F.when(cfa, 1).otherwise(3).alias("black_cpp"),
        F.array((c("o_custkey") % 70000).cast("int")).alias("white"),
    )
    samples_ = c("width").cast("long") * c("height") * c("components") - (c("frame") % 17 == 0).cast("long")
    return frames.withColumn("samples", samples_).select("frame", A.raw_frame_error().alias("error"))


@query("""SELECT l_orderkey*10 + l_linenumber AS shot, CASE WHEN l_tax > 0 AND l_discount > 0 THEN concat_ws(' ', printf('%.6f', round(1/l_quantity, 6)), printf('%.6f', round(0.01/l_tax, 6)), printf('%.6f', round(0.01/l_discount, 6))) END AS neutral FROM lineitem""")
def s14_display_neutral(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    neutral = A.display_neutral(F.array("l_quantity", F.col("l_tax") / 0.01, F.col("l_discount") / 0.01))
    shown = F.array_join(F.transform(neutral, lambda v: F.format_string("%.6f", F.round(v, 6))), " ")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("shot"), shown.alias("neutral"))


@query("SELECT CAST(l_suppkey % 10 AS INT) AS frame, bool_or(CAST(l_quantity*300 AS INT) > 2*CASE WHEN l_suppkey % 10 < 5 THEN 7400 ELSE 7600 END) AS corrupt FROM lineitem GROUP BY 1")
def s12_linear_sanity(spark, sf_dir):
    raw = adapters.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("frame"), (F.col("l_quantity") * 300).cast("int").alias("raw"))
    return A.corrupt_frames(raw.filter("frame < 5"), 7400).unionByName(A.corrupt_frames(raw.filter("frame >= 5"), 7600))


# --- metadata and exports

_TAGS = [("primary", 271), ("primary", 33432), ("primary", 274), ("exif", 34855), ("exif", 33434), ("exif", 42034), ("exif", 37500), ("gps", 2), ("gps", 0), ("gps", 1)]
_KINDS = ["ascii", "integer", "rational", "byte"]
_RULES = "rules(directory, tag, rule_kind, rule_count) AS (VALUES " + ", ".join(f"('{d}', {t}, '{k}', {n})" for d, tags in A.ALLOWED_TAGS.items() for t, (k, n) in tags.items()) + ")"


@query("WITH " + _RULES + ", e AS (SELECT l_orderkey*10 + l_linenumber AS entry, (" + str([d for d, _ in _TAGS]) + ")[l_partkey % 10 + 1] AS directory, (" + str([t for _, t in _TAGS]) + ")[l_partkey % 10 + 1] AS tag, (" + str(_KINDS) + """)[l_suppkey % 4 + 1] AS kind,
  l_linenumber AS n_values, l_quantity < 5 AS zero_denominator, l_quantity % 3 AS ending FROM lineitem)
SELECT entry, e.directory, CAST(e.tag AS INT) AS tag, CASE WHEN rule_kind IS NULL THEN 'not allowed' WHEN kind <> rule_kind THEN 'bad value'
  WHEN kind = 'ascii' THEN CASE WHEN ending = 0 THEN 'copied' WHEN ending = 1 AND e.tag = 33432 THEN 'copied' ELSE 'bad value' END
  WHEN kind = 'rational' THEN CASE WHEN n_values = rule_count AND NOT zero_denominator THEN 'copied' ELSE 'bad value' END
  WHEN n_values = rule_count THEN 'copied' ELSE 'bad value' END AS status FROM e LEFT JOIN rules r ON r.directory = e.directory AND r.tag = e.tag""")
def g13_metadata_allow_list(spark, sf_dir):
    """Line items as metadata entries; texts end in NUL, hold another, or lack it."""
    li, q = adapters.table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    pick = lambda vs, i: F.element_at(F.array(*map(F.lit, vs)), (i + 1).cast("int"))
    entries = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry"),
        pick([d for d, _ in _TAGS], F.col("l_partkey") % 10).alias("directory"),
        pick([t for _, t in _TAGS], F.col("l_partkey") % 10).alias("tag"),
        pick(_KINDS, F.col("l_suppkey") % 4).alias("kind"),
        F.when(q % 3 == 0, "one\0").when(q % 3 == 1, "one\0two\0").otherwise("one").alias("text"),
        F.col("l_linenumber").alias("n_values"),
        (q < 5).alias("zero_denominator"),
    )
    return A.checked_tags(entries, A.tag_rules(spark)).select("entry", "directory", "tag", "status")


_EXPORT = "CASE WHEN o_orderkey % 3 = 0 AND NOT (o_custkey % 130 BETWEEN 1 AND 100) THEN 'JPEG quality must be 1-100, got ' || (o_custkey % 130) END"


@query(f"SELECT o_orderkey AS export, {_EXPORT} AS error, CASE WHEN abs(round(o_totalprice/100*1e6)) <= 2147483647 THEN CAST(round(o_totalprice/100*1e6) AS INT) END AS numerator FROM orders")
def g17_export_options(spark, sf_dir):
    """Orders as exports, and their price as a signed rational over a million (x08)."""
    error = A.export_error(F.when(key() % 3 == 0, "jpeg").otherwise("png"), (F.col("o_custkey") % 130).cast("int"))
    return orders(spark, sf_dir).select(key().alias("export"), error.alias("error"), A.signed_rational(F.col("o_totalprice") / 100).alias("numerator"))


@query(S.with_(*FIT) + """SELECT CAST(frame AS INT) AS frame, CAST(k AS INT) AS variant, CASE WHEN k = 1 THEN 'quick-and-dirty profiles are measured from rendered images' WHEN k = 2 THEN 'a camera name is required'
  WHEN k = 3 THEN 'camera name must be printable ASCII' WHEN k = 4 THEN 'exposure and channel scales must be finite and positive' END AS error FROM stages, range(5) v(k)""")
def g15_dcp_refusals(spark, sf_dir):
    """Each frame's stages as they are, and in four ways that are refused."""
    stages = calibration.fit(samples(spark, sf_dir), chart_reference(spark))
    dcp = interchange.dcp_matrices(stages)
    rows = stages.join(dcp.select("frame", *(f"f{i}{j}" for i in range(3) for j in range(3))), "frame").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(4))))
    v, name = F.col("variant"), F.when(F.col("variant") == 2, " ").when(F.col("variant") == 3, "Käm 1").otherwise("Cam 1")
    scales = [F.when(v == 4, -F.col(c)).otherwise(F.col(c)) for c in ("exposure", "c_r", "c_g", "c_b")]
    # the forward matrix maps the camera's neutral, all ones, to D50 white: its rows add up to it
    white = [F.col(f"f{i}0") + F.col(f"f{i}1") + F.col(f"f{i}2") for i in range(3)]
    return rows.select("frame", "variant", A.dcp_refusal(v == 1, name, scales, white).alias("error"))


# --- profiles

#: Engines differ in the last bits of a fit; the queries seal numbers rounded to so many places.
PLACES = 6
_NUM = lambda v: f"CASE WHEN round({v}, 6) <> 0 AND abs(round({v}, 6)) < 1e-5 THEN CAST(CAST(round(round({v}, 6)*1e6) AS BIGINT) AS VARCHAR) || 'e-6' ELSE regexp_replace(regexp_replace(printf('%.6f', round({v}, 6) + 0e0), '0+$', ''), '[.]$', '.0') END"
_ITEMS = "CASE WHEN n_failures = 0 THEN '[]' ELSE '[' || chr(10) || items || chr(10) || '    ]' END"
# the text as a reader of profiles finds it; each <name> stands for a value
_PROFILE_TEXT = """{
  "schema-version": "1.0",
  "decode-contract": {
    "decoder": "decoder",
    "decoder-version": "1",
    "output-color": "raw",
    "output-depth": "u16",
    "gamma": [
      1.0,
      1.0
    ],
    "white-balance": {
      "unity": {
        "user-mul": [
          1.0,
          1.0,
          1.0,
          1.0
        ]
      }
    },
    "no-auto-bright": true,
    "demosaic": "<demosaic>",
    "highlight": "clip",
    "orientation": "as-shot",
    "no-auto-scale": false
  },
  "camera": {
    "make": "Cam",
    "model": "F<frame>",
    "decoder": "decoder",
    "decoder-version": "1"
  },
  "chart-revision": "classic-from-november2014",
  "dataset-digest": "<dataset>",
  "reference-digest": "<reference>",
  "transform": {
    "exposure-scale": <exposure>,
    "channel-scale": [
      <c_r>,
      <c_g>,
      <c_b>
    ],
    "matrix": [
      [
        <m00>,
        <m01>,
        <m02>
      ],
      [
        <m10>,
        <m11>,
        <m12>
      ],
      [
        <m20>,
        <m21>,
        <m22>
      ]
    ]
  },
  "validation": {
    "mean-delta-e": <mean_delta_e>,
    "max-delta-e": <max_delta_e>,
    "p95-delta-e": <p95_delta_e>,
    "neutral-max-delta-e": <neutral_max_delta_e>,
    "skin-max-delta-e": <skin_max_delta_e>,
    "condition-number": <condition_number>,
    "patch-count": <patch_count>
  },
  "quality": {
    "passed": <passed>,
    "overridden": <overridden>,
    "quick-and-dirty": <quick>,
    "failures": <failures>
  },
  "digest": ""
}"""
_CONTRACT_TEXT = '{"decoder":"decoder","decoder-version":"1","output-color":"raw","output-depth":"u16","gamma":[1.0,1.0],"white-balance":{"unity":{"user-mul":[1.0,1.0,1.0,1.0]}},"no-auto-bright":true,"demosaic":"ahd","highlight":"clip","orientation":"as-shot","no-auto-scale":false}'
_PLAIN_VALUES = {
    "demosaic": "CASE WHEN frame % 10 IN (3, 8) THEN 'vng' ELSE 'ahd' END",
    "frame": "frame",
    "dataset": "sha256('chart')",
    "reference": "sha256('reference ' || frame)",
    "patch_count": "patch_count",
    "passed": "(n_failures = 0)",
    "overridden": "(n_failures > 0 AND (frame % 2 = 0 OR frame % 3 = 0))",
    "quick": "(frame % 3 = 0)",
    "failures": _ITEMS,
}


def _filled(text: str, demosaic: str) -> str:
    import re

    values = _PLAIN_VALUES | {"demosaic": demosaic}
    parts = re.split(r"<(\w+)>", text)
    return " || ".join("'" + p + "'" if i % 2 == 0 else f"CAST({values[p]} AS VARCHAR)" if p in values else f"({_NUM(p)})" for i, p in enumerate(parts) if p)


def _profile_sql(demosaic: str = "'ahd'") -> str:
    item = "'      {' || chr(10) || '        \"patch\": ' || coalesce('\"' || name || '\"', 'null') || ',' || chr(10) || '        \"reason\": \"' || reason || '\",' || chr(10) || '        \"measured\": \"' || measured || '\"' || chr(10) || '      }'"
    flat = REPORT.replace("SELECT CAST(frame AS INT) AS frame,", "SELECT frame,")
    conditioned, report = flat.split("\nSELECT ", 1)
    names = ", ".join(f"({i}, '{A.patch_name(p)}')" for i, p in enumerate(PATCHES))
    return (
        S.with_(*VALID, conditioned, f"report AS (SELECT {report})")
        .rstrip()
        + ",\n"
        + GATES
        + f""",
patch_names(patch_idx, name) AS (VALUES {names}),
lists AS (SELECT frame, count(*) AS n, string_agg({item}, ',' || chr(10) ORDER BY ord) AS items FROM failures LEFT JOIN patch_names USING (patch_idx) GROUP BY 1),
parts AS (SELECT s.*, r.* EXCLUDE (frame), coalesce(n, 0) AS n_failures, items FROM stages s JOIN report r ON r.frame = s.frame LEFT JOIN lists l ON l.frame = s.frame),
bare AS (SELECT *, {_filled(_PROFILE_TEXT, demosaic)} AS text FROM parts),
sealed AS (SELECT frame, n_failures, sha256(text) AS digest, replace(text, '"digest": ""', '"digest": "' || sha256(text) || '"') AS json FROM bare)"""
    )


def profiles(spark, sf_dir, demosaic=None, dataset=None):
    """A profile a frame from its stages, report and gate failures; every second is forced, every third from a rendered image. The contract is the
    pinned one but for ``demosaic``, the chart's dataset 'chart' but for ``dataset``."""
    s, ref = samples(spark, sf_dir), chart_reference(spark)
    stages = written(calibration.fit(s, ref), "stages")
    report = calibration.report(calibration.validate(s, ref, stages))
    names = F.array(*(F.lit(A.patch_name(p)) for p in PATCHES))
    item = F.struct("ord", F.get(names, F.col("patch_idx")).alias("patch"), "reason", "measured")
    failures = calibration.gate_failures(s).groupBy("frame").agg(F.array_sort(F.collect_list(item)).alias("failures"))
    rows = stages.join(report, "frame").join(failures, "frame", "left")
    rows = rows.withColumn("failures", F.coalesce("failures", F.array().cast("array<struct<ord:int,patch:string,reason:string,measured:string>>")))
    forced, quick, n, frame = F.col("frame") % 2 == 0, F.col("frame") % 3 == 0, F.size("failures"), F.col("frame").cast("string")
    fixed = {"schema_version": R.SCHEMA_VERSION, "make": "Cam", "decoder": "decoder", "decoder_version": "1", "revision": "classic-from-november2014"}
    fixed |= {c: v for c, v, _ in A.PINNED}
    rows = rows.withColumns({k: F.lit(v) for k, v in fixed.items()})
    rows = rows.withColumns({"model": F.concat(F.lit("F"), frame), "dataset_digest": F.sha2(F.lit("chart") if dataset is None else dataset, 256), "reference_digest": F.sha2(F.concat(F.lit("reference "), frame), 256)})
    if demosaic is not None:
        rows = rows.withColumn("demosaic", demosaic)
    rows = rows.withColumns(A.provenance(n, forced, quick)).withColumns({"written": A.may_write(n, forced), "n_failures": n})
    return R.profile_json(rows, PLACES)


@query(_profile_sql() + "SELECT CAST(frame AS INT) AS frame, n_failures = 0 AS passed, n_failures > 0 AND (frame % 2 = 0 OR frame % 3 = 0) AS overridden, frame % 3 = 0 AS quick_and_dirty, n_failures = 0 OR frame % 2 = 0 AS written, digest, json FROM sealed")
def k07_profile_json(spark, sf_dir):
    """Sealed profiles (k07, i03), their provenance (i02) and whether they are written (g12)."""
    return profiles(spark, sf_dir).select("frame", "passed", "overridden", "quick_and_dirty", "written", "digest", "json")


@query(_profile_sql(_PLAIN_VALUES["demosaic"]) + """SELECT CAST(frame AS INT) AS frame, CASE frame % 5 WHEN 1 THEN 'unsupported schema version 2.0, expected 1.0' WHEN 2 THEN 'profile digest mismatch' WHEN 3 THEN 'invalid decode contract: demosaic' WHEN 4 THEN 'invalid profile JSON' END AS error FROM sealed""")
def s20_profile_verify(spark, sf_dir):
    """Sealed profiles read back: untouched, of another schema, changed after sealing, sealed with another contract inside, and cut off."""
    k = F.col("frame") % 5
    json = (
        F.when(k == 1, F.replace("json", F.lit('"schema-version": "1.0"'), F.lit('"schema-version": "2.0"')))
        .when(k == 2, F.replace("json", F.lit('"make": "Cam"'), F.lit('"make": "Kam"')))
        .when(k == 4, F.substring("json", 1, 200))
        .otherwise(F.col("json"))
    )
    sealed = profiles(spark, sf_dir, F.when(k == 3, "vng").otherwise("ahd")).select("frame", json.alias("json"))
    return R.verified(sealed).select("frame", "error")


_PLAIN = lambda v: f"regexp_replace(regexp_replace(printf('%.6f', round({v}, 6) + 0e0), '0+$', ''), '[.]$', '')"


def _clf_sql(source: str, named: str) -> str:
    row = lambda vs: "'            ' || " + " || ' ' || ".join(vs) + " || chr(10)"
    scale = [f"1/(exposure*{c})" for c in ("c_r", "c_g", "c_b")]
    one = " || ".join(row([_PLAIN(scale[i]) if i == j else "'0'" for j in range(3)]) for i in range(3))
    two = " || ".join(row([_PLAIN(f"m{i}{j}") for j in range(3)]) for i in range(3))
    block = lambda title, rows: f"'    <Matrix inBitDepth=\"32f\" outBitDepth=\"32f\">' || chr(10) || '        <Description>{title}</Description>' || chr(10) || '        <Array dim=\"3 3\">' || chr(10) || {rows} || '        </Array>' || chr(10) || '    </Matrix>' || chr(10)"
    head = f"'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<ProcessList compCLFversion=\"3.0\"'{named} || '    <OutputDescriptor>linear sRGB D65</OutputDescriptor>' || chr(10)"
    return f"clf AS (SELECT *, {head} || {block('channel and exposure scaling', one)} || {block('color matrix', two)} || '</ProcessList>' || chr(10) AS clf FROM {source})"


_NAMED_CLF = f""" || ' id="profile-' || left(digest, 12) || '">' || chr(10) || '    <Description>profile ' || digest || '</Description>' || chr(10) ||
  '    <InputDescriptor>normalized linear camera RGB, decode contract digest ' || left(sha256('{_CONTRACT_TEXT}'), 16) || ', camera Cam F' || frame || '</InputDescriptor>' || chr(10)"""


_SUMMARY = ("mean_delta_e", "max_delta_e", "p95_delta_e", "neutral_max_delta_e", "skin_max_delta_e", "condition_number")
_STORED = "against AS (SELECT (p.frame + 9) % 10 AS frame, " + ", ".join(f"round({c}, 6) AS {c}" for c in calibration.STAGES) + " FROM stages p)"


@query(
    _profile_sql().replace("<dataset>", "")
    + ", checked AS (SELECT * FROM ("
    + S.with_(*FIT, _STORED, S.validation_ctes(stages="against"))
    + ", "
    + REPORT
    + """))
SELECT CAST((s.frame + 9) % 10 AS INT) AS frame, CASE WHEN s.frame % 5 = 2 THEN 'profile chart dataset digest does not match the pinned dataset' END AS error, """
    + ", ".join(f"CASE WHEN s.frame % 5 <> 2 THEN round(c.{k}, 3) END AS {k}, CASE WHEN s.frame % 5 <> 2 THEN round(CAST(json_extract_string(json, '$.validation.{k.replace('_', '-')}') AS DOUBLE), 3) END AS baseline_{k}" for k in _SUMMARY)
    + """, CASE WHEN s.frame % 5 <> 2 THEN coalesce(l.n, 0) END AS gate_failures, CASE WHEN s.frame % 5 <> 2 THEN coalesce(l.n, 0) = 0 END AS quality_passed
FROM sealed s JOIN checked c ON c.frame = (s.frame + 9) % 10 LEFT JOIN lists l ON l.frame = (s.frame + 9) % 10"""
)
def i04_sealed_chart_check(spark, sf_dir):
    """Every frame's chart against the sealed profile of the frame after it, with the summary stored there; two profiles are of another dataset."""
    s = samples(spark, sf_dir)
    dataset = F.when(F.col("frame") % 5 == 2, "old chart").otherwise("chart")
    sealed = profiles(spark, sf_dir, dataset=dataset).select(((F.col("frame") + 9) % 10).alias("frame"), "json")
    pinned = T.file_sha256(F.lit("chart"))
    digest = spark.range(1).select(pinned.alias("d")).first().d
    out = R.chart_checks(s, chart_reference(spark), sealed, digest, calibration.gate_failures(s))
    numbers = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for k in R.SUMMARY for c in (k, f"baseline_{k}")]
    return rounded(out.select("frame", "error", *numbers, "gate_failures", "quality_passed"), 3)


_FORMATS = ["clf", "cube", "dcp", "dcp", "clf", "icc"]


@query(
    _profile_sql(_PLAIN_VALUES["demosaic"])
    + ",\n"
    + _clf_sql("(SELECT s.* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in calibration.STAGES) + "), digest FROM stages s JOIN sealed USING (frame))", _NAMED_CLF)
    + """, asked AS (SELECT c.*, k, (['clf', 'cube', 'dcp', 'dcp', 'clf', 'icc'])[k + 1] AS format, CASE WHEN k IN (2, 4) THEN 'Cam 1' END AS camera_name FROM clf c, range(6) t(k))
SELECT CAST(frame AS INT) AS frame, CAST(k AS INT) AS request, format, CASE WHEN frame % 5 = 3 THEN 'profile validation failed: invalid decode contract: demosaic'
  WHEN k = 3 THEN '--camera-name is required for dcp; use the camera name Lightroom shows for your RAW files' WHEN k = 4 THEN '--camera-name only applies to --format dcp'
  WHEN k = 5 THEN 'unknown format' WHEN k = 2 AND frame % 3 = 0 THEN 'quick-and-dirty profiles are measured from rendered images' END AS error,
  CASE WHEN frame % 5 <> 3 AND k = 0 THEN sha256(clf) END AS clf_sha256, CASE WHEN frame % 5 <> 3 AND k = 1 THEN 64 END AS cube_lines FROM asked"""
)
def i08_exports(spark, sf_dir):
    """Six exports asked of every profile: formats with and without a camera name, and one that is unknown."""
    k = F.col("frame") % 5
    sealed = profiles(spark, sf_dir, F.when(k == 3, "vng").otherwise("ahd")).select("frame", "json")
    asked = sealed.withColumn("request", F.explode(F.sequence(F.lit(0), F.lit(5))))
    asked = asked.withColumns({"format": F.get(F.array(*map(F.lit, _FORMATS)), F.col("request")), "camera_name": F.when(F.col("request").isin(2, 4), "Cam 1")})
    out = R.exports(asked, PLACES, 4)
    clf = F.when(F.col("format") == "clf", F.sha2("content", 256))
    lines = F.when(F.col("format") == "cube", F.regexp_count("content", F.lit("\n")) - 3)
    return out.select("frame", "request", "format", "error", clf.alias("clf_sha256"), lines.alias("cube_lines"))


# --- interchange texts

def fitted(spark, sf_dir):
    return calibration.fit(samples(spark, sf_dir), chart_reference(spark))


@query(_profile_sql() + ",\n" + _clf_sql("(SELECT s.*, digest FROM stages s JOIN sealed USING (frame))", _NAMED_CLF) + "SELECT CAST(frame AS INT) AS frame, clf FROM clf")
def k08_clf_text(spark, sf_dir):
    """Each frame's sealed profile as a process list that names it."""
    return R.clf_text(profiles(spark, sf_dir), PLACES).select("frame", "clf")


_VALUES = " || ' ' || ".join([_PLAIN(f"1/(exposure*c_{c})") if i == j else "'0'" for i, c in enumerate("rgb") for j in range(3)] + [_PLAIN(f"m{i}{j}") for i in range(3) for j in range(3)])


@query(S.with_(*FIT) + f"""SELECT CAST(frame AS INT) AS frame, CASE frame % 5 WHEN 1 THEN 'missing closing </Array> tag in CLF' WHEN 2 THEN 'invalid float in Array' WHEN 3 THEN 'expected 9 float values in 3x3 Array' WHEN 4 THEN 'expected exactly 2 Matrix Array nodes' END AS error,
  CASE WHEN frame % 5 = 0 THEN {_VALUES} END AS numbers FROM stages""")
def s23_clf_parse(spark, sf_dir):
    """CLF texts read back: as written, with an open array, a word that is no number, an array of eight, and a third array."""
    k = F.col("frame") % 5
    texts = R.clf_text(fitted(spark, sf_dir), PLACES).select("frame", "clf")
    last = F.regexp_replace("clf", r"(?s)</Array>(?!.*</Array>)", "")
    odd = (
        F.when(k == 1, last)
        .when(k == 2, F.regexp_replace("clf", r"(?s)\s0 0\n", " zero 0\n"))
        .when(k == 3, F.regexp_replace("clf", r"(?s)\s0 0\n", " 0\n"))
        .when(k == 4, F.concat("clf", F.lit('<Array dim="3 3">1 0 0 0 1 0 0 0 1</Array>')))
        .otherwise(F.col("clf"))
    )
    parsed = R.parsed_clf(texts.withColumn("clf", odd))
    return parsed.select("frame", "error", F.array_join(F.transform("values", lambda v: R.text_number(v, PLACES)), " ").alias("numbers"))


@query(S.with_(*FIT, _CUBE) + """SELECT CAST(frame AS INT) AS frame, 'LUT_3D_SIZE 9' || chr(10) || 'DOMAIN_MIN 0 0 0' || chr(10) || 'DOMAIN_MAX 1 1 1' || chr(10) ||
  string_agg(printf('%.6f %.6f %.6f', round(out_r, 6) + 0e0, round(out_g, 6) + 0e0, round(out_b, 6) + 0e0), chr(10) ORDER BY node) || chr(10) AS cube FROM nodes GROUP BY 1""")
def k09_cube_text(spark, sf_dir):
    return R.cube_text(interchange.cube_nodes(fitted(spark, sf_dir), 9), 9)


# --- library

_LIBRARY = """lib AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 41 = 0 THEN '.hidden' ELSE 'entry-' END || c_custkey AS entry_id, upper(substring(c_mktsegment, 1, 4)) || (c_custkey % 90) AS label, c_custkey % 37 = 0 AS bad_profile, c_custkey % 31 <> 0 AS has_entry,
  CASE WHEN c_custkey % 29 = 0 THEN '2.1' ELSE '1.3' END AS version, c_custkey % 23 = 0 AS other, c_nationkey, c_acctbal FROM customer),
found AS (SELECT *, CASE WHEN bad_profile THEN 'invalid profile: digest mismatch' WHEN NOT has_entry THEN 'cannot read entry.json' WHEN version = '2.1' THEN 'unsupported entry.json schema version 2.1' WHEN other THEN 'entry does not match its profile' END AS problem
  FROM lib WHERE NOT starts_with(entry_id, '.'))"""


def listing(spark, sf_dir):
    """Customers as folders of a library."""
    k, c = F.col("c_custkey"), F.col
    entries = adapters.table(spark, sf_dir, "customer").select(
        F.concat(F.when(k % 41 == 0, ".hidden").otherwise("entry-"), k.cast("string")).alias("entry_id"),
        F.concat(F.upper(F.substring("c_mktsegment", 1, 4)), (k % 90).cast("string")).alias("label"),
        F.when(k % 37 == 0, "digest mismatch").alias("profile_error"),
        (k % 31 != 0).alias("has_entry"),
        F.when(k % 29 == 0, "2.1").otherwise("1.3").alias("schema_version"),
        F.sha2(F.when(k % 23 == 0, "other").otherwise(k.cast("string")), 256).alias("entry_digest"),
        F.sha2(k.cast("string"), 256).alias("digest"),
        F.concat(F.lit("Make "), (c("c_nationkey") % 5).cast("string")).alias("make"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("M"), (k % 3).cast("string"))).alias("model"),
        F.lit("decoder").alias("decoder"),
        F.when(k % 2 == 0, "1").otherwise("").alias("decoder_version"),
        (k % 5 != 0).alias("passed"),
        (k % 10 == 0).alias("overridden"),
        (k % 3 == 0).alias("quick_and_dirty"),
        (F.abs("c_acctbal") / 1000).alias("mean_delta_e"),
        (F.abs("c_acctbal") / 500).alias("max_delta_e"),
    )
    return R.library_listing(entries)


@query(S.with_(_LIBRARY) + """SELECT entry_id, label, problem, CAST(row_number() OVER (PARTITION BY problem IS NULL ORDER BY CASE WHEN problem IS NULL THEN label END, entry_id) AS BIGINT) AS place FROM found""")
def s21_library_listing(spark, sf_dir):
    """Entries by label and id, problems by id (s21, s22, o04)."""
    found = listing(spark, sf_dir).select("entry_id", "label", "problem")
    parts = with_place(found.filter("problem is null"), ["label", "entry_id"]).unionByName(with_place(found.filter("problem is not null"), ["entry_id"]))
    return parts.select("entry_id", "label", "problem", "place")


@query(S.with_(_LIBRARY) + """SELECT entry_id, label AS title, trim('Make ' || (c_nationkey % 5) || ' ' || CASE WHEN k % 7 = 0 THEN '' ELSE 'M' || (k % 3) END) AS camera,
  CASE WHEN k % 10 = 0 THEN 'OVERRIDDEN' WHEN k % 5 <> 0 THEN 'PASSED' ELSE 'FAILED' END || CASE WHEN k % 3 = 0 THEN ', QUICK & DIRTY' ELSE '' END AS badges,
  'ΔE mean ' || printf('%.2f', round(abs(c_acctbal)/1000, 6)) || ' / max ' || printf('%.2f', round(abs(c_acctbal)/500, 6)) AS delta_e, trim('decoder ' || CASE WHEN k % 2 = 0 THEN '1' ELSE '' END) AS decoder,
  NOT (CAST(c_nationkey % 5 AS VARCHAR) = '3' AND k % 7 <> 0 AND k % 3 = 1) AS camera_mismatch FROM found WHERE problem IS NULL""")
def p18_library_cards(spark, sf_dir):
    """Cards, and whether each entry's camera differs from a loaded one (j13)."""
    good = listing(spark, sf_dir).filter("problem is null").withColumns({c: F.round(c, 6) for c in ("mean_delta_e", "max_delta_e")})
    known = batch.same_name(F.col("make"), F.lit("make 3")) & batch.same_name(F.col("model"), F.lit(" m1"))
    return good.select("entry_id", *(v.alias(k) for k, v in R.card().items()), (~known).alias("camera_mismatch"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'lib/entry-' || (o_orderkey % 50) || '/profile.json' END AS lib, CASE WHEN o_orderkey % 2 = 0 THEN 'out/' || o_custkey || '.json' END AS derived FROM orders)
SELECT o_orderkey AS session, coalesce(lib, derived) AS profile_path, CASE WHEN lib IS NOT NULL THEN 'library' WHEN derived IS NOT NULL THEN 'derived' END AS source, CASE WHEN coalesce(lib, derived) IS NOT NULL THEN lib IS NOT NULL END AS allow_mismatch FROM p""")
def j12_profile_choice(spark, sf_dir):
    """An active library entry goes before a profile derived in the session, and only it allows mismatches."""
    lib = F.when(key() % 3 == 0, F.concat(F.lit("lib/entry-"), (key() % 50).cast("string"), F.lit("/profile.json")))
    derived = F.when(key() % 2 == 0, F.concat(F.lit("out/"), F.col("o_custkey").cast("string"), F.lit(".json")))
    chosen = F.coalesce(lib, derived)
    return orders(spark, sf_dir).select(
        key().alias("session"),
        chosen.alias("profile_path"),
        F.when(lib.isNotNull(), "library").when(derived.isNotNull(), "derived").alias("source"),
        F.when(chosen.isNotNull(), lib.isNotNull()).alias("allow_mismatch"),
    )


@query("""WITH a AS (SELECT o_orderkey AS k, 'lib/entry-' || (o_custkey % 2000) AS folder FROM orders), e AS (SELECT 'lib/entry-' || c_custkey AS folder, c_name AS label FROM customer)
SELECT k AS session, label FROM a LEFT JOIN e ON a.folder = e.folder""")
def j07_active_entry(spark, sf_dir):
    """The library entry of a path written in one of three ways."""
    number = (F.col("o_custkey") % 2000).cast("string")
    path = F.when(key() % 3 == 0, F.concat(F.lit("./lib//entry-"), number)).when(key() % 3 == 1, F.concat(F.lit("lib/other/../entry-"), number, F.lit("/"))).otherwise(F.concat(F.lit("lib/./entry-"), number))
    asked = orders(spark, sf_dir).select(key().alias("session"), R.canonical_path(path).alias("folder"))
    entries = adapters.table(spark, sf_dir, "customer").select(F.concat(F.lit("lib/entry-"), F.col("c_custkey").cast("string")).alias("folder"), F.col("c_name").alias("label"))
    return asked.join(entries, "folder", "left").select("session", "label")


# --- batch runs and preflight

_RUN = """run AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'skipped' WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'written' END AS status, 'cannot decode ' || o_orderkey AS error FROM orders),
warned AS (SELECT o_orderkey AS file, w AS warning FROM orders, (VALUES ('clipped', 2), ('decoder version differs', 3)) t(w, m) WHERE o_orderkey % m = 0)"""


def run_of(spark, sf_dir):
    """Orders as files of a run that was stopped: those without a status were not begun."""
    status = F.when(key() % 5 == 0, "skipped").when(key() % 7 == 0, "failed").when(key() % 9 == 0, None).otherwise("written")
    files = orders(spark, sf_dir).select(key().alias("file"), status.alias("status"), F.concat(F.lit("cannot decode "), key().cast("string")).alias("error"))
    warned = [orders(spark, sf_dir).filter(key() % m == 0).select(key().alias("file"), F.lit(w).alias("warning")) for w, m in (("clipped", 2), ("decoder version differs", 3))]
    return files, warned[0].unionByName(warned[1])


@query(S.with_(_RUN) + """SELECT r.file, r.status, CASE WHEN r.status = 'failed' THEN error WHEN r.status = 'skipped' THEN concat_ws('|', 'Output exists; not overwritten.', w) ELSE coalesce(w, '') END AS detail
  FROM run r LEFT JOIN (SELECT file, string_agg(warning, '|' ORDER BY warning) AS w FROM warned GROUP BY 1) x ON x.file = r.file WHERE r.status IS NOT NULL""")
def j08_batch_results(spark, sf_dir):
    files, warned = run_of(spark, sf_dir)
    return R.batch_results(files.filter("status is not null"), warned).select("file", "status", F.array_join("detail", "|").alias("detail"))


@query(S.with_(_RUN) + "SELECT count(*) AS total, count(*) FILTER (status = 'written') AS succeeded, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS remaining FROM run")
def a12_batch_counts(spark, sf_dir):
    files, _ = run_of(spark, sf_dir)
    total = written(files.agg(F.count("*").alias("total")), "total")
    return R.batch_counts(files.filter("status is not null"), F.lit(total.first()[0]))


@query(S.with_(_RUN) + """SELECT '{"output-space":"srgb","format":"jpeg","jpeg-quality":90,"ocio-config":null,"succeeded":' || count(*) FILTER (status = 'written') || ',"skipped":' || count(*) FILTER (status = 'skipped') || ',"failed":' || count(*) FILTER (status = 'failed') || ',"total":' || count(*) || '}' AS json FROM run""")
def k13_batch_summary(spark, sf_dir):
    return R.batch_summary_json(a12_batch_counts(spark, sf_dir), {"output-space": "srgb", "format": "jpeg", "jpeg-quality": 90, "ocio-config": None})


@query(S.with_(CAP) + """, ordered AS (SELECT path, make, model, row_number() OVER (ORDER BY path) AS place, count(*) OVER () AS files FROM caps)
SELECT path, make, model, CAST(greatest(files - 200, 0) AS BIGINT) AS omitted FROM ordered WHERE place <= 200""")
def o03_first_files(spark, sf_dir):
    """The report's first 200 files and how many it leaves out."""
    caps = adapters.captures(spark, sf_dir)
    omitted = max(caps.count() - 200, 0)
    return caps.orderBy("path").limit(200).select("path", "make", "model", F.lit(omitted).cast("long").alias("omitted"))


@query(S.with_(CAP) + """, v AS (SELECT DISTINCT 'lens' AS kind, lens AS value FROM caps WHERE lens IS NOT NULL UNION SELECT DISTINCT 'iso', lpad(CAST(iso AS VARCHAR), 10, '0') FROM caps WHERE iso IS NOT NULL)
SELECT kind, count(*) AS distinct_values, array_to_string(list_slice(list_sort(list(value)), 1, 100), '|') AS first_values FROM v GROUP BY 1""")
def a10_distinct_values(spark, sf_dir):
    """Distinct lenses and speeds: how many, and the first 100 in order (a top-k report)."""
    caps = adapters.captures(spark, sf_dir)
    out = None
    for kind, value in (("lens", F.col("lens")), ("iso", F.lpad(F.col("iso").cast("string"), 10, "0"))):
        values = written(caps.select(value.alias("value")).dropna().distinct(), "values")
        first = values.orderBy("value").limit(100).agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("first_values"))
        part = first.select(F.lit(kind).alias("kind"), F.lit(values.count()).cast("long").alias("distinct_values"), "first_values")
        out = part if out is None else out.unionByName(part)
    return out


@query(S.with_(CAP) + "SELECT path, CASE WHEN source_kind IS NOT NULL AND (source_kind = 'raw' OR NOT " + f"(lower(trim(make)) = '{ACTIVE['camera_make'].strip().lower()}' AND lower(trim(model)) = '{ACTIVE['camera_model']}')" + ") AND source_kind = 'raw' THEN true WHEN source_kind = 'raw' THEN true END AS camera_mismatch FROM caps")
def g09_not_comparable(spark, sf_dir):
    """Against an entry measured from a rendered image: raw files never match, of rendered ones nothing is known."""
    return batch.mismatches(captures_of(spark, sf_dir), ACTIVE, False).select("path", "camera_mismatch")


# --- single functions

@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN concat_ws(',', '153.6', '102.4', '1766.4', '102.4', '1766.4', '1177.6', '153.6', '1177.6') ELSE concat_ws(',', CAST(o_custkey % 90 AS DOUBLE), '2.5', '900.0', '3.0', '880.0', '700.0', '1.0', '690.0') END AS quad,
  CASE WHEN o_orderkey % 5 = 0 THEN '12' ELSE '3' END AS major FROM orders""")
def d07_default_quad(spark, sf_dir):
    """Corners as given (d08), or the frame inset by 8 % (d07); and the major version of a schema (x05)."""
    text = F.when(key() % 3 == 0, "1,2,3").otherwise(F.concat((F.col("o_custkey") % 90).cast("string"), F.lit(", 2.5,900,3, 880,700,1,690")))
    quad = F.coalesce(T.parse_quad(text), T.default_quad(F.lit(1920), F.lit(1280)))
    shown = F.array_join(F.transform(quad, lambda v: F.round(v, 6).cast("string")), ",")
    version = F.when(key() % 5 == 0, "12.0.1").otherwise("3.4")
    return orders(spark, sf_dir).select(key().alias("id"), shown.alias("quad"), T.schema_major(version).alias("major"))


_FI = lambda f: f"CASE WHEN {f} > 6/29e0 THEN ({f})*({f})*({f}) ELSE 3*(6/29e0)*(6/29e0)*(({f}) - 4/29e0) END"


@query(S.with_(S.reference_values()) + f"SELECT CAST(patch_idx AS INT) AS patch_idx, n AS uses, round({0.9504559270516716}*({_FI('(t_l + 16)/116 + t_a/500')}), 6) AS x, round({_FI('(t_l + 16)/116')}, 6) AS y, round({1.0890577507598784}*({_FI('(t_l + 16)/116 - t_bb/200')}), 6) AS z FROM ref JOIN (SELECT l_partkey % 24 AS p, count(*) AS n FROM lineitem GROUP BY 1) u ON p = patch_idx")
def p07_lab_to_xyz(spark, sf_dir):
    """Lab back to XYZ for the chart's patches, with how many pixels are of each."""
    uses = adapters.table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 24).cast("int").alias("patch_idx")).agg(F.count("*").alias("uses"))
    xyz = lab_to_xyz_d65(col3("t_l", "t_a", "t_bb"))
    rows = chart_reference(spark).join(uses, "patch_idx").withColumns(dict(zip("xyz", xyz, strict=True)))
    return rounded(rows.select("patch_idx", "uses", "x", "y", "z"))


@query("""WITH px AS (SELECT DISTINCT (l_orderkey*7 + l_linenumber*13) % 1920 AS x, (l_partkey*11 + l_suppkey) % 1280 AS y FROM lineitem),
xs AS (SELECT i AS tx, CAST(floor((i + 0.5e0)*1920/512) AS BIGINT) AS x FROM range(512) t(i)), ys AS (SELECT i AS ty, CAST(floor((i + 0.5e0)*1280/341) AS BIGINT) AS y FROM range(341) t(i))
SELECT CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM px JOIN xs USING (x) JOIN ys USING (y)""")
def d01_thumbnail(spark, sf_dir):
    """The pixels of a 1920 x 1280 frame that its thumbnail of 512 at most takes: two semi-joins by place, before anything is decoded."""
    li = adapters.table(spark, sf_dir, "lineitem")
    px = li.select(((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 1920).cast("int").alias("x"), ((F.col("l_partkey") * 11 + F.col("l_suppkey")) % 1280).cast("int").alias("y")).distinct()
    return interchange.thumbnail_pixels(px, 1920, 1280).select("tx", "ty", "x", "y")


_OPT = lambda v: f"coalesce('\"' || {v} || '\"', 'null')"
_ENTRY = (
    """'{' || chr(10) || '  "schema-version": "1.0",' || chr(10) || '  "label": "Portrait ' || k || '",' || chr(10) || '  "notes": "note \\"' || c || '\\"",' || chr(10)
  || CASE WHEN c % 3 = 0 THEN '  "tags": [],' ELSE '  "tags": [' || chr(10) || '    "t' || c % 5 || '",' || chr(10) || '    "T' || c % 5 || '"' || chr(10) || '  ],' END || chr(10)
  || '  "profile-digest": "' || digest || '",' || chr(10) || '  "capture": {' || chr(10) || '    "make": "Cam",' || chr(10) || '    "model": ' || """
    + _OPT("CASE WHEN c % 7 <> 0 THEN 'M' || c % 7 END")
    + """ || ',' || chr(10) || '    "lens": null,' || chr(10) || '    "iso": ' || coalesce(CAST(CASE WHEN c % 6 <> 0 THEN c % 6*100 END AS VARCHAR), 'null') || ',' || chr(10) || '    "date-time": "2024-01-01 00:00:00",' || chr(10) || '    "gps": '
  || CASE WHEN c % 2 = 0 THEN '{' || chr(10) || '      "latitude": ' || c % 50 || '.25,' || chr(10) || '      "longitude": -' || c % 50 + 1 || '.5,' || chr(10) || '      "altitude": ' || CASE WHEN c % 4 = 0 THEN 'null' ELSE '12.0' END || chr(10) || '    }' ELSE 'null' END
  || chr(10) || '  }' || chr(10) || '}'"""
)


@query(
    _profile_sql().replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
have AS (SELECT 'portrait-' || n_nationkey || '-' || left(digest, 8) || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '-2' END AS name FROM nation, sealed WHERE n_nationkey % 3 <> 0),
asked AS (SELECT c_custkey AS c, c_custkey % 40 AS k, digest, sha256('reference ' || frame) AS reference, c_custkey % 17 = 0 AS blank, c_custkey % 13 = 0 AS foreign_one FROM customer JOIN sealed ON frame = c_custkey % 10),
want AS (SELECT *, 'portrait-' || k || '-' || left(digest, 8) AS stem, row_number() OVER (ORDER BY c) AS i FROM asked WHERE NOT blank AND NOT foreign_one),
serving AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list(name) FROM have) AS taken, CAST(NULL AS BIGINT) AS who, CAST(NULL AS VARCHAR) AS name
  UNION ALL
  SELECT i, list_append(taken, name), c, name FROM (
    SELECT w.i, s.taken, w.c, list_filter(list_prepend(w.stem, list_transform(range(2, len(list_filter(s.taken, lambda x: starts_with(x, w.stem))) + 3), lambda k: w.stem || '-' || k)), lambda x: NOT list_contains(s.taken, x))[1] AS name
    FROM serving s JOIN want w ON w.i = s.i + 1))
SELECT a.c AS customer, name, CASE WHEN NOT blank AND NOT foreign_one THEN {_ENTRY} END AS entry,
  CASE WHEN blank THEN 'the library entry needs a label' WHEN foreign_one THEN 'the reference does not belong to this profile: its digest is ' || sha256('other') || ', the profile was derived from ' || reference END AS error
FROM asked a LEFT JOIN (SELECT who, name FROM serving WHERE i > 0) s ON who = a.c"""
)
def k16_library_save(spark, sf_dir):
    """Customers as entries saved one after another, each with the profile of its frame, into a library that has some of the names."""
    c = F.col("customer")
    sealed = written(profiles(spark, sf_dir).select("frame", "digest", "json"), "sealed")
    asked = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), (F.col("c_custkey") % 10).cast("int").alias("frame"))
    asked = asked.join(F.broadcast(sealed.drop("digest")), "frame")
    tag = F.concat(F.lit("t"), (c % 5).cast("string"))
    facts = {
        "place": c,
        "label": F.when(c % 17 == 0, "  ").otherwise(F.format_string(" Portrait %d", c % 40)),
        "notes": F.format_string('note "%d"', c),
        "tags": F.when(c % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(tag, F.concat(F.lit(" "), tag), F.upper(tag))),
        "reference_digest": F.when(c % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.upper(F.sha2(F.concat(F.lit("reference "), F.col("frame").cast("string")), 256))),
        "make": F.lit("Cam"),
        "model": F.when(c % 7 != 0, F.concat(F.lit("M"), (c % 7).cast("string"))),
        "lens": F.lit(None).cast("string"),
        "iso": F.when(c % 6 != 0, (c % 6 * 100).cast("int")),
        "captured_at": F.lit("2024-01-01 00:00:00"),
        "latitude": c % 50 + F.lit(0.25),
        "longitude": -(c % 50 + F.lit(1.5)),
        "altitude": F.when(c % 4 != 0, 12.0),
        "include_gps": c % 2 == 0,
    }
    n = F.col("n_nationkey")
    ids = adapters.table(spark, sf_dir, "nation").filter(n % 3 != 0).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(9)))).join(F.broadcast(sealed.select("frame", F.left("digest", F.lit(8)).alias("id"))), "frame")
    have = ids.select(F.concat(F.format_string("portrait-%d-", n), "id", F.when(n % 2 == 0, "").otherwise("-2")).alias("name"))
    return R.library_saves(asked.withColumns(facts), have).select("customer", "name", "entry", "error")


_BYTE = lambda c: f"CAST(least(greatest(floor({c}*255 + 0.5), 0), 255) AS INT)"
_SWATCH = lambda p: "'<td style=\"background:rgb(' || " + " || ',' || ".join(_BYTE(f"{p}_{c}") for c in "rgb") + " || ')\"></td>'"
_POINTS = " || ' ' || ".join(f"printf('%.1f,%.1f', {QUAD[f'x{i}']}, {QUAD[f'y{i}']} + frame)" for i in range(4))
_SAFE = lambda v: f"replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    _profile_sql()
    + f""",
patch_rows AS (SELECT frame, string_agg('<tr><td>' || name || '</td>' || {_SWATCH('out')} || {_SWATCH('t')} || printf('<td>%.3f</td></tr>', delta_e), '' ORDER BY patch_idx) AS patch_rows FROM scored JOIN patch_names USING (patch_idx) GROUP BY 1),
bad AS (SELECT frame, string_agg('<li>' || {_SAFE('reason')} || ': ' || {_SAFE('measured')} || '</li>', '' ORDER BY ord) AS bad FROM failures GROUP BY 1)
SELECT CAST(s.frame AS INT) AS frame, '<!doctype html><meta charset="utf-8"><h1>Calibration</h1><p>profile ' || digest || '</p><p>camera Cam F' || s.frame || ' (decoder: decoder 1)</p>'
  || CASE WHEN bad IS NULL THEN '<p>Reference quality: pass</p>' ELSE CASE WHEN s.frame % 2 = 0 THEN '<p>Reference quality: overridden</p>' ELSE '<p>Reference quality: failed</p>' END || '<ul>' || bad || '</ul>' END
  || printf('<p>mean %.3f, median %.3f, 95th percentile %.3f, max %.3f, condition number %.2f</p>', mean_delta_e, median_delta_e, p95_delta_e, max_delta_e, condition_number)
  || '<svg viewBox="0 0 480 320"><polygon points="' || {_POINTS.replace('frame', 's.frame')} || '"/></svg><table><tr><th>patch</th><th>corrected</th><th>target</th><th>difference</th></tr>' || patch_rows || '</table>' AS html
FROM sealed s JOIN report r ON r.frame = s.frame JOIN patch_rows p ON p.frame = s.frame LEFT JOIN bad b ON b.frame = s.frame"""
)
def k11_chart_page(spark, sf_dir):
    """Every frame's profile as a page with all patches in chart order."""
    s, ref = samples(spark, sf_dir), chart_reference(spark)
    facts = written(profiles(spark, sf_dir), "facts").withColumns({k: F.lit(v) if k[0] == "x" else v + F.col("frame") for k, v in QUAD.items()})
    facts = facts.withColumns({"width": F.lit(480), "height": F.lit(320), "forced": F.col("frame") % 2 == 0})
    names = F.array(*(F.lit(A.patch_name(p)) for p in PATCHES))
    scored = calibration.validate(s, ref, calibration.fit(s, ref)).withColumn("patch", F.get(names, F.col("patch_idx")))
    return reports.chart_pages(scored, calibration.gate_failures(s), facts)
