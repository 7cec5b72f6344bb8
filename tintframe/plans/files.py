"""Queries over files, captures, the library, texts, mosaics and interchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capture
from ..functions import text as T
from ..functions.colour import BRADFORD_D65_TO_D50, D50_XYZ, RGB_TO_XYZ
from ..operators import apply, batch, contract, interchange, stencil
from ..operators import calibration as C
from ..operators.ordering import with_place
from ..sources import adapters
from ..sources.chart import chart_reference
from ..sources.shared import written
from . import sql as S
from .calibration import _CODE, FIT, rounded, samples

QUERIES: dict = {}
SQL: dict = {}


def query(text: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return put


CAP = """caps AS (SELECT printf('shoot/%d/img-%d.dng', user_id, event_id) AS path,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'rendered' ELSE 'raw' END AS source_kind,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS make,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'R' || (user_id % 5) END AS model,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'lens ' || (user_id % 11) END AS lens,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT)*10 + 100 END AS iso,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS captured_at FROM events)"""
LIB = """lib AS (SELECT c_custkey AS entry_id, c_name AS label, (['signup', ' Error', 'CLICK ', 'view', 'Purchase'])[c_custkey % 5 + 1] AS camera_make,
  'r' || (c_custkey % 7) AS camera_model FROM customer)"""
ACTIVE = {"camera_make": " CLICK", "camera_model": "r3", "lens": "lens 3", "iso": 300, "captured_at": "2024-01-05 00:00:00"}
_SAME = lambda c, v: f"(lower(trim({c})) = '{v.strip().lower()}' AND trim({c}) <> '')"
_MAKE, _MODEL = _SAME("make", ACTIVE["camera_make"]), _SAME("model", ACTIVE["camera_model"])
CHECKED = f"""checked AS (SELECT *, CASE WHEN source_kind IS NULL THEN NULL WHEN source_kind = 'rendered' THEN true
    WHEN make IS NOT NULL AND model IS NOT NULL THEN NOT ({_MAKE} AND {_MODEL})
    WHEN make IS NOT NULL AND model IS NULL AND NOT {_MAKE} THEN true WHEN make IS NULL AND model IS NOT NULL AND NOT {_MODEL} THEN true END AS camera_mismatch,
  lens <> '{ACTIVE["lens"]}' AS lens_mismatch, iso <> {ACTIVE["iso"]} AS iso_mismatch, captured_at <> '{ACTIVE["captured_at"]}' AS time_different FROM caps)"""


def captures_of(spark, sf_dir):
    return adapters.captures(spark, sf_dir)


def checked(spark, sf_dir):
    return batch.mismatches(adapters.captures(spark, sf_dir), ACTIVE, True)


@query(S.with_(CAP, CHECKED) + "SELECT path, camera_mismatch, lens_mismatch, iso_mismatch, time_different FROM checked")
def g09_preflight_mismatches(spark, sf_dir):
    return checked(spark, sf_dir).select("path", "camera_mismatch", "lens_mismatch", "iso_mismatch", "time_different")


@query(S.with_(CAP, CHECKED) + "SELECT count(*) AS files, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in ("make", "model", "lens", "iso", "captured_at"))
       + ", " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in ("camera_mismatch", "lens_mismatch", "iso_mismatch", "time_different"))
       + ", count(DISTINCT lens) AS lenses, count(DISTINCT iso) AS isos, min(iso) AS iso_min, max(iso) AS iso_max, min(captured_at) AS time_min, max(captured_at) AS time_max FROM checked")
def a09_preflight_summary(spark, sf_dir):
    return batch.preflight_summary(checked(spark, sf_dir))


@query(S.with_(CAP) + "SELECT make, model, count(*) AS n FROM caps WHERE make IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2")
def a11_camera_counts(spark, sf_dir):
    return adapters.captures(spark, sf_dir).filter("make is not null and model is not null").groupBy("make", "model").agg(F.count("*").alias("n"))


@query(S.with_(CAP, LIB) + """SELECT entry_id, label, n AS matching_files FROM lib JOIN (SELECT lower(trim(make)) AS a, lower(trim(model)) AS b, count(*) AS n FROM caps
  WHERE make IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2) c ON lower(trim(camera_make)) = a AND lower(trim(camera_model)) = b AND a <> '' AND b <> '' ORDER BY 3 DESC, 2, 1 LIMIT 50""")
def o02_suggestions_topk(spark, sf_dir):
    return batch.suggestions(adapters.captures(spark, sf_dir), adapters.library(spark, sf_dir))


INPUTS = """files AS (SELECT printf('in/%d/%d/img-%s.%s', doc_id % 7, doc_id % 3, lang || (doc_id % 50) || CASE WHEN doc_id % 11 = 0 THEN '-1' WHEN doc_id % 13 = 0 THEN '-1-2' ELSE '' END, (['dng', 'JPG', 'txt', 'nef', 'md'])[doc_id % 5 + 1]) AS path FROM documents)"""


def inputs(spark, sf_dir):
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("dng", "JPG", "txt", "nef", "md")))
    end = F.when(i % 11 == 0, "-1").when(i % 13 == 0, "-1-2").otherwise("")  # stems that meet made names
    name = F.concat("lang", (i % 50).cast("string"), end)
    path = F.format_string("in/%d/%d/img-%s.%s", i % 7, i % 3, name, F.element_at(kinds, (i % 5 + 1).cast("int")))
    return adapters.table(spark, sf_dir, "documents").select(path.alias("path"))


_STEMMED = "stems AS (SELECT DISTINCT path, regexp_replace(split(path, '/')[-1], '(.)[.][^.]*$', '\\1') AS stem FROM files WHERE lower(regexp_extract(path, '[.]([^./]+)$', 1)) IN ('dng', 'jpg', 'jpeg', 'png', 'nef', 'raw', 'cr3'))"
# one file after another, as the rule has it: the names taken so far go along
_FREE = "list_filter(list_prepend(n.stem, list_transform(range(1, len(list_filter(t.taken, lambda x: starts_with(x, n.stem))) + 2), lambda k: n.stem || '-' || k)), lambda x: NOT list_contains(t.taken, x))[1]"
_NAMED = f"""nth AS (SELECT path, stem, row_number() OVER (ORDER BY split(path, '/')) AS i FROM stems),
taking AS (/* each row the names so far */ SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS name
  UNION ALL SELECT n.i, list_append(t.taken, {_FREE}), n.path, {_FREE} FROM taking t JOIN nth n ON n.i = t.i + 1),
named AS (SELECT path, name || '.tiff' AS output FROM taking WHERE i > 0)"""


@query(S.with_(INPUTS, _STEMMED, _NAMED).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT path, output FROM named")
def o07_output_names(spark, sf_dir):
    return batch.output_names(batch.collect_inputs(inputs(spark, sf_dir)), "tiff").select("path", "output")


@query(S.with_(INPUTS, _STEMMED) + "SELECT path, CAST(row_number() OVER (ORDER BY split(path, '/')) AS INT) AS place FROM stems")
def s01_collect_inputs(spark, sf_dir):
    """The accepted files in component order."""
    return with_place(batch.collect_inputs(inputs(spark, sf_dir)), ["parts"]).select("path", F.col("place").cast("int").alias("place"))


@query(S.with_(INPUTS, _STEMMED, _NAMED).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT path, output FROM named WHERE output NOT IN (SELECT DISTINCT 'img-en' || (o_orderkey % 50) || '.tiff' FROM orders WHERE o_orderkey % 3 = 0)")
def k15_skip_existing(spark, sf_dir):
    there = adapters.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    there = there.select(F.concat(F.lit("img-en"), (F.col("o_orderkey") % 50).cast("string"), F.lit(".tiff")).alias("output")).distinct()
    return batch.skip_existing(batch.output_names(batch.collect_inputs(inputs(spark, sf_dir)), "tiff"), there).select("path", "output")


@query("SELECT doc_id, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest, left(sha256(replace(text, chr(13) || chr(10), chr(10))), 12) AS short_id FROM documents")
def x01_sha256(spark, sf_dir):
    digest = T.file_sha256(F.col("text"))
    return adapters.table(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"), F.left(digest, F.lit(12)).alias("short_id"))


_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@query(f"""SELECT page_id, coalesce(nullif(rtrim(left(trim(translate(regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'), 40), '-'), ''), 'entry') AS slug,
  sha256({_ESCAPED}) AS escaped_sha256, length({_ESCAPED}) AS escaped_chars,
  CASE WHEN page_id % 4 = 0 OR page_id % 4 = 1 THEN 'rendered' ELSE 'raw' END AS kind FROM pages""")
def x03_slug_escape_sniff(spark, sf_dir):
    """The whole escaped page by its digest and length. Every fourth page is taken as the content of a JPEG file, another fourth as that of a PNG
    file: their magic bytes go before it."""
    pages = adapters.table(spark, sf_dir, "pages")
    escaped = T.escape_html(F.col("html"))
    magic = F.when(F.col("page_id") % 4 == 0, F.unhex(F.lit("FFD8FFE0"))).when(F.col("page_id") % 4 == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.lit(b""))
    content = F.concat(magic, F.col("html").cast("binary"))
    return pages.select(
        "page_id", T.slug(F.col("url")).alias("slug"), F.sha2(escaped, 256).alias("escaped_sha256"), F.length(escaped).cast("long").alias("escaped_chars"), T.sniff(content).alias("kind")
    )


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_zip(t, generate_series(1, len(t))), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]), '|') AS tags
  FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda s: trim(s)), lambda s: s <> '') AS t FROM conversations)""")
def a16_clean_tags(spark, sf_dir):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.clean_tags(words), "|").alias("tags"))


SITES = """sites AS (SELECT l_suppkey % 10 AS frame, l_orderkey % 64 AS y, (l_partkey + 31*l_linenumber) % 64 AS x, CAST(max(l_quantity*300) AS INT) AS raw FROM lineitem GROUP BY 1, 2, 3),
bits AS (SELECT *, CASE WHEN raw >= 14700 THEN CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN 1 WHEN y % 2 = 1 AND x % 2 = 1 THEN 4 ELSE 2 END ELSE 0 END AS b FROM sites),
down AS (SELECT *, bit_or(b) OVER (PARTITION BY frame, x ORDER BY y RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS d FROM bits)"""


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[\s.]+'), lambda t: trim(t)), lambda t: t <> '') AS words FROM conversations),
k AS (SELECT conv_id, turn, words, list_transform(words, lambda t: lower(t)) AS keys FROM w)
SELECT conv_id, turn, array_to_string([words[i] for i in range(1, len(words) + 1) if list_position(keys, keys[i]) = i], '|') AS tags FROM k""")
def a16_tags_without_case(spark, sf_dir):
    """The words of turns as tags, of which case alone makes no other."""
    words = F.split("text", r"[\s.]+")
    return adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.tags_without_case(words), "|").alias("tags"))


@query(S.with_(SITES) + "SELECT CAST(frame AS INT) AS frame, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(bit_or(d) OVER (PARTITION BY frame, y ORDER BY x RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS INT) AS spread FROM down")
def a14_clip_spread(spark, sf_dir):
    return stencil.clip_spread(adapters.mosaic(spark, sf_dir)).select("frame", "y", "x", "spread")


_LEVEL = lambda v: f"(CASE (y % 2)*2 + x % 2 WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} WHEN 2 THEN {v[2]} ELSE {v[3]} END)"
BLACK, WHITE = [512, 520, 516, 524], [15000, 15000, 15000, 15000]


@query(S.with_(SITES) + f"SELECT CAST(frame AS INT) AS frame, CAST(63 - y AS INT) AS up_x, CAST(x AS INT) AS up_y, round(CAST(greatest((raw - {_LEVEL(BLACK)})/({_LEVEL(WHITE)} - {_LEVEL(BLACK)}), 0) AS DOUBLE), 5) AS value FROM sites")
def p13_raw_normalize_orient(spark, sf_dir):
    sites = stencil.oriented(stencil.normalised(adapters.mosaic(spark, sf_dir), BLACK, WHITE), 6, 64, 64)
    return sites.select("frame", "up_x", "up_y", F.round(F.col("value").cast("double"), 5).alias("value"))


def stages(spark, sf_dir):
    return C.fit(samples(spark, sf_dir), chart_reference(spark))


_DIRECT = lambda r, g, b: [f"least(greatest({r}/(exposure*c_r)*m0{j} + {g}/(exposure*c_g)*m1{j} + {b}/(exposure*c_b)*m2{j}, 0), 1)" for j in range(3)]
_CUBE = "nodes AS (SELECT frame, i AS node, i % 9 AS r_i, i // 9 % 9 AS g_i, i // 81 AS b_i, " + ", ".join(f"{v} AS out_{c}" for v, c in zip(_DIRECT("(i % 9)/8.0e0", "(i // 9 % 9)/8.0e0", "(i // 81)/8.0e0"), "rgb", strict=True)) + " FROM stages, range(729) t(i))"


@query(S.with_(*FIT, _CUBE) + "SELECT CAST(frame AS INT) AS frame, CAST(node AS INT) AS node, CAST(r_i AS INT) AS r_i, CAST(g_i AS INT) AS g_i, CAST(b_i AS INT) AS b_i, round(out_r, 6) + 0e0 AS out_r, round(out_g, 6) + 0e0 AS out_g, round(out_b, 6) + 0e0 AS out_b FROM nodes")
def k09_cube_lut(spark, sf_dir):
    return rounded(interchange.cube_nodes(stages(spark, sf_dir), 9))


_PROBES = "probes AS (SELECT l_suppkey % 10 AS frame, l_orderkey*10 + l_linenumber AS probe, max(l_discount*10) AS r, max(l_tax*12.5) AS g, max((l_quantity - 1)/49.0e0) AS b FROM lineitem GROUP BY 1, 2)"
_CORNERS = ", ".join(f"least(floor({c}*8), 7) AS {c}_0, {c}*8 - least(floor({c}*8), 7) AS {c}_t" for c in "rgb")
_W = "(CASE WHEN k & 1 <> 0 THEN r_t ELSE 1 - r_t END)*(CASE WHEN k & 2 <> 0 THEN g_t ELSE 1 - g_t END)*(CASE WHEN k & 4 <> 0 THEN b_t ELSE 1 - b_t END)"
_TRI = (
    f"cells AS (SELECT *, {_CORNERS} FROM probes)",
    f"eight AS (SELECT frame, probe, r, g, b, r_0 + (k & 1) AS r_i, g_0 + ((k >> 1) & 1) AS g_i, b_0 + ((k >> 2) & 1) AS b_i, {_W} AS w FROM cells, range(8) t(k))",
    "looked AS (SELECT frame, probe, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b, sum(w*out_r) AS lut_r, sum(w*out_g) AS lut_g, sum(w*out_b) AS lut_b FROM eight JOIN nodes USING (frame, r_i, g_i, b_i) GROUP BY 1, 2)",
)


def probes(spark, sf_dir):
    li = adapters.table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 10).cast("int").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("probe")).agg(
        F.max(F.col("l_discount") * 10).alias("r"), F.max(F.col("l_tax") * 12.5).alias("g"), F.max((F.col("l_quantity") - 1) / 49.0).alias("b")
    )


@query(S.with_(*FIT, _CUBE, _PROBES, *_TRI) + "SELECT CAST(frame AS INT) AS frame, probe, round(lut_r, 6) + 0e0 AS lut_r, round(lut_g, 6) + 0e0 AS lut_g, round(lut_b, 6) + 0e0 AS lut_b FROM looked")
def i01_trilinear(spark, sf_dir):
    out = interchange.trilinear(probes(spark, sf_dir), interchange.lut_arrays(stages(spark, sf_dir), 9), 9)
    return rounded(out).select("frame", "probe", "lut_r", "lut_g", "lut_b")


@query(S.with_(*FIT, _CUBE, _PROBES, *_TRI) + "SELECT CAST(frame AS INT) AS frame, round(max(greatest(" + ", ".join(f"abs(lut_{c} - {v})" for c, v in zip("rgb", _DIRECT("r", "g", "b"), strict=True)) + ")), 6) AS max_error FROM looked JOIN stages USING (frame) GROUP BY 1")
def a13_cube_error(spark, sf_dir):
    return rounded(interchange.cube_error(probes(spark, sf_dir), stages(spark, sf_dir), 9))


# one draw after another, as the generator has it; products need 128 bits
_LCG = f"""draws AS (SELECT 0 AS k, {interchange.PROBE_SEED}::UHUGEINT AS state UNION ALL
  SELECT k + 1, (state*{interchange.MULTIPLIER}::UHUGEINT + {interchange.INCREMENT}::UHUGEINT) % 18446744073709551616::UHUGEINT FROM draws WHERE k < 3*(SELECT max(c_custkey) + 1 FROM customer)),
drawn AS (SELECT (k - 1) // 3 AS i, {", ".join(f"max(CASE WHEN (k - 1) % 3 = {j} THEN state::DOUBLE/18446744073709551615::DOUBLE END) AS {c}" for j, c in enumerate("rgb"))} FROM draws WHERE k > 0 GROUP BY 1)"""


def customer_probes(spark, sf_dir):
    """A probe for each customer, the key being its place in the generator's sequence."""
    keys = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("probe"))
    return interchange.lcg_probes(keys, "probe")


@query("WITH RECURSIVE " + _LCG + " SELECT c_custkey AS probe, round(r, 12) AS r, round(g, 12) AS g, round(b, 12) AS b FROM customer JOIN drawn ON i = c_custkey")
def x07_lcg_probes(spark, sf_dir):
    return rounded(customer_probes(spark, sf_dir), 12)


_CUBE33 = _CUBE.replace("i % 9 AS r_i, i // 9 % 9 AS g_i, i // 81 AS b_i", "i % 33 AS r_i, i // 33 % 33 AS g_i, i // 1089 AS b_i").replace("(i % 9)/8.0e0", "(i % 33)/32.0e0").replace("(i // 9 % 9)/8.0e0", "(i // 33 % 33)/32.0e0").replace("(i // 81)/8.0e0", "(i // 1089)/32.0e0").replace("range(729)", "range(35937)")
_CELLS33 = _TRI[0].replace("*8)", "*32)").replace(", 7)", ", 31)").replace("*8 -", "*32 -")


@query(
    S.with_(*FIT, _CUBE33, _LCG, "probes AS (SELECT frame, i AS probe, r, g, b FROM stages, drawn WHERE i < (SELECT count(*) FROM customer))", _CELLS33, *_TRI[1:]).replace("WITH ", "WITH RECURSIVE ", 1).replace("draws AS MATERIALIZED (", "draws AS (")
    + "SELECT CAST(frame AS INT) AS frame, round(max(greatest(" + ", ".join(f"abs(lut_{c} - {v})" for c, v in zip("rgb", _DIRECT("r", "g", "b"), strict=True)) + ")), 6) AS max_error FROM looked JOIN stages USING (frame) GROUP BY 1"
)
def a13_probed_cube_error(spark, sf_dir):
    """Every frame's stages as a cube of 33 nodes a side, at the generator's probes, one for each customer."""
    fitted = written(stages(spark, sf_dir), "stages")
    last = adapters.table(spark, sf_dir, "customer").count() - 1
    probes = fitted.select("frame", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("probe"))
    return rounded(interchange.cube_error(interchange.lcg_probes(probes, "probe"), fitted, 33))


def _dcp_sql() -> str:
    import numpy as np

    m = (np.array(BRADFORD_D65_TO_D50) @ np.array(RGB_TO_XYZ)).tolist()
    t = ", ".join("(" + " + ".join(f"({m[i][k]!r})*m{j}{k}" for k in range(3)) + f")/(exposure*c_{c}) AS t{i}{j}" for i in range(3) for j, c in enumerate("rgb"))
    w = ", ".join(" + ".join(f"q{i}{k}*{D50_XYZ[k]!r}" for k in range(3)) + f" AS w{i}" for i in range(3))
    f = ", ".join(f"t{i}{j}*w{j} AS f{i}{j}" for i in range(3) for j in range(3))
    k = ", ".join(f"round(w{i}/greatest(w0, w1, w2)*p{i}{j}, 6) AS k{i}{j}" for i in range(3) for j in range(3))
    return (
        S.with_(*FIT, f"d1 AS (SELECT *, {t} FROM stages)", f"d2 AS (SELECT *, {S.inverse_sql(lambda i, j: f't{i}{j}', 'q')} FROM d1)", f"d3 AS (SELECT *, {w} FROM d2)", f"d4 AS (SELECT *, {f} FROM d3)", f"d5 AS (SELECT *, {S.inverse_sql(lambda i, j: f'f{i}{j}', 'p')} FROM d4)")
        + f"SELECT CAST(frame AS INT) AS frame, {', '.join(f'round(f{i}{j}, 6) AS f{i}{j}' for i in range(3) for j in range(3))}, {k}, round(-log2(greatest(w0, w1, w2)), 6) AS exposure_offset FROM d5"
    )


@query(_dcp_sql())
def f06_dcp_matrices(spark, sf_dir):
    return rounded(interchange.dcp_matrices(stages(spark, sf_dir)))


RAW_CAP = """raw AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '   ' ELSE '  ' || event_type || ' ' END AS make,
  event_id % 4 * 100 AS speed, CASE WHEN event_id % 5 = 0 THEN 65535 ELSE event_id % 3 * 200 END AS sensitivity,
  CASE WHEN event_id % 8 = 0 THEN '2024:13:01 00:00:00' WHEN event_id % 9 = 0 THEN 'none' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS stamp,
  event_id % 120 AS d, event_id % 60 AS m, event_id % 7 * 8 AS s, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 's' ELSE 'N' END AS side FROM events)"""


@query(S.with_(RAW_CAP) + """SELECT event_id, nullif(trim(make), '') AS make, CAST(CASE WHEN speed > 0 THEN speed WHEN sensitivity > 0 AND sensitivity < 65535 THEN sensitivity ELSE -1 END AS INT) AS iso,
  CASE WHEN stamp <> 'none' AND CAST(substring(stamp, 6, 2) AS INT) BETWEEN 1 AND 12 THEN replace(left(stamp, 10), ':', '-') || substring(stamp, 11) END AS captured_at,
  round(CASE WHEN side IS NULL OR d + m/60.0e0 + s/3600.0e0 > 90 THEN NULL WHEN side = 's' THEN -(d + m/60.0e0 + s/3600.0e0) ELSE d + m/60.0e0 + s/3600.0e0 END, 6) AS latitude FROM raw""")
def s17_capture_parse(spark, sf_dir):
    i = F.col("event_id")
    raw = adapters.table(spark, sf_dir, "events").select(
        i,
        F.when(i % 6 == 0, "   ").otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).alias("make"),
        (i % 4 * 100).cast("int").alias("speed"),
        F.when(i % 5 == 0, 65535).otherwise(i % 3 * 200).cast("int").alias("sensitivity"),
        F.when(i % 8 == 0, "2024:13:01 00:00:00").when(i % 9 == 0, "none").otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss")).alias("stamp"),
        (i % 120).alias("d"),
        (i % 60).alias("m"),
        (i % 7 * 8).alias("s"),
        F.when(i % 10 == 0, None).when(i % 2 == 0, "s").otherwise("N").alias("side"),
    )
    latitude = capture.degrees(F.col("d"), F.col("m"), F.col("s"), F.col("side"), "S", 90.0)
    return rounded(
        raw.select(
            "event_id",
            capture.known_text(F.col("make")).alias("make"),
            F.coalesce(capture.iso(F.col("speed"), F.col("sensitivity")), F.lit(-1)).alias("iso"),
            capture.capture_time(F.col("stamp")).alias("captured_at"),
            latitude.alias("latitude"),
        )
    )


@query("""SELECT o_orderkey AS pair, CASE WHEN o_orderkey % 11 = 0 THEN 'decoder' WHEN o_orderstatus = 'F' THEN 'settings' WHEN o_orderkey % 3 = 0 THEN 'version' ELSE 'same' END AS status,
  o_orderkey % 11 = 0 OR o_orderstatus = 'F' AS blocks FROM orders""")
def g07_contract_compare(spark, sf_dir):
    """Orders as pairs of contracts: each eleventh has another decoder, those of status F another demosaic, each third another version."""
    k = F.col("o_orderkey")
    pairs = adapters.table(spark, sf_dir, "orders").select(k.alias("pair"), "o_orderstatus")
    settings = {f"{side}_{s}": F.lit("as shot") for side in ("profile", "image") for s in contract.SETTINGS}
    settings |= {"image_demosaic": F.when(F.col("o_orderstatus") == "F", "other").otherwise("as shot")}
    settings |= {"profile_decoder": F.lit("d"), "image_decoder": F.when(F.col("pair") % 11 == 0, "e").otherwise("d")}
    settings |= {"profile_version": F.lit("1"), "image_version": F.when(F.col("pair") % 3 == 0, "2").otherwise("1")}
    return contract.compare_for_apply(pairs.withColumns(settings)).select("pair", "status", "blocks")


#: The profile of the batch: its camera, decoder and settings.
BATCH_PROFILE = {"make": "Acme", "model": "One", "decoder": "d", "version": "1"} | dict.fromkeys(contract.SETTINGS, "as shot")


def batch_files(spark, sf_dir):
    """Orders as files: some of another kind, some that can't be decoded, of another camera, with another contract or another version of it."""
    o, k = adapters.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.format_string("shoot/%d/img%d.%s", F.col("o_custkey"), k, F.when(k % 23 == 0, "txt").otherwise("dng"))
    o, k = o.select(k.alias("key"), path.alias("path")), F.col("key")
    facts = {"decode_error": F.when(k % 13 == 0, "truncated"), "make": F.when(k % 11 == 0, "Other").otherwise("Acme"), "model": F.lit("One"), "decoder": F.lit("d")}
    facts |= {"version": F.when(k % 3 == 0, "2").otherwise("1")} | {s: F.lit("as shot") for s in contract.SETTINGS} | {"demosaic": F.when(k % 17 == 0, "other").otherwise("as shot")}
    return o.withColumns({n: c if not isinstance(c, str) else F.lit(c) for n, c in facts.items()})


_BATCH = """files AS (SELECT o_orderkey AS k, printf('shoot/%d/img%d.dng', o_custkey, o_orderkey) AS path, printf('img%d.tiff', o_orderkey) AS output FROM orders WHERE o_orderkey % 23 <> 0),
first_stages AS (SELECT * EXCLUDE (frame) FROM stages WHERE frame = 0),
done AS (SELECT l_orderkey AS k, l_linenumber, {out} FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 29 = 0 AND l_linenumber = 1 THEN 'nan'::DOUBLE ELSE l_discount*8 END AS mean_r, l_tax*10 AS mean_g, l_quantity/50e0 AS mean_b FROM lineitem) l, first_stages),
coded AS (SELECT k, count(*) AS pixels, bool_or(isnan(out_r)) AS bad, count(*) FILTER (out_r < 0 OR out_r > 1 OR out_g < 0 OR out_g > 1 OR out_b < 0 OR out_b > 1) AS clipped, {codes} FROM done GROUP BY k),
judged AS (SELECT f.*, c.* EXCLUDE (k), f.k % 7 = 0 AS there, CASE WHEN f.k % 13 = 0 THEN 'decode failed: truncated' WHEN f.k % 11 = 0 THEN 'camera mismatch (profile: Acme One, image: Other One)' WHEN f.k % 17 = 0 THEN 'decode contract differs: settings'
  WHEN pixels IS NULL THEN 'export failed: no pixels' WHEN bad THEN 'export failed: a pixel is not a number' END AS why FROM files f LEFT JOIN coded c USING (k))"""
_BATCH = _BATCH.replace("{out}", S.CORRECTED).replace("{codes}", ", ".join(f"CAST(sum({_CODE(c)}) AS BIGINT) AS code_{c}" for c in "rgb"))


@query(
    S.with_(*FIT, _BATCH)
    + """SELECT path, output, CASE WHEN there THEN 'skipped' WHEN why IS NULL THEN 'written' ELSE 'failed' END AS status, CASE WHEN NOT there THEN why END AS error,
  CASE WHEN NOT there AND why IS NULL AND k % 3 = 0 THEN 'decode contract differs: version' END AS warning, """
    + ", ".join(f"CASE WHEN NOT there AND why IS NULL THEN {c} END AS {c}" for c in ("pixels", "clipped", "code_r", "code_g", "code_b"))
    + " FROM judged"
)
def i05_batch_apply(spark, sf_dir):
    """Orders as files with their line items as pixels, through frame 0's stages; a seventh of the outputs is there already."""
    fitted = C.fit(samples(spark, sf_dir).filter("frame = 0"), chart_reference(spark)).first()
    files, k = batch_files(spark, sf_dir), F.col("l_orderkey")
    red = F.when((k % 29 == 0) & (F.col("l_linenumber") == 1), float("nan")).otherwise(F.col("l_discount") * 8)
    px = adapters.table(spark, sf_dir, "lineitem").select(k.alias("key"), red.alias("r"), (F.col("l_tax") * 10).alias("g"), (F.col("l_quantity") / 50.0).alias("b"))
    px = px.join(files.select("key", "path"), "key").drop("key")
    there = files.filter("key % 7 = 0").select(F.format_string("img%d.tiff", "key").alias("output"))
    codes, results = apply.apply_batch(files.drop("key"), px, {c: fitted[c] for c in C.STAGES}, BATCH_PROFILE, there, places=9)
    sums = codes.groupBy("output").agg(*(F.sum(c).alias(c) for c in apply.CODES))
    return results.join(sums, "output", "left").select("path", "output", "status", "error", "warning", "pixels", "clipped", *apply.CODES)
