"""Queries over colour models, reports, fit and chart errors, output spaces, names and texts of numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capture
from ..functions import text as T
from ..operators import acceptance as A
from ..operators import batch, calibration, models, reports, transform
from ..sources import adapters
from ..sources.chart import FROM, PATCHES, chart_reference, chart_xyy
from ..sources.shared import written
from . import sql as S
from .calibration import BASE, GATES, QUAD, VALID, gates_sql, rounded, samples, validated

# texts that may be copied, those whose exclusion is reported, and one of neither kind
META_TAGS = [("primary", 271), ("primary", 272), ("primary", 274), ("primary", 33432), ("exif", 37500), ("gps", 1), ("gps", 99), ("primary", 5), ("primary", 315)]
QUERIES: dict = {}
SQL: dict = {}


def query(text: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = text
        return f

    return put


def lineitem(spark, sf_dir):
    return adapters.table(spark, sf_dir, "lineitem").withColumn("item", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


# --- models and fits


def _model_sql() -> str:
    """Terms made orthonormal column by column within each frame; leverages and fits are sums over them."""
    root = lambda v, k: f"sign({v})*pow(abs({v}), 1/{k}.0e0)"
    r, g, b = "mean_r", "mean_g", "mean_b"
    two = [root(f"{x}*{y}", 2) for x, y in ((r, g), (g, b), (r, b))]
    three = [root(f"{x}*{y}*{z}", 3) for x, y, z in ((r, g, g), (g, b, b), (r, b, b), (g, r, r), (b, g, g), (b, r, r), (r, g, b))]
    linear = [r, g, b]
    ctes = ["joined AS (SELECT s.*, ref.* EXCLUDE (patch_idx) FROM samples s JOIN ref USING (patch_idx))"]
    over = "OVER (PARTITION BY frame)"
    for n, (model, parts) in enumerate({"linear": linear, "polynomial": [*linear, f"{r}*{g}*{b}", "1e0"], "root_polynomial_2": linear + two, "root_polynomial_3": linear + two + three}.items()):
        k, keep = len(parts), "frame, patch_idx, t_r, t_g, t_b, t_l, t_a, t_bb"
        ctes.append(f"m{n}_0 AS (SELECT {keep}, {', '.join(f'{x} AS a{i}' for i, x in enumerate(parts))} FROM joined)")
        for j in range(k):
            done = "".join(f", a{i}" for i in range(j))
            rest = "".join(f", a{i}" for i in range(j + 1, k))
            ctes.append(f"u{n}_{j} AS (SELECT {keep}{done}, a{j}/sqrt(sum(a{j}*a{j}) {over}) AS a{j}{rest} FROM m{n}_{j})")
            ctes.append(f"m{n}_{j + 1} AS (SELECT {keep}{done}, a{j}" + "".join(f", a{i} - a{j}*sum(a{j}*a{i}) {over} AS a{i}" for i in range(j + 1, k)) + f" FROM u{n}_{j})")
        fitted = lambda c: " + ".join(f"a{i}*sum(a{i}*t_{c}) {over}" for i in range(k))  # noqa: B023, E731
        lever = " + ".join(f"a{i}*a{i}" for i in range(k))
        ctes.append(f"p{n} AS (SELECT {keep}, '{model}' AS model, " + ", ".join(f"t_{c} - (t_{c} - ({fitted(c)}))/(1 - ({lever})) AS out_{c}" for c in "rgb") + f" FROM m{n}_{k})")
    lab = S.lab_of([f"xyz_{c}" for c in "xyz"])
    ctes += [
        "v1 AS (" + " UNION ALL ".join(f"SELECT * FROM p{n}" for n in range(4)) + ")",
        "v2 AS (SELECT *, " + ", ".join(f"{v} AS xyz_{c}" for v, c in zip(S.xyz_of("out"), "xyz", strict=True)) + " FROM v1)",
        f"v3 AS (SELECT *, {lab[0]} AS lab_l, {lab[1]} AS lab_a, {lab[2]} AS lab_b FROM v2)",
        S.delta_e_ctes("v3", ("lab_l", "lab_a", "lab_b"), ("t_l", "t_a", "t_bb")),
    ]
    return S.with_(*BASE, *ctes) + """SELECT CAST(frame AS INT) AS frame, model, round(avg(delta_e), 4) AS mean_delta_e, round(median(delta_e), 4) AS median_delta_e,
  round(quantile_cont(delta_e, 0.95), 4) AS p95_delta_e, round(max(delta_e), 4) AS max_delta_e FROM scored GROUP BY 1, 2"""


@query(_model_sql())
def f08_model_comparison(spark, sf_dir):
    """Four colour models by what each misses on patches left out."""
    ref = chart_reference(spark)
    return rounded(models.comparison(models.scored(models.predictions(samples(spark, sf_dir), ref), ref)), 4)


@query(
    S.with_(
        *BASE,
        "kept AS (SELECT frame, patch_idx, CASE WHEN frame = 3 THEN 0 ELSE mean_r END AS mean_r, CASE WHEN frame = 4 THEN mean_r ELSE mean_g END AS mean_g, CASE WHEN frame = 4 THEN mean_r ELSE mean_b END AS mean_b FROM samples WHERE (frame <> 1 OR patch_idx >= 22) AND (frame <> 2 OR patch_idx < 18))",
        "facts AS (SELECT frame, count(*) AS n, count(*) FILTER (is_neutral) AS neutral FROM kept JOIN ref USING (patch_idx) GROUP BY 1)",
    )
    + "SELECT CAST(frame AS INT) AS frame, CASE WHEN n < 3 OR neutral = 0 THEN 'insufficient patches' WHEN frame IN (3, 4) THEN 'singular matrix' END AS error FROM facts"
)
def f05_fit_errors(spark, sf_dir):
    """Frame 1 with two patches, 2 without neutral ones, 3 without red, and 4 with one channel three times, which its matrix can't be fitted to."""
    s, frame = samples(spark, sf_dir), F.col("frame")
    kept = s.filter("(frame <> 1 or patch_idx >= 22) and (frame <> 2 or patch_idx < 18)").withColumns(
        {"mean_r": F.when(frame == 3, 0.0).otherwise(F.col("mean_r")), "mean_g": F.when(frame == 4, F.col("mean_r")).otherwise(F.col("mean_g")), "mean_b": F.when(frame == 4, F.col("mean_r")).otherwise(F.col("mean_b"))}
    )
    return calibration.fit_errors(kept, chart_reference(spark))


@query(
    S.with_(*BASE, GATES)
    + """SELECT CAST(frame AS INT) AS frame, CASE WHEN starts_with(reason, 'clipped') THEN 'clipped' WHEN contains(reason, 'coefficient of variation') THEN 'noisy'
  WHEN starts_with(reason, 'last row is not the neutral row') THEN 'orientation' ELSE 'other' END AS category, count(*) AS n FROM failures GROUP BY 1, 2"""
)
def a08_failure_categories(spark, sf_dir):
    return calibration.failure_categories(calibration.gate_failures(samples(spark, sf_dir)))


_EVEN = lambda relaxed, strict: f"CASE WHEN frame % 2 = 0 THEN {relaxed} ELSE {strict} END"


@query(
    S.with_(*BASE, gates_sql(_EVEN(16, 64), _EVEN(0.25, 0.05), "frame % 2 = 1"))
    + "SELECT CAST(frame AS INT) AS frame, CAST(ord AS INT) AS ord, CAST(patch_idx AS INT) AS patch_idx, reason, measured FROM failures"
)
def g11_gate_presets(spark, sf_dir):
    """Frames of even number as rendered images, under relaxed thresholds."""
    return calibration.preset_failures(samples(spark, sf_dir), F.col("frame") % 2 == 0)


_ESC = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(
    S.with_(
        *VALID,
        GATES,
        f"""listed AS (SELECT frame, count(*) AS failed, string_agg('<tr><td>' || coalesce({_ESC('r.patch')}, 'chart') || '</td><td>' || {_ESC('reason')} || '</td><td>' || {_ESC('measured')} || '</td></tr>', '' ORDER BY ord) AS rows
  FROM failures f LEFT JOIN ref r USING (patch_idx) GROUP BY 1)""",
        f"""shown AS (SELECT frame, printf('mean %.3f, max %.3f', avg(delta_e), max(delta_e)) AS metrics, string_agg('<tr><td>' || {_ESC('patch')} || '</td><td>' || printf('%.3f', delta_e) || '</td></tr>', '' ORDER BY delta_e DESC, patch_idx) AS rows
  FROM scored WHERE delta_e IS NOT NULL GROUP BY 1)""",
    )
    + """SELECT CAST(s.frame AS INT) AS frame, '<!doctype html><meta charset="utf-8"><h1>' || CASE WHEN failed IS NULL THEN CASE WHEN s.frame % 2 = 0 THEN 'rendered source, approximate' ELSE 'gates passed' END
  ELSE CASE WHEN s.frame % 2 = 0 THEN 'rendered source, approximate, gates failed' ELSE 'gates failed' END END || '</h1><p>' || metrics || '</p>'
  || CASE WHEN failed IS NULL THEN '' ELSE '<h2>Failed checks</h2><table>' || l.rows || '</table>' END || '<h2>Patches by difference</h2><table>' || s.rows || '</table>' AS html FROM shown s LEFT JOIN listed l ON l.frame = s.frame"""
)
def k11_html_report(spark, sf_dir):
    failures = calibration.gate_failures(samples(spark, sf_dir))
    return reports.html_reports(written(validated(spark, sf_dir), "patches"), failures, F.col("frame") % 2 == 0)


_SIDE = "(1600 + o_custkey % 400)"
_AT = lambda a, u, v: "+".join(f"{w}*{a}{k}" for k, w in enumerate((f"(1-{u})*(1-{v})", f"{u}*(1-{v})", f"{u}*{v}", f"(1-{u})*{v}")))


@query(
    f"""WITH q AS (SELECT o_orderkey AS frame, {_SIDE} AS width, 1200 AS height, {", ".join(f"CAST({QUAD[f'{a}{k}']} + o_custkey % {p} AS DOUBLE) AS {a}{k}" for k in range(4) for a, p in (("x", 97), ("y", 53)))} FROM orders),
c AS (SELECT q.*, p AS patch_idx, k, (p % 6 + CASE WHEN k IN (0, 3) THEN 0.2e0 ELSE 0.8e0 END)/6.0e0 AS u, (p // 6 + CASE WHEN k IN (0, 1) THEN 0.2e0 ELSE 0.8e0 END)/4.0e0 AS v FROM q, range(24) a(p), range(4) b(k)),
t AS (SELECT frame, patch_idx, string_agg(printf('%.1f,%.1f', {_AT('x', 'u', 'v')}, {_AT('y', 'u', 'v')}), ' ' ORDER BY k) AS points FROM c GROUP BY 1, 2),
areas AS (SELECT frame, string_agg('<polygon points="' || points || '" class="patch"/>', '' ORDER BY patch_idx) AS areas FROM t GROUP BY 1)
SELECT frame, printf('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 %d %d">', width, height) || '<polygon points="' || concat_ws(' ', {", ".join(f"printf('%.1f,%.1f', x{k}, y{k})" for k in range(4))}) || '" class="quad"/>' || areas || '</svg>' AS svg
FROM q JOIN areas USING (frame)"""
)
def k12_svg_overlay(spark, sf_dir):
    """Orders as frames, each with its own quad."""
    c, shift = F.col("o_custkey"), {"x": 97, "y": 53}
    corners = {f"{a}{k}": (F.lit(QUAD[f"{a}{k}"]) + c % shift[a]).cast("double") for k in range(4) for a in "xy"}
    quads = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), (1600 + c % 400).alias("width"), F.lit(1200).alias("height"), *(v.alias(k) for k, v in corners.items()))
    return reports.svg_overlays(quads)


# --- datasets, spaces, images

_BROKEN = {"illuminant": 5, "observer": 7, "adaptation": 11, "white": 13}
_NAMES = "names(patch_idx, patch) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATCHES)) + ")"
_FACTS = " ".join(f"WHEN c_custkey % {_BROKEN[c]} = 0 THEN '{c} must be {v}, found other'" for c, v in A.CHART_FACTS)


@query(
    f"""WITH {_NAMES}, found AS (
  SELECT c_custkey AS dataset, 3 AS place, 1 AS rule, 'patch 3 must be ' || patch AS error FROM customer, names WHERE patch_idx = 3 AND c_custkey % 19 = 0
  UNION ALL SELECT c_custkey, c_custkey % 24, 2, 'patch ' || (c_custkey % 24) || ' has no label' FROM customer WHERE c_custkey % 23 = 0
  UNION ALL SELECT c_custkey, 9, 3, 'patch 9 is not finite' FROM customer WHERE c_custkey % 29 = 0),
firsts AS (SELECT dataset, error FROM found QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY place, rule) = 1)
SELECT c_custkey AS dataset, CASE {_FACTS} WHEN c_custkey % 17 = 0 THEN '24 patches expected, found 23' ELSE error END AS error FROM customer LEFT JOIN firsts ON dataset = c_custkey"""
)
def s15_chart_errors(spark, sf_dir):
    """Customers as chart datasets, some with a wrong fact, a patch too few, a wrong name, a blank label or an infinite value."""
    k, i = F.col("dataset"), F.col("patch_idx")
    sets = adapters.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset"))
    facts = sets.select("dataset", *(F.when(k % _BROKEN[c] == 0, "other").otherwise(v).alias(c) for c, v in A.CHART_FACTS))
    chart = chart_xyy(spark).filter(F.col("revision") == FROM).drop("revision")
    places = F.explode(F.sequence(F.lit(0), F.when(k % 17 == 0, 22).otherwise(23)))
    patches = sets.select("dataset", places.alias("patch_idx")).join(F.broadcast(chart), "patch_idx").select(
        "dataset",
        "patch_idx",
        F.when((k % 19 == 0) & (i == 3), "unknown").otherwise(F.col("patch")).alias("patch"),
        F.when((k % 23 == 0) & (i == k % 24), " ").otherwise("label").alias("label"),
        F.when((k % 29 == 0) & (i == 9), float("inf")).otherwise(F.col("x")).alias("x"),
        "y",
        "big_y",
    )
    return A.chart_errors(facts, patches, chart.select("patch_idx", "patch"))


_ASKED = ["srgb", "display-p3", "adobe-rgb", "sRGB", "rec2020", ""]
_TEXT = lambda v: "NULL" if v is None else f"'{v}'"


@query(
    "WITH s(space, place, label, config_name) AS (VALUES " + ", ".join(f"('{n}', {i}, '{v}', {_TEXT(w)})" for i, (n, v, w) in enumerate(transform.SPACES)) + f"""),
r AS (SELECT o_orderkey AS id, ({_ASKED})[o_orderkey % 6 + 1] AS space FROM orders)
SELECT id, r.space, CAST(place AS INT) AS place, label, config_name, CASE WHEN s.space IS NULL THEN 'unknown output space: ' || r.space END AS error FROM r LEFT JOIN s ON s.space = r.space"""
)
def t06_output_spaces(spark, sf_dir):
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    requests = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), asked.alias("space"))
    return transform.resolved_spaces(requests, transform.output_spaces(spark))


@query(
    """SELECT o_orderkey AS image, CASE WHEN o_orderkey % 7 = 0 THEN 'image has no pixels' WHEN o_orderkey % 5 = 0 THEN 'colour profile is empty'
  WHEN o_orderkey % 3 = 0 THEN 'sample count differs from dimensions' END AS error FROM orders"""
)
def k05_image_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    width = F.when(k % 7 == 0, 0).otherwise(6000 + k % 100)
    count = width * 40_000 * 3 + F.when(k % 3 == 0, 1).otherwise(0)
    return adapters.table(spark, sf_dir, "orders").select(k.alias("image"), A.image_error(width, F.lit(40_000), count, F.when(k % 5 == 0, 0).otherwise(3144)).alias("error"))


# --- metadata, names, numbers

_ENTRY = """e AS (SELECT l_orderkey AS file, CAST(l_linenumber AS INT) AS ord, CASE WHEN l_partkey % 3 = 0 THEN 'primary' ELSE 'exif' END AS directory, CAST(l_suppkey % 4 AS INT) AS tag, CAST(l_quantity*600 AS INT) AS size FROM lineitem)"""


@query(
    "WITH RECURSIVE " + _ENTRY + """, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord, directory, tag, size) AS r FROM e),
walk AS (SELECT file, 0::BIGINT AS r, 60000::BIGINT AS rest, []::VARCHAR[] AS seen, NULL::INT AS ord, NULL::VARCHAR AS directory, NULL::INT AS tag, NULL::INT AS size, NULL::VARCHAR AS status FROM (SELECT DISTINCT file FROM e)
  UNION ALL SELECT file, r, CASE WHEN status = 'copied' THEN rest - greatest(size, 4) - 14 ELSE rest END, CASE WHEN status = 'copied' THEN list_append(seen, directory || ':' || tag) ELSE seen END, ord, directory, tag, size, status FROM
  (SELECT n.*, w.rest, w.seen, CASE WHEN n.size > w.rest OR greatest(n.size, 4) + 14 > w.rest THEN 'too large' WHEN list_contains(w.seen, n.directory || ':' || n.tag) THEN 'duplicate' ELSE 'copied' END AS status FROM walk w JOIN n ON n.file = w.file AND n.r = w.r + 1))
SELECT file, ord, directory, tag, size, status FROM walk WHERE r > 0"""
)
def s18_metadata_budget(spark, sf_dir):
    """Orders as files, whose line items are metadata entries of up to 30,000 bytes."""
    entries = lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("file"),
        F.col("l_linenumber").cast("int").alias("ord"),
        F.when(F.col("l_partkey") % 3 == 0, "primary").otherwise("exif").alias("directory"),
        (F.col("l_suppkey") % 4).cast("int").alias("tag"),
        (F.col("l_quantity") * 600).cast("int").alias("size"),
    )
    return A.within_budget(entries)


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS c, 'scan/img-' || o_custkey || '.tiff' AS output, 'scan/img-' || o_custkey || '.nef' AS path FROM orders),
i AS (SELECT path FROM p UNION ALL SELECT output FROM p WHERE c % 7 = 0)
SELECT path, output FROM p WHERE output IN (SELECT path FROM i)"""
)
def j09_refused_outputs(spark, sf_dir):
    """Customers' scans; a seventh of the outputs was selected as an input too."""
    c = F.col("o_custkey")
    name = lambda end: F.format_string(f"scan/img-%d.{end}", c)
    planned = adapters.table(spark, sf_dir, "orders").select(c).distinct().select(c, name("nef").alias("path"), name("tiff").alias("output"))
    inputs = planned.select("path").unionByName(planned.filter(c % 7 == 0).select(F.col("output").alias("path")))
    return batch.refused_outputs(planned.select("path", "output"), inputs)


@query(
    """WITH RECURSIVE have AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'entry-of-' || (l_partkey % 50) ELSE 'entry-of-' || (l_partkey % 50) || '-' || l_linenumber END AS name FROM lineitem),
want AS (SELECT c_custkey AS id, 'entry-of-' || (c_custkey % 60) || CASE WHEN c_custkey % 7 = 0 THEN '-' || (c_custkey % 11 + 7) ELSE '' END AS stem, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
-- one request after another: the names taken so far go along
serving AS (
  SELECT CAST(0 AS BIGINT) AS i, (SELECT list(name) FROM have) AS taken, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS stem, CAST(NULL AS VARCHAR) AS name
  UNION ALL
  SELECT i, list_append(taken, name), id, stem, name FROM (
    SELECT w.i, s.taken, w.id, w.stem, list_filter(list_prepend(w.stem, list_transform(range(2, len(list_filter(s.taken, lambda x: starts_with(x, w.stem))) + 3), lambda k: w.stem || '-' || k)), lambda x: NOT list_contains(s.taken, x))[1] AS name
    FROM serving s JOIN want w ON w.i = s.i + 1))
SELECT id, stem, name FROM serving WHERE i > 0"""
)
def o08_free_names(spark, sf_dir):
    """Customers as entries to be saved one after another, several with a stem and some with one that others' names meet, beside a library named
    by line items with gaps among the numbers."""
    part, nth, c = F.col("l_partkey") % 50, F.col("l_linenumber"), F.col("c_custkey")
    have = lineitem(spark, sf_dir).select(F.when(nth == 1, F.format_string("entry-of-%d", part)).otherwise(F.format_string("entry-of-%d-%d", part, nth)).alias("name")).distinct()
    end = F.when(c % 7 == 0, F.format_string("-%d", c % 11 + 7)).otherwise("")
    want = adapters.table(spark, sf_dir, "customer").select(c.alias("id"), F.concat(F.format_string("entry-of-%d", c % 60), end).alias("stem"), c.alias("place"))
    return batch.free_names(want, have).select("id", "stem", "name")


@query(
    """WITH t AS (SELECT l_orderkey*10 + l_linenumber AS item, l_quantity::INT AS q, l_suppkey % 5 AS kind FROM lineitem)
SELECT item, CASE WHEN kind IN (0, 1, 2) THEN concat_ws('|', printf('%.2f', q + 0.5), printf('%.2f', 10.0), printf('%.2f', -1.25), printf('%.2f', 1000.0), printf('%.2f', 5.0), printf('%.2f', 6.0), printf('%.2f', 7.0), printf('%.2f', 8.0)) END AS quad FROM t"""
)
def d08_parse_quad(spark, sf_dir):
    """Line items as texts of a quad: with blanks, with exponents, with seven numbers, or with a word."""
    kind, q = F.col("l_suppkey") % 5, F.col("l_quantity").cast("int")
    head = F.format_string("%d.5", q)
    text = (
        F.when(kind == 0, F.concat(head, F.lit(",10,-1.25,1000,5,6,7,8")))
        .when(kind == 1, F.concat(F.lit("  "), head, F.lit(" , 10, -1.25 ,1000,5,6,7, 8 ")))
        .when(kind == 2, F.concat(head, F.lit(",1e1,-125e-2,1E3,5.,6.0,7,8")))
        .when(kind == 3, F.concat(head, F.lit(",10,-1.25,1000,5,6,7")))
        .otherwise(F.concat(head, F.lit(",ten,-1.25,1000,5,6,7,8")))
    )
    return lineitem(spark, sf_dir).select("item", F.array_join(F.transform(T.parse_quad(text), lambda v: F.format_string("%.2f", v)), "|").alias("quad"))


@query("SELECT CAST(o_orderkey % 3 AS VARCHAR) AS major, o_orderkey % 3 = 1 AS readable, count(*) AS n FROM orders GROUP BY 1, 2")
def x05_schema_major(spark, sf_dir):
    """Orders as profiles by the major part of their version; this library reads 1."""
    k = F.col("o_orderkey")
    version = F.when(k % 2 == 0, F.format_string("%d.%d.0", k % 3, k % 10)).otherwise((k % 3).cast("string"))
    major = T.schema_major(version)
    return adapters.table(spark, sf_dir, "orders").groupBy(major.alias("major"), (major == "1").alias("readable")).agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT l_orderkey*10 + l_linenumber AS item, (l_quantity - 25)*CASE WHEN l_suppkey % 3 = 0 THEN 100 ELSE 0.25 END AS value FROM lineitem)
SELECT item, CASE WHEN abs(value*1000000) <= 2147483647 THEN CAST(round(value*1000000) AS INT) END AS numerator FROM v"""
)
def x08_signed_rational(spark, sf_dir):
    value = (F.col("l_quantity") - 25) * F.when(F.col("l_suppkey") % 3 == 0, 100.0).otherwise(0.25)
    return lineitem(spark, sf_dir).select("item", A.signed_rational(value).alias("numerator"))


_META = "meta AS (SELECT l_orderkey AS file, l_linenumber AS ord, (" + str([d for d, _ in META_TAGS]) + ")[l_partkey % 9 + 1] AS directory, (" + str([t for _, t in META_TAGS]) + ")[l_partkey % 9 + 1] AS tag, CAST(l_quantity AS INT)*600 + CASE WHEN l_quantity = 50 THEN 36000 ELSE 0 END AS size, l_suppkey % 5 = 0 AS bad FROM lineitem)"


@query(
    "WITH RECURSIVE " + _META + """,
seen AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord, directory, tag, size, bad) AS i, CASE WHEN directory = 'gps' AND file % 2 = 0 THEN 'GPS stripped' WHEN tag IN (274, 37500) OR (directory = 'gps' AND tag = 99) THEN '' WHEN tag = 5 THEN 'left out' END AS early FROM meta),
kept AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY i) AS k FROM seen WHERE early IS NULL OR early <> 'left out'),
run AS (
  SELECT file, 0::BIGINT AS k, 60000::BIGINT AS spare, []::VARCHAR[] AS had, NULL::INT AS ord, NULL::VARCHAR AS name, NULL::VARCHAR AS reason FROM (SELECT DISTINCT file FROM kept)
  UNION ALL
  SELECT file, k, CASE WHEN reason = 'copied' THEN spare - greatest(size, 4) - 14 ELSE spare END, CASE WHEN reason = 'copied' THEN list_append(had, name) ELSE had END, ord, name, reason FROM (
    SELECT n.file, n.k, r.spare, r.had, n.ord, n.size, n.directory || ':' || n.tag AS name, CASE WHEN early IS NOT NULL THEN early WHEN size > spare OR size > 65500 THEN 'too large for JPEG EXIF' WHEN bad THEN 'unsupported value'
      WHEN greatest(size, 4) + 14 > spare THEN 'too large for JPEG EXIF' WHEN list_contains(had, n.directory || ':' || n.tag) THEN 'duplicate' ELSE 'copied' END AS reason FROM run r JOIN kept n ON n.file = r.file AND n.k = r.k + 1))
SELECT file, CAST(ord AS INT) AS ord, reason = 'copied' AS copied, CASE WHEN reason IN ('copied', '') THEN name ELSE name || ' (' || reason || ')' END AS shown FROM run WHERE k > 0"""
)
def s18_metadata_report(spark, sf_dir):
    """Orders as files with line items as metadata entries: what is copied and what the report says of the rest; GPS is stripped of every second file."""
    pick = lambda vs: F.element_at(F.array(*map(F.lit, vs)), (F.col("l_partkey") % 9 + 1).cast("int"))
    size = F.col("l_quantity").cast("int") * 600 + F.when(F.col("l_quantity") == 50, 36000).otherwise(0)
    entries = lineitem(spark, sf_dir).select(
        F.col("l_orderkey").alias("file"),
        F.col("l_linenumber").cast("int").alias("ord"),
        pick([d for d, _ in META_TAGS]).alias("directory"),
        pick([t for _, t in META_TAGS]).alias("tag"),
        size.alias("size"),
        F.when(F.col("l_suppkey") % 5 == 0, "byte").otherwise("ascii").alias("kind"),
        F.lit("one\0").alias("text"),
        F.lit(1).alias("n_values"),
        F.lit(False).alias("zero_denominator"),
    )
    entries = entries.withColumn("name", F.concat_ws(":", "directory", F.col("tag").cast("string")))
    rules = A.tag_rules(spark)
    parts = [A.metadata_report(entries.filter(F.col("file") % 2 == k), rules, strip_gps=k == 0) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("""SELECT i AS event_id, CASE WHEN i % 10 <> 0 AND v <= 180 THEN round(CASE WHEN i % 2 = 0 THEN -v ELSE v END, 6) + 0e0 END AS longitude,
  CASE WHEN i % 9 <> 0 THEN round(CASE WHEN i % 4 = 1 THEN -1 ELSE 1 END*(i % 9000)/(i % 9)::DOUBLE, 6) + 0e0 END AS altitude FROM (SELECT event_id AS i, event_id % 200 + (event_id % 60)/60e0 AS v FROM events)""")
def s17_longitude_altitude(spark, sf_dir):
    """Events as captures with a position: the west is negative, as is what lies below the sea; 0 is no denominator."""
    i = F.col("event_id")
    side = F.when(i % 10 == 0, None).when(i % 2 == 0, "w").otherwise("E")
    degrees = capture.degrees(i % 200, i % 60, F.lit(0), side, "W", 180.0)
    metres = capture.altitude(i % 9000, i % 9, F.when(i % 4 != 3, i % 4))
    rows = adapters.table(spark, sf_dir, "events").select("event_id", degrees.alias("longitude"), metres.alias("altitude"))
    return rows.select("event_id", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("longitude", "altitude")))
