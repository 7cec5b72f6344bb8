"""Places, output names, acceptance rules, sealed profiles and texts on made rows."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.functions import text
from tintframe.operators import acceptance, batch, interchange, ordering, records


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("places", [1, 2, 3, 6])
def test_numbers_of_fixed_places(spark, places):
    rng = np.random.default_rng(places)
    ties = [k / 10 ** (places + 1) for k in (5, 15, 25, 1235, 16645, 8325, 5305, 10625)] + [0.0, 0.125, -0.375, 2.5, 1e15, 0.25, 0.75]
    values = [*ties, *(-v for v in ties), *(rng.integers(0, 10**7, 500) * 10 + 5.0) / 10 ** (places + 1), *rng.normal(0, 50, 200)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", text.fixed(F.col("v"), places).alias("t"))
    assert [(r.v, r.t) for r in rows.collect() if r.t != f"{r.v:.{places}f}"] == []


def test_places(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")).repartition(7)
    got = {r.k: r.place for r in ordering.with_place(df, ["k"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1, 1001))
    assert ordering.with_place(df.filter("false"), ["k"]).count() == 0


@pytest.mark.parametrize(
    "stems", [["a", "a", "a-1"], ["a-1", "a", "a"], ["a", "a-1", "a", "a-1", "a"], ["b-2", "b", "b", "b", "b-1-1", "b-1"], ["c-01", "c", "c"], ["-1", "x--1", "x-"]]
)
def test_output_names_equal_the_rule(spark, stems):
    paths = [f"{i:02d}/{s}.dng" for i, s in enumerate(stems)]
    seen, want = set(), {}
    for p, s in zip(paths, stems):
        name, k = s, 1
        while name in seen:
            name, k = f"{s}-{k}", k + 1
        seen.add(name)
        want[p] = f"{name}.tiff"
    found = batch.collect_inputs(spark.createDataFrame([(p,) for p in paths], "path string").repartition(3))
    assert {r.path: r.output for r in batch.output_names(found, "tiff").collect()} == want


def frame(**change):
    base = dict(width=4, height=2, active_full=True, photometric="cfa", components=1, cfa="RGGB", integer_samples=True, samples=8, black=[1.0, 2.0, 3.0, 4.0], black_w=2, black_h=2, black_cpp=1, white=[100])
    return {**base, **change}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({}, None),
        ({"height": 0}, "empty RAW image"),
        ({"active_full": False}, "RAW crop or active area is not the full frame"),
        ({"cfa": "RGBE"}, "only RGB Bayer CFA is supported"),
        ({"components": 3}, "only 2x2 Bayer CFA is supported"),
        ({"photometric": "other"}, "only 2x2 Bayer and three-component LinearRaw are supported"),
        ({"samples": 9}, "RAW sample count differs from image dimensions"),
        ({"black_w": 3}, "unsupported CFA black-level grid"),
        ({"black": [1.0]}, "missing black level"),
        ({"black": [1.0, 2.5, 3.0, 4.0]}, "fractional or out-of-range black level"),
        ({"white": [100, 100]}, "missing white level"),
        ({"white": [4]}, "white level is not greater than black level"),
        ({"white": [70_000]}, "white level exceeds 16 bits"),
        ({"photometric": "linear", "components": 3, "samples": 24, "black_cpp": 3, "black_w": 1, "black_h": 1, "black": [1.0, 2.0, 3.0]}, None),
        ({"photometric": "linear", "components": 3, "samples": 24, "black_cpp": 1, "black_w": 1, "black_h": 2, "black": [1.0, 2.0]}, "LinearRaw black level varies across the repeat grid"),
    ],
)
def test_raw_frames(spark, change, error):
    kinds = "width int, height int, active_full boolean, photometric string, components int, cfa string, integer_samples boolean, samples long, black array<double>, black_w int, black_h int, black_cpp int, white array<int>"
    f = frame(**change)
    df = spark.createDataFrame([tuple(f.values())], kinds)
    assert df.select(acceptance.raw_frame_error().alias("e")).first().e == error


def test_metadata_and_exports(spark):
    rows = [("primary", 33432, "ascii", "a\0b\0", 1, False), ("primary", 271, "ascii", "a\0b\0", 1, False), ("primary", 271, "ascii", "ab", 1, False), ("gps", 2, "rational", None, 3, True), ("gps", 2, "rational", None, 3, False), ("exif", 1, "byte", None, 1, False), ("gps", 0, "ascii", "a\0", 4, False)]
    entries = spark.createDataFrame(rows, "directory string, tag int, kind string, text string, n_values int, zero_denominator boolean").coalesce(1)
    got = acceptance.checked_tags(entries, acceptance.tag_rules(spark)).select("status").collect()
    assert [r.status for r in got] == ["copied", "bad value", "bad value", "bad value", "copied", "not allowed", "bad value"]
    assert one(spark, acceptance.signed_rational(F.lit(-1.0000005))) == -1_000_001 and one(spark, acceptance.signed_rational(F.lit(1e9))) is None
    assert one(spark, acceptance.export_error(F.lit("jpeg"), F.lit(0))) == "JPEG quality must be 1-100, got 0" and one(spark, acceptance.export_error(F.lit("png"), F.lit(0))) is None
    fine = [F.lit(1.0)] * 3
    assert one(spark, acceptance.dcp_refusal(F.lit(False), F.lit("Käm"), fine, fine)) == "camera name must be printable ASCII"
    assert one(spark, acceptance.dcp_refusal(F.lit(False), F.lit("Cam"), fine, [F.lit(None).cast("double"), *fine])).startswith("fitted matrix is singular")
    assert one(spark, acceptance.display_neutral(F.array(F.lit(2.0), F.lit(1.0), F.lit(4.0)))) == [0.5, 1.0, 0.25]
    assert one(spark, acceptance.display_neutral(F.array(F.lit(2.0), F.lit(0.0), F.lit(4.0)))) is None


def test_numbers_and_paths(spark):
    values = [1.0, 0.5, -2.25, 0.0, -0.0, 3e-6, 1234567.1234567, 0.0001, -0.00012345, 1e7, 123456789.25, 1e15, 1e16, -2.5e20, 1e-5, 9.9e-6, 5e-324, 1.7976931348623157e308, float("nan")]
    rng = np.random.default_rng(2)
    values += (rng.normal(size=200) * 10.0 ** rng.integers(-12, 18, 200)).tolist()
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    rows = rows.select("i", records.json_number(F.col("v")).alias("j"), records.text_number(F.col("v")).alias("t"), records.json_number(F.col("v"), 6).alias("six")).orderBy("i").collect()
    assert [r.j for r in rows[:9]] == ["1.0", "0.5", "-2.25", "0.0", "0.0", "3e-6", "1234567.1234567", "0.0001", "-0.00012345"]
    assert [r.j for r in rows[9:16]] == ["10000000.0", "123456789.25", "1000000000000000.0", "1e16", "-2.5e20", "0.00001", "9.9e-6"] and rows[18].j == "null"
    for v, r in zip(values, rows):
        if v == v:
            assert json.loads(r.j) == v and float(r.t) == v and "e" not in r.t and not r.t.endswith(".0"), v
    assert [rows[i].six for i in (6, 8, 15)] == ["1234567.123457", "-0.000123", "0.00001"]
    path = lambda p: one(spark, records.canonical_path(F.lit(p)))
    assert [path(p) for p in ("/a//b/./c/../d/", "../x", "a/..", "/")] == ["/a/b/d", "x", "", "/"]


def test_profiles_are_sealed_json(spark):
    fixed = {"schema_version": "1.0", "make": 'A "B"', "model": "C\\D", "decoder": "d", "decoder_version": "1", "revision": "r", "dataset_digest": "aa", "reference_digest": "bb"}
    fixed |= {c: v for c, v, _ in acceptance.PINNED}
    numbers = ["exposure", "c_r", "c_g", "c_b", *(f"m{i}{j}" for i in range(3) for j in range(3)), "mean_delta_e", "max_delta_e", "p95_delta_e", "neutral_max_delta_e", "skin_max_delta_e", "condition_number"]
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fixed.items()), *(F.lit(1 / 3 + i).alias(n) for i, n in enumerate(numbers)), F.lit(24).alias("patch_count"))
    failures = F.array(F.struct(F.lit(None).cast("string").alias("patch"), F.lit("noisy").alias("reason"), F.lit("cv=1").alias("measured")))
    flags = acceptance.provenance(F.lit(1), F.lit(True), F.lit(False))
    sealed = records.profile_json(df.withColumns({**flags, "failures": failures}))
    row = sealed.first()
    read = json.loads(row.json)
    keys = ["schema-version", "decode-contract", "camera", "chart-revision", "dataset-digest", "reference-digest", "transform", "validation", "quality", "digest"]
    assert list(read) == keys and read["camera"]["make"] == 'A "B"' and read["camera"]["model"] == "C\\D"
    contract = {"decoder": "d", "decoder-version": "1", "output-color": "raw", "output-depth": "u16", "gamma": [1.0, 1.0], "white-balance": {"unity": {"user-mul": [1.0] * 4}}}
    contract |= {"no-auto-bright": True, "demosaic": "ahd", "highlight": "clip", "orientation": "as-shot", "no-auto-scale": False}
    assert read["decode-contract"] == contract and list(read["decode-contract"]) == list(contract)
    assert read["transform"]["matrix"][2] == [1 / 3 + 10, 1 / 3 + 11, 1 / 3 + 12]  # every bit
    assert read["quality"] == {"passed": False, "overridden": True, "quick-and-dirty": False, "failures": [{"patch": None, "reason": "noisy", "measured": "cv=1"}]}
    bare = json.dumps({**read, "digest": ""}, indent=2)
    assert row.digest == read["digest"] == hashlib.sha256(bare.encode()).hexdigest()
    short = hashlib.sha256(json.dumps(contract, separators=(",", ":")).encode()).hexdigest()[:16]
    clf = records.clf_text(sealed).first().clf
    assert f'id="profile-{row.digest[:12]}"' in clf and f"decode contract digest {short}, camera A \"B\" C\\D<" in clf
    assert records.verified(sealed).first().error is None
    auto = records.profile_json(df.withColumns({**flags, "failures": failures, "white_balance": F.lit("camera metadata")}))
    assert json.loads(auto.first().json)["decode-contract"]["white-balance"] == "camera-metadata"
    assert records.verified(auto).first().error == "invalid decode contract: white balance"
    assert records.verified(sealed.withColumn("json", F.replace("json", F.lit('"aa"'), F.lit('"ab"')))).first().error == "profile digest mismatch"


def test_clf_and_thumbnails(spark):
    stages = spark.range(1).select(F.lit(2.0).alias("exposure"), *(F.lit(v).alias(c) for c, v in (("c_r", 0.5), ("c_g", 0.0), ("c_b", 1.0))), *(F.lit(float(3 * i + j)).alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    row = records.parsed_clf(records.clf_text(stages)).first()
    assert row.error is None and row["values"] == [1, 0, 0, 0, 0, 0, 0, 0, 0.5, *range(9)]
    px = spark.range(1200).selectExpr("cast(id % 40 as int) as x", "cast(id div 40 as int) as y")
    got = interchange.thumbnail_pixels(px, 40, 30, most=10).collect()
    assert {(r.tx, r.ty, r.x, r.y) for r in got} == {(tx, ty, int((tx + 0.5) * 4), int((ty + 0.5) * 30 / 8)) for tx in range(10) for ty in range(8)}


def test_metadata_reports(spark):
    rows = [("a", 1, "primary", 271, "Make", 10, "ascii", "x\0"), ("a", 2, "gps", 1, "GPSLatitudeRef", 2, "ascii", "N\0"), ("a", 3, "primary", 274, "Orientation", 2, "integer", None)]
    rows += [("a", 4, "primary", 5, "Odd", 2, "integer", None), ("a", 5, "primary", 272, "Model", 70_000, "ascii", "x\0"), ("a", 6, "primary", 315, "Artist", 10, "ascii", "no end"), ("a", 7, "primary", 271, "Make", 10, "ascii", "y\0"), ("a", 8, "gps", 99, "Odd", 2, "integer", None)]
    entries = spark.createDataFrame(rows, "file string, ord int, directory string, tag int, name string, size int, kind string, text string").withColumns({"n_values": F.lit(1), "zero_denominator": F.lit(False)})
    rules = acceptance.tag_rules(spark)
    shown = lambda strip: [(r.shown, r.copied) for r in acceptance.metadata_report(entries, rules, strip).orderBy("ord").collect()]
    rest = [("Orientation", False), ("Model (too large for JPEG EXIF)", False), ("Artist (unsupported value)", False), ("Make (duplicate)", False)]
    assert shown(False) == [("Make", True), ("GPSLatitudeRef", True), *rest, ("Odd", False)]
    assert shown(True) == [("Make", True), ("GPSLatitudeRef (GPS stripped)", False), *rest, ("Odd (GPS stripped)", False)]
    assert acceptance.metadata_report(entries.filter("false"), rules).count() == 0


def test_altitudes(spark):
    from tintframe.functions import capture

    cases = [((10, 4, 0), 2.5), ((10, 4, 1), -2.5), ((10, 4, None), 2.5), ((10, 0, 0), None), ((None, 1, 0), None)]
    df = spark.createDataFrame([c for c, _ in cases], "n int, d int, below int")
    assert [r.v for r in df.select(capture.altitude(F.col("n"), F.col("d"), F.col("below")).alias("v")).collect()] == [v for _, v in cases]


def test_library_saves(spark):
    fixed = {"schema_version": "1.0", "make": "A", "model": "B", "decoder": "d", "decoder_version": "1", "revision": "r", "dataset_digest": "aa", "reference_digest": "bb"} | {c: v for c, v, _ in acceptance.PINNED}
    numbers = ["exposure", "c_r", "c_g", "c_b", *(f"m{i}{j}" for i in range(3) for j in range(3)), "mean_delta_e", "max_delta_e", "p95_delta_e", "neutral_max_delta_e", "skin_max_delta_e", "condition_number"]
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in fixed.items()), *(F.lit(1.5).alias(n) for n in numbers), F.lit(24).alias("patch_count"))
    none = F.array().cast("array<struct<patch:string,reason:string,measured:string>>")
    sealed = records.profile_json(df.withColumns({**acceptance.provenance(F.lit(0), F.lit(False), F.lit(False)), "failures": none})).first()
    asked = [(1, " Zoo ", "bb", sealed.json), (2, "Zoo", "BB", sealed.json), (3, " ", "bb", sealed.json), (4, "Zoo", "cc", sealed.json), (5, "Zoo", "bb", "{}"), (6, "zoo", "bb", sealed.json)]
    rows = spark.createDataFrame(asked, "place long, label string, reference_digest string, json string")
    capture = {"make": "line\none", "model": None, "lens": None, "captured_at": None}
    rows = rows.withColumns({k: F.lit(v).cast("string") for k, v in capture.items()} | {"notes": F.lit(""), "tags": F.array(F.lit("x")), "iso": F.lit(100), "latitude": F.lit(1.0), "longitude": F.lit(-2.5), "altitude": F.lit(None).cast("double"), "include_gps": F.col("place") == 1})
    stem = "zoo-" + sealed.digest[:8]
    got = {r.place: r for r in records.library_saves(rows, spark.createDataFrame([(stem + "-2",)], "name string")).collect()}
    assert [got[i].name for i in range(1, 7)] == [stem, stem + "-3", None, None, None, stem + "-4"]
    errors = [got[i].error for i in range(1, 7)]
    assert errors[0] is errors[1] is errors[5] is None and errors[2] == "the library entry needs a label" and errors[4] == "invalid profile JSON"
    assert errors[3] == "the reference does not belong to this profile: its digest is cc, the profile was derived from bb"
    entry = json.loads(got[1].entry)
    assert entry["capture"] == {"make": "line\none", "model": None, "lens": None, "iso": 100, "date-time": None, "gps": {"latitude": 1.0, "longitude": -2.5, "altitude": None}}
    assert entry["profile-digest"] == sealed.digest and entry["label"] == "Zoo" and json.loads(got[2].entry)["capture"]["gps"] is None
