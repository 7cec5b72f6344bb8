"""Colour models against refits by hand, free names, the metadata budget, chart and fit errors, and spaces on made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.operators import acceptance, batch, calibration, models, transform
from tintframe.sources.chart import PATCHES, chart_reference


@pytest.mark.parametrize("model", models.MODELS)
@pytest.mark.parametrize("rows", [24, 9, 3])
def test_left_out_equals_a_refit(model, rows):
    rng = np.random.default_rng(rows)
    rgb, t = rng.uniform(0.02, 1, (rows, 3)), rng.uniform(0, 1, (rows, 3))
    a = models.terms(model, rgb)
    got = models.left_out(a, t)
    for i in range(rows):
        rest = np.arange(rows) != i
        want = a[i] @ np.linalg.lstsq(a[rest], t[rest], rcond=None)[0]
        np.testing.assert_allclose(got[i], want, rtol=1e-6, atol=1e-6)


def test_left_out_of_repeated_and_single_rows():
    a = np.ones((4, 3))
    t = np.arange(12.0).reshape(4, 3)
    np.testing.assert_allclose(models.left_out(a, t)[0], t[1:].mean(axis=0))
    assert np.isnan(models.left_out(a[:1], t[:1])).all()


def samples(spark, rows):
    schema = "frame int, patch_idx int, mean_r double, mean_g double, mean_b double"
    return spark.createDataFrame(rows, schema)


def test_linear_model_of_a_linear_camera_is_exact(spark):
    ref = chart_reference(spark)
    m = [[0.9, 0.1, 0.02], [0.05, 0.8, 0.1], [0.01, 0.1, 0.7]]
    seen = ref.select(F.lit(1).alias("frame"), "patch_idx", *(sum(F.col(f"t_{c}") * m[j][i] for j, c in enumerate("rgb")).alias(f"mean_{x}") for i, x in enumerate("rgb")))
    got = {r.model: r for r in models.comparison(models.scored(models.predictions(seen, ref), ref)).collect()}
    assert set(got) == set(models.MODELS)
    assert got["linear"].max_delta_e < 1e-6
    assert models.predictions(seen.filter("false"), ref).count() == 0


def test_fit_errors(spark):
    ref = chart_reference(spark)
    colour = {r.patch_idx: (r.t_r, r.t_g, r.t_b) for r in ref.collect()}
    rows = [(1, p, *colour[p]) for p in colour]
    rows += [(2, p, *colour[p]) for p in (18, 19)]
    rows += [(3, p, *colour[p]) for p in range(18)]
    rows += [(4, p, 0.0, *colour[p][1:]) for p in colour]
    rows += [(5, p, *colour[p % 24]) for p in (18, 19, 20, 24)]
    rows += [(6, p, None, *colour[p][1:]) for p in colour]
    got = dict(calibration.fit_errors(samples(spark, rows), ref).select("frame", "error").collect())
    few, singular = "insufficient patches", "singular matrix"
    assert got == {1: None, 2: few, 3: few, 4: singular, 5: few, 6: singular}


def test_budget_skips_cost_nothing(spark):
    rows = [("f", 1, "exif", 1, 50), ("f", 2, "exif", 2, 90), ("f", 3, "exif", 1, 1), ("f", 4, "gps", 1, 1), ("f", 5, "gps", 2, 1), ("g", 1, "exif", 1, 200)]
    entries = spark.createDataFrame(rows, "file string, ord int, directory string, tag int, size int")
    got = {(r.file, r.ord): r.status for r in acceptance.within_budget(entries, 100).collect()}
    # 100 - 64 leaves 36, which two least entries of 18 use up
    assert got == {("f", 1): "copied", ("f", 2): "too large", ("f", 3): "duplicate", ("f", 4): "copied", ("f", 5): "copied", ("g", 1): "too large"}
    assert acceptance.within_budget(entries.filter("false")).count() == 0


def test_chart_errors(spark):
    expected = spark.createDataFrame(list(enumerate(PATCHES)), "patch_idx int, patch string")
    fine = tuple(v for _, v in acceptance.CHART_FACTS)
    sets = spark.createDataFrame([(1, *fine), (2, *fine[:-1], None), (3, *fine), (4, *fine), (5, *fine)], "dataset int, " + ", ".join(f"{c} string" for c, _ in acceptance.CHART_FACTS))
    rows = [(d, i, p, "label", 0.3, 0.3, None if (d, i) == (4, 7) else 0.2) for d in (1, 2, 4, 5) for i, p in enumerate(PATCHES)]
    rows = [(d, 99, *r) if (d, i) == (5, 23) else (d, i, *r) for d, i, *r in rows]
    patches = spark.createDataFrame(rows, "dataset int, patch_idx int, patch string, label string, x double, y double, big_y double")
    got = dict(acceptance.chart_errors(sets, patches, expected).collect())
    assert got == {1: None, 2: "white must be D65, found none", 3: "24 patches expected, found 0", 4: "patch 7 is not finite", 5: "patch 99 must be absent"}


def test_unknown_spaces_have_no_default(spark):
    asked = spark.createDataFrame([("srgb",), ("SRGB",), (None,)], "space string")
    got = {r.space: (r.label, r.error) for r in transform.resolved_spaces(asked, transform.output_spaces(spark)).collect()}
    assert got == {"srgb": ("sRGB", None), "SRGB": (None, "unknown output space: SRGB"), None: (None, "unknown output space: ")}
