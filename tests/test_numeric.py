"""Column solvers, the generator's jumps, lookup tables as arrays, stencils on tiles, and batches of files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintframe.functions.linear import eliminated
from tintframe.operators import apply, blobs, calibration, components, interchange, stencil
from tintframe.operators.contract import SETTINGS


def solved(spark, system, least=1e-14):
    n = len(system)
    df = spark.createDataFrame([(system,)], "m array<array<double>>")
    return df.select(eliminated(F.col("m"), n, least).alias("x")).first().x


@pytest.mark.parametrize("n,sides", [(1, 1), (3, 3), (4, 2)])
def test_elimination(spark, n, sides):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(n, n)), rng.normal(size=(n, sides))
    a[0, 0] = 0.0 if n > 1 else 2.0  # a row must go up
    got = solved(spark, np.hstack([a, b]).tolist())
    assert np.allclose(got, np.linalg.solve(a, b))


def test_elimination_refuses_small_pivots(spark):
    near = lambda e: [[1.0, 1.0, 0.0, 1.0], [1.0, 1.0 + e, 0.0, 2.0], [0.0, 0.0, 1.0, 3.0]]
    assert solved(spark, near(1e-12)) is not None and solved(spark, near(1e-15)) is None
    assert solved(spark, near(1e-12), 1e-9) is None
    assert solved(spark, [[0.0, 0.0], [0.0, 0.0]]) is None and solved(spark, [[float("nan"), 1.0]]) is None


def test_generator_jumps():
    state, want = interchange.PROBE_SEED, []
    for _ in range(3000):
        state = (state * interchange.MULTIPLIER + interchange.INCREMENT) % 2**64
        want.append(state)
    assert interchange.lcg_states(range(1, 3001)).tolist() == want
    far = interchange.lcg_states([2**40, 2**40 + 1]).tolist()
    assert far[1] == (far[0] * interchange.MULTIPLIER + interchange.INCREMENT) % 2**64


def test_probes_and_mild_cube(spark):
    stages = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0, 0.9, 0.05, 0.05, 0.05, 0.9, 0.05, 0.05, 0.05, 0.9)], "frame int, " + ", ".join(f"{c} double" for c in calibration.STAGES))
    rows = spark.range(1000).repartition(7).select(F.lit(0).alias("frame"), F.col("id").alias("probe"))
    probes = interchange.lcg_probes(rows, "probe")
    first = probes.orderBy("probe").limit(1000).collect()
    state, unit = interchange.PROBE_SEED, []
    for _ in range(3000):
        state = (state * interchange.MULTIPLIER + interchange.INCREMENT) % 2**64
        unit.append(state / (2**64 - 1))
    assert np.allclose([[r.r, r.g, r.b] for r in first], np.array(unit).reshape(-1, 3), atol=0, rtol=1e-15)
    errors = {n: interchange.cube_error(probes, stages, n).first().max_error for n in (17, 33)}
    assert errors[33] < 5e-3 and errors[33] <= errors[17] * 1.1 + 1e-12


def test_lookup_has_no_exchange_above_the_probes(spark):
    stages = spark.createDataFrame([(0, *([1.0] * 4), *([0.3] * 9))], "frame int, " + ", ".join(f"{c} double" for c in calibration.STAGES))
    probes = spark.range(100).select(F.lit(0).alias("frame"), F.col("id").alias("probe"), *((F.col("id") / 99.0).alias(c) for c in "rgb"))
    out = interchange.trilinear(probes, interchange.lut_arrays(stages, 5), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and " Exchange hashpartitioning" not in plan
    assert all(abs(r.lut_r - min(0.9 * r.r, 1)) < 1e-9 for r in out.filter("r < 0.9").collect())


def demosaic(raw):
    """The rule by plain loops: reflected neighbours, colour differences, votes."""
    h, w = raw.shape
    colour = lambda y, x: "RGGB"[y % 2 * 2 + x % 2]

    def at(y, x, dy, dx):
        for sy, sx in ((dy, dx), (-dy, -dx)):
            if 0 <= y + sy < h and 0 <= x + sx < w:
                return y + sy, x + sx
        target = "RGGB"[(y % 2 ^ abs(dy) % 2) * 2 + (x % 2 ^ abs(dx) % 2)]
        for r in (0, 1, 2):
            for ny in range(max(y - r, 0), min(y + r, h - 1) + 1):
                for nx in range(max(x - r, 0), min(x + r, w - 1) + 1):
                    if colour(ny, nx) == target:
                        return ny, nx
        return y, x

    images = []
    for dy, dx in ((0, 1), (1, 0)):
        green = np.zeros((h, w))
        for y in range(h):
            for x in range(w):
                near = lambda k: raw[at(y, x, k * dy, k * dx)]  # noqa: B023, E731
                green[y, x] = raw[y, x] if colour(y, x) == "G" else (near(1) + near(-1)) / 2 + (2 * raw[y, x] - near(2) - near(-2)) / 4
        rgb = np.zeros((h, w, 3))
        for y in range(h):
            for x in range(w):
                rgb[y, x, 1] = green[y, x]
                for c, wanted in ((0, "R"), (2, "B")):
                    if colour(y, x) == wanted:
                        rgb[y, x, c] = raw[y, x]
                        continue
                    if colour(y, x) == "G":
                        steps = ((0, -1), (0, 1)) if colour(y, x ^ 1) == wanted else ((-1, 0), (1, 0))
                    else:
                        steps = ((-1, -1), (1, -1), (-1, 1), (1, 1))
                    found = [at(y, x, *s) for s in steps]
                    rgb[y, x, c] = green[y, x] + np.mean([raw[p] - green[p] for p in found])
        images.append(rgb)
    return images


@pytest.mark.parametrize("shape,tile", [((3, 3), 256), ((7, 10), 4), ((12, 5), 5)])
def test_directional_colours(spark, shape, tile):
    raw = np.random.default_rng(shape[1]).random(shape)
    sites = spark.createDataFrame([(0, y, x, float(raw[y, x])) for y in range(shape[0]) for x in range(shape[1])], "frame int, y int, x int, value double")
    got = stencil.demosaicked(sites, tile=tile).collect()
    assert len(got) == raw.size
    want = demosaic(raw)
    for r in got:
        for d, image in zip("hv", want):
            assert np.allclose([r[f"{c}_{d}"] for c in "rgb"], image[r.y, r.x]), (r.y, r.x, d)
        best = r.score_h - r.score_v
        mean = want[0][r.y, r.x] if best > 0 else want[1][r.y, r.x] if best < 0 else (want[0] + want[1])[r.y, r.x] / 2
        assert np.allclose([r.r, r.g, r.b], mean) and 0 <= r.vote_h <= 4 and r.score_h <= 36


def test_bad_pattern():
    with pytest.raises(ValueError, match="Bayer"):
        stencil.cfa_colour("RRGB")


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    pairs = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    low = {n: n for p in pairs for n in p}
    for _ in low:
        for u, v in pairs:
            low[u] = low[v] = min(low[u], low[v])
    assert {n: found.get(n, n) for n in low} == low


def test_blobs_groups_and_lattice(spark):
    """A chart with missing patches is found where it is, whatever the level; a scene of other squares is not."""
    px = []
    for y in range(48):
        for x in range(64):
            u, v = x - 5, y - 6
            inside = 0 <= u < 54 and 0 <= v < 36 and u % 9 < 7 and v % 9 < 7 and (u // 9, v // 9) not in ((2, 1), (3, 2))
            px.append((1, y, x, 0.5 if inside else 0.01))
            px.append((2, y, x, 0.5 if 3 < x < 12 and 3 < y < 12 else 0.01))
    light = spark.createDataFrame(px, "frame int, y int, x int, light double")
    sizes = spark.createDataFrame([(1, 64, 48), (2, 64, 48)], "frame int, width int, height int")
    found = blobs.blobs(light, sizes, (0.1, 0.3))
    assert {(r.frame, r.level): r["count"] for r in found.groupBy("frame", "level").count().collect()} == {(1, 0.1): 22, (1, 0.3): 22, (2, 0.1): 1, (2, 0.3): 1}
    rows = blobs.lattices(blobs.groups(found)).collect()
    assert sorted(r.level for r in rows) == [0.1, 0.3] and {r.frame for r in rows} == {1}
    for r in rows:
        assert r.pitch == 9 and r.coherence == pytest.approx(1)
        corners = sorted((round(r[f"x{i}"], 6), round(r[f"y{i}"], 6)) for i in range(4))
        assert corners == [(4.0, 5.0), (4.0, 41.0), (58.0, 5.0), (58.0, 41.0)]


def test_batches_fail_by_file_and_go_on(spark, tmp_path):
    profile = {"make": "A", "model": "M", "decoder": "d", "version": "1"} | dict.fromkeys(SETTINGS, "s")
    fine = {"decode_error": None, **profile}
    changes = [{}, {"decode_error": "short"}, {"make": "B"}, {"gamma": "t"}, {"version": "2"}, {}, {}, {}]
    names = ["a.dng", "b.dng", "c.dng", "d.dng", "e.dng", "none.dng", "nan.dng", "x/a.nef"]
    rows = [{"path": n, **fine, **c} for n, c in zip(names, changes)]
    files = spark.createDataFrame(rows, "path string, " + ", ".join(f"{c} string" for c in fine))
    px = spark.createDataFrame([(n, 0, i, float("nan") if n == "nan.dng" and i else 0.5, 2.0 if n == "e.dng" else 0.5, 0.5) for n in names if n != "none.dng" for i in range(3)], "path string, y int, x int, r double, g double, b double")
    stages = dict(zip(calibration.STAGES, [1.0] * 4 + [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]))
    folder = str(tmp_path / "out")
    codes, results = apply.apply_batch(files, px, stages, profile, apply.published(spark, folder))
    got = {r.path: (r.output, r.status, r.error, r.warning, r.pixels, r.clipped) for r in results.collect()}
    assert got == {
        "a.dng": ("a.tiff", "written", None, None, 3, 0),
        "b.dng": ("b.tiff", "failed", "decode failed: short", None, None, None),
        "c.dng": ("c.tiff", "failed", "camera mismatch (profile: A M, image: B M)", None, None, None),
        "d.dng": ("d.tiff", "failed", "decode contract differs: settings", None, None, None),
        "e.dng": ("e.tiff", "written", None, "decode contract differs: version", 3, 3),
        "none.dng": ("none.tiff", "failed", "export failed: no pixels", None, None, None),
        "nan.dng": ("nan.tiff", "failed", "export failed: a pixel is not a number", None, None, None),
        "x/a.nef": ("a-1.tiff", "written", None, None, 3, 0),
    }
    assert sorted({r.output for r in codes.collect()}) == ["a-1.tiff", "a.tiff", "e.tiff"] and codes.count() == 9
    apply.publish(codes, results, folder)
    mended = files.withColumn("decode_error", F.lit(None).cast("string"))
    codes, results = apply.apply_batch(mended, px, stages, profile, apply.published(spark, folder), force=True)
    status = {r.path: (r.status, r.warning) for r in results.collect()}
    assert status["a.dng"] == ("skipped", None) and status["b.dng"] == ("written", None) and status["d.dng"] == ("written", "forced decode-contract mismatch: settings")
    apply.publish(codes, results, folder)
    assert sorted(r.output for r in apply.published(spark, folder).collect()) == ["a-1.tiff", "a.tiff", "b.tiff", "c.tiff", "d.tiff", "e.tiff"]
    again = spark.createDataFrame([("a.tiff",)], "output string")
    own = spark.createDataFrame([{"path": "a.dng", **fine}, {"path": "a.tiff", **fine}], files.schema)
    assert apply.outcomes(own, profile, again, overwrite=True).filter("path = 'a.dng'").first().error == "output path is a selected input file"
