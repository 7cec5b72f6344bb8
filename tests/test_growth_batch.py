"""A batch's pixels are corrected and encoded once, for its facts and its codes."""

from pyspark.sql import functions as F

from tintframe.operators import apply, calibration, contract


def test_pixels_are_encoded_once(spark):
    profile = {"make": "A", "model": "B", "decoder": "d", "version": "1"} | dict.fromkeys(contract.SETTINGS, "s")
    files = spark.createDataFrame([("x/a.dng",), ("x/b.dng",)], "path string").withColumns({k: F.lit(v) for k, v in profile.items()} | {"decode_error": F.lit(None).cast("string")})
    px = spark.createDataFrame([(p, i, v, v, v) for p in ("x/a.dng", "x/b.dng") for i, v in enumerate((0.25, 0.5))], "path string, i int, r double, g double, b double")
    stages = {s: 1.0 if s in ("exposure", "c_r", "c_g", "c_b", "m00", "m11", "m22") else 0.0 for s in calibration.STAGES}
    codes, results = apply.apply_batch(files, px, stages, profile, spark.createDataFrame([], "output string"), places=9)
    assert {(r.output, r.status, r.pixels) for r in results.collect()} == {("a.tiff", "written", 2), ("b.tiff", "written", 2)}
    assert codes.count() == 4 and {"output", "i", *apply.CODES} <= set(codes.columns) and "r" not in codes.columns
    read = codes.inputFiles()
    assert read and any("/coded-" in f for f in read)
