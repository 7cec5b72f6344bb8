"""Bright patches that lie in several tiles are the same as those of whole images."""

import numpy as np

from tintframe.operators import blobs


def test_blobs_across_tiles(spark):
    rng = np.random.default_rng(3)
    image = np.full((60, 70), 0.01)
    for _ in range(14):
        y, x = rng.integers(1, 52), rng.integers(1, 62)
        image[y : y + rng.integers(5, 8), x : x + rng.integers(5, 8)] = rng.choice([0.2, 0.5])
    px = [(1, y, x, float(image[y, x])) for y in range(60) for x in range(70)]
    light = spark.createDataFrame(px, "frame int, y int, x int, light double")
    sizes = spark.createDataFrame([(1, 70, 60)], "frame int, width int, height int")
    whole, cut = (sorted(map(tuple, blobs.blobs(light, sizes, (0.1, 0.3), tile=tile).collect())) for tile in (256, 7))
    assert whole == cut and len(whole) > 4
