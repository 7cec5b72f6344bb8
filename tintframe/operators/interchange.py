"""Interchange forms of fitted stages: LUT nodes and trilinear lookup, their error, and DCP matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colour import BRADFORD_D65_TO_D50, D50_XYZ, RGB_TO_XYZ, clamp01, column_inverse, column_product
from ..sources.shared import small, written
from .calibration import corrected

OUT = ("out_r", "out_g", "out_b")


def cube_nodes(stages: DataFrame, size: int) -> DataFrame:
    """frame, node, r_i, g_i, b_i and the clamped output of each of size^3 nodes, red fastest."""
    step = float(max(size - 1, 1))
    nodes = stages.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(size**3 - 1))))
    at = {"r_i": F.col("node") % size, "g_i": F.expr(f"node div {size}").cast("int") % size, "b_i": F.expr(f"node div {size * size}").cast("int")}
    nodes = nodes.withColumns(at).withColumns({f"in_{c}": F.col(f"{c}_i") / step for c in "rgb"})
    out = corrected(nodes, ("in_r", "in_g", "in_b"))
    return out.select("frame", "node", *at, *(clamp01(F.col(o)).alias(o) for o in OUT))


#: Nodes of all frames, in bytes, up to which they are sent to the probes; beyond it both sides are shuffled by frame.
NODE_BYTES = 64 << 20


def lut_arrays(stages: DataFrame, size: int) -> DataFrame:
    """frame and lut: the clamped outputs of all size^3 nodes in one array, three numbers a node, red fastest. A frame's array is made of its own row."""
    step = float(max(size - 1, 1))
    n = F.lit(size)

    def node(i):
        at = (i % n, F.floor(i / n).cast("int") % n, F.floor(i / (n * n)).cast("int"))
        v = [a / step / F.nullif(F.col("exposure") * F.col(c), F.lit(0.0)) for a, c in zip(at, ("c_r", "c_g", "c_b"), strict=True)]
        return F.array(*(clamp01(v[0] * F.col(f"m0{j}") + v[1] * F.col(f"m1{j}") + v[2] * F.col(f"m2{j}")) for j in range(3)))

    return stages.select("frame", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size**3 - 1)), node)).alias("lut"))


def trilinear(probes: DataFrame, luts: DataFrame, size: int) -> DataFrame:
    """``probes`` (frame, probe, r, g, b in 0..1) with lut_r, lut_g, lut_b: eight reads of the frame's array (``lut_arrays``) and their weights, a
    row at a time. Probes meet their array without an exchange of their own where the arrays are few enough to be sent to them."""
    luts = written(luts, "luts")
    few = luts.count() * size**3 * 24 <= NODE_BYTES
    cells = probes
    for c in "rgb":
        pos = F.col(c) * (size - 1)
        low = F.greatest(F.least(F.floor(pos).cast("int"), F.lit(size - 2)), F.lit(0))
        cells = cells.withColumns({f"_{c}": low, f"_{c}t": pos - low})
    met = cells.join(F.broadcast(luts) if few else luts, "frame").withColumn("_at", (F.col("_b") * size + F.col("_g")) * size + F.col("_r"))

    def looked(k: int):
        def mix(a, b, c: str):
            return a * (1 - F.col(f"_{c}t")) + b * F.col(f"_{c}t")

        read = lambda r, g, b: F.get("lut", (F.col("_at") + ((b * size + g) * size + r)) * 3 + k)
        edge = [[mix(read(0, g, b), read(1, g, b), "r") for g in (0, 1)] for b in (0, 1)]
        return mix(mix(edge[0][0], edge[0][1], "g"), mix(edge[1][0], edge[1][1], "g"), "b")

    out = met.withColumns({f"lut_{c}": looked(k) for k, c in enumerate("rgb")})
    return out.drop("lut", "_at", *(f"_{c}{t}" for c in "rgb" for t in ("", "t")))


def cube_error(probes: DataFrame, stages: DataFrame, size: int) -> DataFrame:
    """Per frame the largest component error of the LUT against the stages themselves; both are one row a frame."""
    stages = written(stages, "stages")
    direct = corrected(trilinear(probes, lut_arrays(stages, size), size).join(small(stages), "frame"), ("r", "g", "b"))
    worst = F.greatest(*(F.abs(F.col(f"lut_{c}") - clamp01(F.col(f"out_{c}"))) for c in "rgb"))
    return direct.groupBy("frame").agg(F.max(worst).alias("max_error"))


# The generator of probes, its multiplier and increment (Knuth's), and the seed.
MULTIPLIER, INCREMENT, PROBE_SEED = 6364136223846793005, 1442695040888963407, 0x5EED


def lcg_states(steps, seed: int = PROBE_SEED):
    """The generator's states (uint64) after ``steps`` steps each, by jumps: powers of two of the map x -> a x + c are maps of that form too, so any
    step is reached by as many of them as it has bits."""
    import numpy as np

    steps = np.asarray(steps, dtype=np.uint64)
    out, a, c = np.full(steps.shape, seed, dtype=np.uint64), MULTIPLIER, INCREMENT
    for bit in range(64):
        on = (steps >> np.uint64(bit)) & np.uint64(1) == 1
        if not (steps >> np.uint64(bit)).any():
            break
        out[on] = out[on] * np.uint64(a) + np.uint64(c)
        a, c = a * a % 2**64, (a * c + c) % 2**64
    return out


def lcg_probes(rows: DataFrame, index: str, seed: int = PROBE_SEED) -> DataFrame:
    """``rows`` with r, g, b in 0..1: the draws 3 i, 3 i + 1 and 3 i + 2 of the generator for the whole number i (from 0) in ``index``. Each row is
    drawn on its own, whatever partition it is in; a null index gives nulls."""

    @F.pandas_udf("r double, g double, b double")
    def drawn(at):
        import numpy as np
        import pandas as pd

        first = at.fillna(0).to_numpy(dtype=np.uint64) * np.uint64(3)
        known = at.notna().to_numpy()
        unit = {c: np.where(known, lcg_states(first + np.uint64(k + 1), seed) / float(2**64 - 1), np.nan) for k, c in enumerate("rgb")}
        return pd.DataFrame(unit)

    return rows.withColumn("_drawn", drawn(F.col(index).cast("long"))).select(*rows.columns, *(F.col("_drawn")[c].alias(c) for c in "rgb"))


def dcp_matrices(stages: DataFrame) -> DataFrame:
    """Per frame the forward matrix f00..f22, colour matrix k00..k22 and the exposure offset in stops; nulls where the model is
    singular or maps no positive neutral to the D50 white."""
    import numpy as np

    to_d50 = (np.array(BRADFORD_D65_TO_D50) @ np.array(RGB_TO_XYZ)).tolist()
    s = [F.col("exposure") * F.col(c) for c in ("c_r", "c_g", "c_b")]
    model = {f"t{i}{j}": sum((to_d50[i][k] * F.col(f"m{j}{k}") for k in (1, 2)), to_d50[i][0] * F.col(f"m{j}0")) / F.when(s[j] > 0, s[j]) for i in range(3) for j in range(3)}
    df = stages.withColumns(model)
    grid = lambda p: [[F.col(f"{p}{i}{j}") for j in range(3)] for i in range(3)]
    inverse = column_inverse(grid("t"))
    df = df.withColumns(dict(zip(("w0", "w1", "w2"), column_product(inverse, tuple(map(F.lit, D50_XYZ))), strict=True)))
    good = (F.least("w0", "w1", "w2") > 0) & F.least("w0", "w1", "w2").isNotNull()
    top = F.greatest("w0", "w1", "w2")
    df = df.withColumns({f"f{i}{j}": F.when(good, F.col(f"t{i}{j}") * F.col(f"w{j}")) for i in range(3) for j in range(3)})
    back = column_inverse(grid("f"))
    df = df.withColumns({f"k{i}{j}": F.col(f"w{i}") / top * back[i][j] for i in range(3) for j in range(3)})
    return df.withColumn("exposure_offset", F.when(good, -F.log2(top))).select(
        "frame", *(f"{p}{i}{j}" for p in "fk" for i in range(3) for j in range(3)), "exposure_offset"
    )


def thumbnail_pixels(pixels: DataFrame, width: int, height: int, most: int = 512) -> DataFrame:
    """The pixels (x, y) nearest to the centres of a thumbnail of ``most`` pixels a side at most, with their place there, tx and ty."""
    scale = max(1.0, max(width, height) / most)
    spark = pixels.sparkSession
    for axis, size in (("x", width), ("y", height)):
        n = max(1, int(size / scale + 0.5))
        source = F.least(F.floor((F.col("id") + 0.5) * size / n), F.lit(size - 1)).cast("int")
        picked = spark.range(n).select(source.alias(axis), F.col("id").cast("int").alias(f"t{axis}"))
        pixels = pixels.join(F.broadcast(picked), axis)
    return pixels
