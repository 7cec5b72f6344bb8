"""Chart calibration: patch statistics, quality gates, fitted stages, and their validation. Everything groups by ``frame``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import (
    chroma_proxy,
    clipped_channels,
    col3,
    column_inverse,
    infinity_norm,
    linear_srgb_to_xyz,
    luminance,
    row_product,
    with_delta_e,
    xyz_d65_to_lab,
)
from ..functions.linear import eliminated
from ..functions.text import fixed

MEAN = ("mean_r", "mean_g", "mean_b")
VARIANCE = ("var_r", "var_g", "var_b")
STAGES = ["exposure", "c_r", "c_g", "c_b", *(f"m{i}{j}" for i in range(3) for j in range(3))]


@dataclass(frozen=True)
class GateConfig:
    min_patch_pixels: int = 64
    max_cv: float = 0.05
    cv_mean_floor: float = 0.01
    require_neutral_row: bool = True


RELAXED = GateConfig(min_patch_pixels=16, max_cv=0.25, require_neutral_row=False)


def patch_samples(pixels: DataFrame) -> DataFrame:
    """frame, patch_idx, means, population variances, the union of clip masks and the pixel count; one shuffle with partial sums."""
    stats = [F.avg(c).alias(m) for c, m in zip("rgb", MEAN, strict=True)] + [F.var_pop(c).alias(v) for c, v in zip("rgb", VARIANCE, strict=True)]
    return pixels.groupBy("frame", "patch_idx").agg(*stats, F.bit_or("clip").alias("clip"), F.count("*").alias("n"))


def gate_failures(samples: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """frame, ord, patch_idx, reason, measured: the failed checks of each frame in order; none for a frame that passes.

    A frame without exactly 24 patches fails that check alone. The chart-wide checks come last, with a null patch.
    """
    cfg = config
    per_frame = Window.partitionBy("frame")
    rows = samples.withColumns({"patches": F.count("*").over(per_frame), "lum": luminance(col3(*MEAN)), "chroma": chroma_proxy(col3(*MEAN))})
    whole = rows.filter("patches = 24")
    checks = [
        (0, F.col("clip") != 0, F.concat(F.lit("clipped channels: "), clipped_channels(F.col("clip"))), F.format_string("0x%02x", "clip")),
        (1, F.col("n") < cfg.min_patch_pixels, F.lit("insufficient patch pixels"), F.col("n").cast("string")),
    ]
    for k, (m, v) in enumerate(zip(MEAN, VARIANCE, strict=True)):
        cv = F.sqrt(v) / F.greatest(F.col(m), F.lit(cfg.cv_mean_floor))
        checks.append((2 + k, ~F.isnan(cv) & (cv > cfg.max_cv), F.lit(f"channel {k} coefficient of variation"), F.concat(F.lit("cv="), fixed(cv, 6))))
    found = F.array(*(F.when(bad, F.struct(F.lit(o).alias("ord"), r.alias("reason"), m.alias("measured"))) for o, bad, r, m in checks))
    patches = whole.select("frame", "patch_idx", F.explode(F.array_compact(found)).alias("f")).select(
        "frame", (F.col("patch_idx") * 8 + F.col("f.ord")).alias("ord"), "patch_idx", "f.reason", "f.measured"
    )
    wrong = rows.filter("patches <> 24").select(
        "frame", F.lit(0).alias("ord"), F.lit(None).cast("int").alias("patch_idx"), F.lit("wrong patch count").alias("reason"), F.col("patches").cast("string").alias("measured")
    ).distinct()
    out = patches.unionByName(wrong)
    if cfg.require_neutral_row:
        before = F.lag("lum").over(per_frame.orderBy("patch_idx"))
        rising = whole.filter("patch_idx >= 18").withColumn("up", before <= F.col("lum"))
        last, first = F.col("patch_idx") >= 18, F.col("patch_idx") < 18
        reversed_ = rising.groupBy("frame").agg(F.bool_or(F.coalesce("up", F.lit(False))).alias("up")).filter("up")
        chroma = whole.groupBy("frame").agg(
            F.greatest(F.coalesce(F.max(F.when(last, F.col("chroma"))), F.lit(0.0)), F.lit(0.0)).alias("last"),
            F.greatest(F.coalesce(F.max(F.when(first, F.col("chroma"))), F.lit(0.0)), F.lit(0.0)).alias("first"),
        )
        none = F.lit(None).cast("int").alias("patch_idx")
        out = out.unionByName(
            reversed_.select(
                "frame", F.lit(1000).alias("ord"), none, F.lit("neutral row reversed; rotate corners").alias("reason"), F.lit("non-monotonic luminance").alias("measured")
            )
        ).unionByName(
            chroma.filter("last >= 0.25 or first <= 0.25").select(
                "frame",
                F.lit(1001).alias("ord"),
                none,
                F.lit("last row is not the neutral row; check corner order").alias("reason"),
                F.concat(F.lit("last-row-chroma="), fixed(F.col("last"), 6), F.lit(", preceding-chroma="), fixed(F.col("first"), 6)).alias("measured"),
            )
        )
    return out


def gate_warnings(failures: DataFrame) -> DataFrame:
    """frame and how many patches (the chart counts as one) failed by clipping, noise and other checks, and whether the layout did."""
    label = F.coalesce(F.col("patch_idx"), F.lit(-1))
    clipped, noisy = F.col("reason").startswith("clipped"), F.col("reason").contains("coefficient of variation")
    layout = F.col("reason").startswith("last row is not the neutral row")
    count = lambda c: F.count_distinct(F.when(c, label))
    return failures.groupBy("frame").agg(
        count(clipped).alias("clipped"),
        count(noisy).alias("noisy"),
        F.bool_or(layout).alias("layout"),
        count(~clipped & ~noisy & ~layout).alias("other"),
    )


def with_targets(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """Samples with their patch's reference columns; the reference is 24 rows."""
    return samples.join(F.broadcast(reference), "patch_idx")


def exposure_and_channels(joined: DataFrame) -> DataFrame:
    """frame, exposure, c_r, c_g, c_b: medians over the neutral patches of mean over target luminance."""
    neutral = joined.filter("is_neutral").select(
        "frame", *MEAN, luminance(col3(*MEAN)).alias("lum"), F.greatest(luminance(col3("t_r", "t_g", "t_b")), F.lit(1e-12)).alias("target")
    )
    exposure = neutral.groupBy("frame").agg(F.median(F.col("lum") / F.col("target")).alias("exposure"))
    ratio = lambda m: F.median(F.col(m) / F.greatest(F.col("exposure") * F.col("target"), F.lit(1e-12)))
    channels = neutral.join(exposure, "frame").groupBy("frame").agg(
        F.first("exposure").alias("exposure"), *(ratio(m).alias(c) for m, c in zip(MEAN, ("c_r", "c_g", "c_b"), strict=True))
    )
    return channels


#: A pivot below this makes a fit singular.
SINGULAR = 1e-14


def normal_equations(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` the least-squares matrix m00..m22 that maps normalised means to targets: 15 sums, then elimination with row pivots in columns. A
    system with a pivot below ``SINGULAR`` gives nulls."""
    n = [F.col(m) / F.nullif(F.col("exposure") * F.col(c), F.lit(0.0)) for m, c in zip(MEAN, ("c_r", "c_g", "c_b"), strict=True)]
    t = [F.col(c) for c in ("t_r", "t_g", "t_b")]
    sums = [F.sum(n[i] * n[j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.sum(n[i] * t[j]).alias(f"b{i}{j}") for i in range(3) for j in range(3)]
    keep = [F.first(c).alias(c) for c in ("exposure", "c_r", "c_g", "c_b")]
    system = F.array(*(F.array(*(F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)), *(F.col(f"b{i}{j}") for j in range(3))) for i in range(3)))
    solved = joined.groupBy(*keys).agg(*keep, *sums).withColumn("solved", eliminated(system, 3, SINGULAR))
    return solved.withColumns({f"m{i}{j}": F.col("solved")[i][j] for i in range(3) for j in range(3)}).select(*keys, *STAGES)


def failure_categories(failures: DataFrame) -> DataFrame:
    """frame, category, n: failed checks by kind."""
    reason = F.col("reason")
    category = (
        F.when(reason.startswith("clipped"), "clipped")
        .when(reason.contains("coefficient of variation"), "noisy")
        .when(reason.startswith("last row is not the neutral row"), "orientation")
        .otherwise("other")
    )
    return failures.groupBy("frame", category.alias("category")).agg(F.count("*").alias("n"))


def preset_failures(samples: DataFrame, rendered: Column) -> DataFrame:
    """Failed checks of each frame under its source's thresholds: relaxed ones for rendered images alone. Both read ``samples``."""
    return gate_failures(samples.filter(rendered), RELAXED).unionByName(gate_failures(samples.filter(~rendered)))


def fit_errors(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """frame, error: why a frame can't be fitted, or null. A patch that the reference lacks, fewer than three samples, no neutral ones: ``insufficient
    patches``; scales not finite or below 1e-12, or a matrix without an inverse: ``singular matrix``."""
    facts = samples.join(F.broadcast(reference.select("patch_idx", "is_neutral")), "patch_idx", "left").groupBy("frame").agg(
        F.count("*").alias("n"), F.count_if(F.col("is_neutral")).alias("neutral"), F.count_if(F.col("is_neutral").isNull()).alias("foreign")
    )
    lost = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    bad = lost("exposure")
    for c in ("c_r", "c_g", "c_b"):
        bad = bad | lost(c) | (F.abs(c) < 1e-12)
    singular = bad
    for c in STAGES[4:]:
        singular = singular | lost(c)
    few = (F.col("foreign") > 0) | (F.col("n") < 3) | (F.col("neutral") == 0)
    return facts.join(fit(samples, reference), "frame", "left").select("frame", F.when(few, "insufficient patches").when(singular, "singular matrix").alias("error"))


def fit(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """One row per frame: exposure, channel scales and the row-vector matrix m00..m22."""
    joined = with_targets(samples, reference)
    return normal_equations(joined.join(exposure_and_channels(joined), "frame"), ["frame"])


def corrected(rows: DataFrame, colour: tuple[str, str, str] = MEAN) -> DataFrame:
    """``rows`` with out_r, out_g, out_b: the stages applied, without a clamp."""
    n = tuple(F.col(m) / F.nullif(F.col("exposure") * F.col(c), F.lit(0.0)) for m, c in zip(colour, ("c_r", "c_g", "c_b"), strict=True))
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    return rows.withColumns(dict(zip(("out_r", "out_g", "out_b"), row_product(n, m), strict=True)))


def validate(samples: DataFrame, reference: DataFrame, stages: DataFrame, keys: list[str] = ["frame"]) -> DataFrame:  # noqa: B006
    """Per patch the corrected colour, its Lab, and its difference from the target."""
    rows = corrected(with_targets(samples, reference).join(stages, keys))
    lab = xyz_d65_to_lab(tuple(F.col(f"_{c}") for c in "xyz"))
    xyz = linear_srgb_to_xyz(col3("out_r", "out_g", "out_b"))
    rows = rows.withColumns(dict(zip(("_x", "_y", "_z"), xyz, strict=True))).withColumns(dict(zip(("lab_l", "lab_a", "lab_b"), lab, strict=True)))
    return with_delta_e(rows.drop("_x", "_y", "_z"), ("lab_l", "lab_a", "lab_b"), ("t_l", "t_a", "t_bb"), "delta_e")


def report(patches: DataFrame) -> DataFrame:
    """Per frame: mean, median, 95th percentile and largest difference, those of neutral and skin patches (0 where there
    are none), and the matrix's condition number."""
    m = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    condition = infinity_norm(m) * infinity_norm(column_inverse(m))
    rows = patches.withColumn("condition_number", condition)
    worst = lambda c: F.coalesce(F.max(F.when(F.col(c), F.col("delta_e"))), F.lit(0.0))
    return rows.groupBy("frame").agg(
        F.avg("delta_e").alias("mean_delta_e"),
        F.median("delta_e").alias("median_delta_e"),
        F.percentile("delta_e", 0.95).alias("p95_delta_e"),
        F.max("delta_e").alias("max_delta_e"),
        worst("is_neutral").alias("neutral_max_delta_e"),
        worst("is_skin").alias("skin_max_delta_e"),
        F.first("condition_number").alias("condition_number"),
        F.count("*").alias("patch_count"),
    )


def leave_one_out(samples: DataFrame, reference: DataFrame) -> DataFrame:
    """frame, held_out, delta_e: each patch scored by a fit to the other 23. The copies are 24 for each sample, which are few."""
    joined = with_targets(samples, reference).withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(23))))
    training = joined.filter("patch_idx <> held_out")
    scales = exposure_and_channels(training.withColumn("frame", F.struct("frame", "held_out")))
    scales = scales.withColumns({"held_out": F.col("frame.held_out"), "frame": F.col("frame.frame")})
    stages = normal_equations(training.join(scales, ["frame", "held_out"]), ["frame", "held_out"])
    tested = samples.withColumn("held_out", F.col("patch_idx"))
    return validate(tested, reference, stages, ["frame", "held_out"]).select("frame", "held_out", "delta_e")


def weakest(patches: DataFrame, k: int = 5) -> DataFrame:
    """The k patches of each frame with the largest difference, and each one's share of the worst."""
    by = Window.partitionBy("frame")
    return (
        patches.withColumns({"rank": F.row_number().over(by.orderBy(F.desc("delta_e"), "patch_idx")), "worst": F.max("delta_e").over(by)})
        .filter(F.col("rank") <= k)
        .withColumn("relative", F.col("delta_e") / F.greatest("worst", F.lit(1e-12)))
    )
