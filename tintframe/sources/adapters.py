"""Views of the driver's tables as engine relations. They are synthetic stand-ins, not photographs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chart import chart_reference


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chart_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of ten chart frames: frame, patch_idx, r, g, b, clip. Each line item is a pixel of patch l_partkey % 24 in frame
    l_suppkey % 10, seen by a camera with crosstalk, an exposure for each frame and noise from the other columns."""
    ref = chart_reference(spark).select("patch_idx", "t_r", "t_g", "t_b")
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).cast("int").alias("frame"),
        (F.col("l_partkey") % 24).cast("int").alias("patch_idx"),
        "l_discount",
        "l_tax",
        "l_quantity",
    )
    e = 0.60 + 0.03 * F.col("frame")
    k = F.when(F.col("frame").isin(7, 8), 3.0).otherwise(0.04)
    t_r, t_g, t_b = F.col("t_r"), F.col("t_g"), F.col("t_b")
    return li.join(F.broadcast(ref), "patch_idx").select(
        "frame",
        "patch_idx",
        (e * (0.90 * t_r + 0.06 * t_g + 0.02 * t_b) + k * (F.col("l_discount") - 0.05) * t_g).alias("r"),
        (e * (0.04 * t_r + 0.95 * t_g + 0.03 * t_b) + k * (F.col("l_tax") - 0.04) * t_g).alias("g"),
        (e * (0.01 * t_r + 0.07 * t_g + 0.88 * t_b) + k * (F.col("l_quantity") - 25.5) / 500 * t_b).alias("b"),
        F.when((F.col("frame") == 9) & (F.col("l_quantity") >= 50), 1).otherwise(0).alias("clip"),
    )


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct positions of a 480 x 320 image that line items hit: x, y."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 480).cast("int").alias("x"),
            ((F.col("l_partkey") * 11 + F.col("l_suppkey")) % 320).cast("int").alias("y"),
        )
        .distinct()
    )


def mosaic(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """Photosites of square mosaics by supplier % 10: frame, y, x, raw, saturated; one row a site."""
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            (F.col("l_suppkey") % 10).cast("int").alias("frame"),
            (F.col("l_orderkey") % side).cast("int").alias("y"),
            ((F.col("l_partkey") + 31 * F.col("l_linenumber")) % side).cast("int").alias("x"),
            (F.col("l_quantity") * 300).cast("int").alias("v"),
        )
        .groupBy("frame", "y", "x")
        .agg(F.max("v").alias("raw"))
        .withColumn("saturated", F.col("raw") >= 14_700)
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture facts of files, from events: path, source_kind, make, model, lens, iso, captured_at; several may be null."""
    ev = table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k").cast("int")
    nth = F.col("event_id")
    return ev.select(
        F.format_string("shoot/%d/img-%d.dng", F.col("user_id"), nth).alias("path"),
        F.when(nth % 13 == 0, F.lit(None)).when(nth % 3 == 0, F.lit("rendered")).otherwise(F.lit("raw")).alias("source_kind"),
        F.when(nth % 11 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("make"),
        F.when(nth % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string"))).alias("model"),
        F.when(nth % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("lens "), (F.col("user_id") % 11).cast("string"))).alias("lens"),
        F.when(nth % 7 == 0, F.lit(None)).otherwise(key * 10 + 100).cast("int").alias("iso"),
        F.when(nth % 19 == 0, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("captured_at"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library entries from customers: entry_id, label, camera_make, camera_model, lens, iso; names in mixed case and padded."""
    kinds = F.array(*map(F.lit, ("signup", " Error", "CLICK ", "view", "Purchase")))
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.alias("entry_id"),
        F.col("c_name").alias("label"),
        F.element_at(kinds, (k % 5 + 1).cast("int")).alias("camera_make"),
        F.concat(F.lit("r"), (k % 7).cast("string")).alias("camera_model"),
        F.concat(F.lit("lens "), (k % 11).cast("string")).alias("lens"),
        (k % 30 * 10 + 100).cast("int").alias("iso"),
    )


def bayer(spark: SparkSession, sf_dir: str, side: int = 24) -> DataFrame:
    """Whole RGGB mosaics of ``side`` sites square: frame, y, x, value. A frame is 512 orders; sites that no line item hits have a value of their place."""
    li = table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey div 512").cast("int").alias("frame"),
        (F.col("l_orderkey") % side).cast("int").alias("y"),
        ((F.col("l_partkey") + 5 * F.col("l_linenumber")) % side).cast("int").alias("x"),
        (F.col("l_quantity") * 300).cast("int").alias("v"),
    )
    hit = li.groupBy("frame", "y", "x").agg(F.max("v").alias("raw"))
    place = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1)))
    grid = hit.select("frame").distinct().select("frame", place.alias("i")).select("frame", F.expr(f"i div {side}").cast("int").alias("y"), (F.col("i") % side).alias("x"))
    rest = 1000 + (F.col("frame") * 7919 + F.col("y") * 131 + F.col("x") * 37 + F.col("y") * F.col("x") * 11) % 9973
    return grid.join(hit, ["frame", "y", "x"], "left").select("frame", "y", "x", (F.coalesce("raw", rest) / 16383.0).alias("value"))


SCENE = (64, 48)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luminance of small scenes, one a supplier: frame, y, x, light. Each shows a chart at a place and exposure of its own; some lack a patch, have
    specks between patches or a chart too dark to be found."""
    ref = chart_reference(spark).select("patch_idx", (0.2126 * F.col("t_r") + 0.7152 * F.col("t_g") + 0.0722 * F.col("t_b")).alias("lum"))
    width, height = SCENE
    s = F.col("frame")
    px = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("i"))
    px = px.select("frame", F.expr(f"i div {width}").cast("int").alias("y"), (F.col("i") % width).alias("x"))
    u, v = F.col("x") - 4 - s % 3, F.col("y") - 5 - s % 4
    inside = u.between(0, 53) & v.between(0, 35) & (F.pmod(u, F.lit(9)) < 7) & (F.pmod(v, F.lit(9)) < 7)
    patch = F.when(inside, F.floor(v / 9) * 6 + F.floor(u / 9)).cast("int")
    px = px.withColumn("patch_idx", F.when((s % 6 == 1) & (patch == s % 24), None).otherwise(patch))
    gain = F.when(s % 9 == 4, 0.04).otherwise(0.6 + (s % 7) * 0.1)
    speck = (s % 4 == 3) & ((F.col("x") * 7 + F.col("y") * 13 + s) % 97 == 0)
    light = F.when(speck, 0.5).otherwise(F.coalesce(F.col("lum") * gain, F.lit(0.02)))
    return px.join(F.broadcast(ref), "patch_idx", "left").select("frame", "y", "x", light.alias("light"))
