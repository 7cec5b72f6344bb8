"""Comparing decode contracts: the first difference that matters decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SETTINGS = ("output_color", "output_depth", "gamma", "white_balance", "no_auto_bright", "demosaic", "highlight", "orientation", "no_auto_scale")


def compare_for_apply(pairs: DataFrame) -> DataFrame:
    """``pairs`` has profile_* and image_* columns for decoder, version and every setting. Adds status (``decoder``, ``settings``,
    ``version`` or ``same``); only the first two block, and a version that differs alone warns."""
    same = F.lit(True)
    for s in SETTINGS:
        same = same & (F.col(f"profile_{s}") == F.col(f"image_{s}"))
    status = (
        F.when(F.col("profile_decoder") != F.col("image_decoder"), "decoder")
        .when(~same, "settings")
        .when(F.col("profile_version") != F.col("image_version"), "version")
        .otherwise("same")
    )
    return pairs.withColumn("status", status).withColumn("blocks", F.col("status").isin("decoder", "settings"))
