"""Applying a profile to a batch of files: every file has its own outcome, and a run that is begun again does what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import small, written
from .batch import collect_inputs, output_names
from .calibration import corrected
from .contract import SETTINGS, compare_for_apply
from .transform import OUT, clip_flags, encode_srgb

CODES = ("code_r", "code_g", "code_b")


def outcomes(files: DataFrame, profile: dict, existing: DataFrame, extension: str = "tiff", overwrite: bool = False, force: bool = False) -> DataFrame:
    """One row per selected file of ``files``: path, output, status (``ready``, ``skipped``, ``failed``), error and warning, before any pixel is read.

    ``files`` has path, decode_error (null for a file that can be read), make, model, and decoder, version and the contract's settings of its decoding;
    ``profile`` has the same, and ``existing`` (output) what the folder holds. The first reason counts: the output is a selected file, it exists, the
    file can't be decoded, another camera, the profile's own decoders disagree, another contract; ``force`` turns the third last and
    the last into warnings. A version that differs alone warns.
    """
    planned = output_names(collect_inputs(files), extension)
    there = existing.select("output").distinct().withColumn("exists", F.lit(True))
    own = files.select(F.col("path").alias("output")).distinct().withColumn("selected", F.lit(True))
    rows = planned.join(files.dropDuplicates(["path"]), "path").join(there, "output", "left").join(own, "output", "left")
    sides = {"profile_decoder": F.lit(profile["decoder"]), "profile_version": F.lit(profile["version"]), "image_decoder": F.col("decoder"), "image_version": F.col("version")}
    for s in SETTINGS:
        sides |= {f"profile_{s}": F.lit(profile[s]), f"image_{s}": F.col(s)}
    rows = compare_for_apply(rows.withColumns(sides)).withColumnRenamed("status", "contract")
    camera = F.concat(F.lit("camera mismatch (profile: "), F.lit(profile["make"]), F.lit(" "), F.lit(profile["model"]), F.lit(", image: "), "make", F.lit(" "), "model", F.lit(")"))
    other = (F.col("make") != profile["make"]) | (F.col("model") != profile["model"])
    differs = F.concat(F.lit("decode contract differs: "), F.col("contract"))
    exists = F.coalesce("exists", F.lit(False))
    skipped = exists & F.lit(not overwrite)
    error = F.when(exists & F.col("selected").isNotNull(), "output path is a selected input file")
    error = error.when(~skipped & F.col("decode_error").isNotNull(), F.concat(F.lit("decode failed: "), "decode_error"))
    disagree = profile.get("camera_decoder", profile["decoder"]) != profile["decoder"]
    if not force:
        error = error.when(~skipped & other, camera)
    if disagree:
        error = error.when(~skipped, "profile camera decoder identity disagrees with its decode contract")
    if not force:
        error = error.when(~skipped & F.col("blocks"), differs)
    warning = F.when(F.col("contract") == "version", differs)
    if force:
        warning = F.when(F.col("blocks"), F.concat(F.lit("forced decode-contract mismatch: "), F.col("contract"))).otherwise(warning)
    rows = rows.withColumn("error", error)
    status = F.when(F.col("error").isNotNull(), "failed").when(skipped, "skipped").otherwise("ready")
    return rows.withColumn("status", status).select("path", "output", "status", "error", F.when(status == "ready", warning).alias("warning"))


def apply_batch(
    files: DataFrame, pixels: DataFrame, stages: Column | dict, profile: dict, existing: DataFrame, places: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(codes, results) of a batch: the 16-bit codes of every pixel (output and the columns of ``pixels`` but path) of the files that can be done, and one
    row per file: path, output, status (written, skipped, failed), error, warning, pixels, clipped. ``stages`` is the profile's fit, by column name.

    A file fails alone: one without pixels or with a value that is no number says so in its row, and none of its codes are there.
    """
    plan = written(outcomes(files, profile, existing, **options), "plan")
    ready = plan.filter("status = 'ready'").select("path", "output")
    met = pixels.join(small(ready), "path")
    bad = F.isnan("r") | F.isnan("g") | F.isnan("b") | F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()
    done = clip_flags(corrected(met.withColumns({c: F.lit(v) for c, v in stages.items()}), ("r", "g", "b")))
    # written: facts and codes both read it
    coded = written(encode_srgb(done, places).withColumn("_bad", bad).drop(*stages, *OUT, "r", "g", "b"), "coded")
    facts = written(coded.groupBy("path").agg(F.count("*").alias("pixels"), F.count_if(F.col("flags") != 0).alias("clipped"), F.bool_or("_bad").alias("_bad")), "facts")
    results = plan.join(small(facts), "path", "left")
    broken = F.when(F.col("pixels").isNull(), "export failed: no pixels").when(F.col("_bad"), "export failed: a pixel is not a number")
    failed = (F.col("status") == "ready") & broken.isNotNull()
    results = results.withColumns({"error": F.when(failed, broken).otherwise(F.col("error")), "status": F.when(failed, "failed").when(F.col("status") == "ready", "written").otherwise(F.col("status"))})
    ok = F.col("status") == "written"
    results = results.select("path", "output", "status", "error", F.when(ok, F.col("warning")).alias("warning"), *(F.when(ok, F.col(c)).alias(c) for c in ("pixels", "clipped")))
    broken_paths = small(facts.filter("_bad").select("path"))
    return coded.join(broken_paths, "path", "left_anti").drop("_bad", "path"), results


def publish(codes: DataFrame, results: DataFrame, folder: str) -> None:
    """Adds a run to ``folder``: its codes first, and then its results, which make them count; a run that dies between leaves nothing that counts."""
    import uuid

    run = uuid.uuid4().hex
    codes.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/codes")
    results.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{folder}/results")


def published(spark, folder: str) -> DataFrame:
    """output and run of every file that runs into ``folder`` have written; what a run that starts again takes as ``existing``."""
    from pyspark.errors import AnalysisException

    try:
        results = spark.read.parquet(f"{folder}/results")
    except AnalysisException:
        return spark.createDataFrame([], "output string, run string")
    return results.filter("status = 'written'").select("output", "run")
