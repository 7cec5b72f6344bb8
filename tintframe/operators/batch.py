"""Batch planning and preflight over files: names, existing outputs, mismatch logic with unknowns, counts and ranked suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .naming import assign_names
from .ordering import with_place

EXTENSIONS = ("dng", "raw", "cr3", "nef", "jpg", "jpeg", "png")
MAX_FILES, MAX_SUGGESTIONS = 200, 50


def collect_inputs(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Distinct paths with an accepted extension and their order by path components."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.filter(ext.isin(*extensions)).select("path").distinct().withColumn("parts", F.split("path", "/"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def output_names(inputs: DataFrame, extension: str) -> DataFrame:
    """path, output: for each file in input order the first free of ``stem.ext``, ``stem-1.ext``, ``stem-2.ext`` and so on."""
    placed = with_place(inputs.withColumn("stem", stem(F.col("path"))), ["parts"])
    named = assign_names(placed.select("path", "stem", "place"))
    return named.select("path", F.concat("name", F.lit(f".{extension}")).alias("output"))


def skip_existing(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned outputs that don't exist yet."""
    return planned.join(existing.select("output"), "output", "left_anti")


def refused_outputs(planned: DataFrame, inputs: DataFrame) -> DataFrame:
    """Planned outputs (path, output) that are a selected input themselves, of this or another file."""
    return planned.join(inputs.select(F.col("path").alias("output")).distinct(), "output", "left_semi")


def free_names(wanted: DataFrame, existing: DataFrame, attempts: int = 10_000) -> DataFrame:
    """``wanted`` (stem, place) with name, one request after another by place: the first of ``stem``, ``stem-2``, ``stem-3`` and so on that
    neither an existing ``name`` nor an earlier request takes; null if the first ``attempts`` are taken, and for a null stem.
    """
    named = assign_names(wanted, 2, existing)
    named = named.withColumn("name", F.when(F.col("slot") < attempts, F.col("name"))).drop("slot")
    return named.unionByName(wanted.filter("stem is null").withColumn("name", F.lit(None).cast("string")))


def same_name(a: Column, b: Column) -> Column:
    """Equal after trimming and without regard to ASCII case; an empty name equals none; null if one is unknown."""
    fold = lambda c: F.translate(F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return (fold(a) == fold(b)) & (F.trim(a) != "")


def mismatches(captures: DataFrame, active: dict, comparable: bool) -> DataFrame:
    """``captures`` with camera_mismatch, lens_mismatch, iso_mismatch, time_different against the active entry; null is unknown."""
    a = {k: F.lit(v) for k, v in active.items()}
    make, model = same_name(F.col("make"), a["camera_make"]), same_name(F.col("model"), a["camera_model"])
    raw = (
        F.when(F.col("make").isNotNull() & F.col("model").isNotNull(), ~(make & model))
        .when(F.col("make").isNotNull() & F.col("model").isNull() & ~make, True)
        .when(F.col("make").isNull() & F.col("model").isNotNull() & ~model, True)
    )
    kind, known = F.col("source_kind"), F.lit(comparable)
    camera = (
        F.when(kind.isNull(), None).when((kind == "rendered") & known, True).when((kind == "raw") & ~known, True).when(kind == "raw", raw)
    )
    return captures.withColumns(
        {
            "camera_mismatch": camera,
            "lens_mismatch": F.col("lens") != a["lens"],
            "iso_mismatch": F.col("iso") != a["iso"],
            "time_different": F.col("captured_at") != a["captured_at"],
        }
    )


def preflight_summary(checked: DataFrame) -> DataFrame:
    """One row: files, missing facts, mismatches, distinct counts and ranges. One pass with partial sums."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("make", "model", "lens", "iso", "captured_at")]
    wrong = [F.count_if(F.col(c)).alias(c) for c in ("camera_mismatch", "lens_mismatch", "iso_mismatch", "time_different")]
    return checked.agg(
        F.count("*").alias("files"),
        *missing,
        *wrong,
        F.count_distinct("lens").alias("lenses"),
        F.count_distinct("iso").alias("isos"),
        F.min("iso").alias("iso_min"),
        F.max("iso").alias("iso_max"),
        F.min("captured_at").alias("time_min"),
        F.max("captured_at").alias("time_max"),
    )


def suggestions(captures: DataFrame, library: DataFrame, limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """Library entries by how many files their camera took: entry_id, label, matching_files, the first ``limit``. Files are counted
    by camera first, so the join sees cameras, not files."""
    fold = lambda c: F.translate(F.trim(F.col(c)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cameras = (
        captures.filter("make is not null and model is not null")
        .groupBy(fold("make").alias("a"), fold("model").alias("b"))
        .agg(F.count("*").alias("n"))
        .filter("a <> '' and b <> ''")
    )
    named = library.select("entry_id", "label", fold("camera_make").alias("a"), fold("camera_model").alias("b"))
    return (
        named.join(cameras, ["a", "b"])
        .select("entry_id", "label", F.col("n").alias("matching_files"))
        .orderBy(F.desc("matching_files"), "label", "entry_id")
        .limit(limit)
    )
