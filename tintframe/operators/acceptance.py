"""Rules that accept, warn or refuse: raw frames, decode contracts, cameras, metadata entries and exports. Ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U16, I32, DENOMINATOR = 65_535, 2_147_483_647, 1_000_000

# Metadata tags that may be copied, by directory, and for each the type and how many values it takes (0: any text).
ALLOWED_TAGS = {
    "primary": {t: ("ascii", 0) for t in (271, 272, 306, 315, 33432)},
    "exif": {36867: ("ascii", 0), 36868: ("ascii", 0), 42035: ("ascii", 0), 42036: ("ascii", 0), 34855: ("integer", 1), 33434: ("rational", 1), 33437: ("rational", 1), 37386: ("rational", 1), 42034: ("rational", 4)},
    "gps": {1: ("ascii", 0), 3: ("ascii", 0), 18: ("ascii", 0), 29: ("ascii", 0), 0: ("byte", 4), 5: ("byte", 1), 2: ("rational", 3), 4: ("rational", 3), 7: ("rational", 3), 6: ("rational", 1)},
}
#: The first of these settings that differs from its pinned value is the contract's error.
PINNED = (
    ("output_color", "raw", "output colour"),
    ("output_depth", "u16", "output depth"),
    ("white_balance", "unity 1 1 1 1", "white balance"),
    ("gamma", "1 1", "auto brightening"),
    ("no_auto_bright", "true", "auto brightening"),
    ("demosaic", "ahd", "demosaic"),
    ("highlight", "clip", "highlight"),
    ("orientation", "as shot", "orientation"),
    ("no_auto_scale", "false", "auto brightening"),
)


def patch_name(patch: str) -> str:
    """A patch as profiles name it: its words, capital first, put together."""
    return "".join(w[:1].upper() + w[1:] for w in patch.split("-"))


def first_of(*rules: tuple[Column, Column | str]) -> Column:
    """The text of the first rule that holds; null where none does."""
    out = None
    for holds, text in rules:
        text = F.lit(text) if isinstance(text, str) else text
        out = F.when(holds, text) if out is None else out.when(holds, text)
    return out


def contract_error(prefix: str = "") -> Column:
    """The first violated rule of a decode contract whose settings are in columns of ``PINNED``'s names; a null setting violates its rule."""
    return first_of(*((~F.col(prefix + c).eqNullSafe(F.lit(v)), text) for c, v, text in PINNED))


def black_level_error(level: Column) -> Column:
    """Whether a black level is no whole number from 0 to 65535."""
    return level.isNull() | F.isnan(level) | (level < 0) | (level > U16) | (level != F.floor(level))


def raw_frame_error() -> Column:
    """Why a raw frame is refused, or null. Columns: width, height, active_full (whether active area and crop are the frame), photometric
    (``cfa`` or ``linear``), components, cfa (four letters), integer_samples, samples, black (array), black_w, black_h, black_cpp, white (array)."""
    c = F.col
    cfa, pixels = c("photometric") == "cfa", c("width").cast("long") * c("height")
    count = lambda letter: F.length(F.regexp_replace(c("cfa"), f"[^{letter}]", ""))
    bayer = (F.length("cfa") == 4) & (count("R") == 1) & (count("G") == 2) & (count("B") == 1)
    channels = F.when(cfa, 1).otherwise(3)
    grid = c("black_w") * c("black_h")
    even = lambda k: F.forall(F.sequence(F.lit(0), grid - 1), lambda i: F.get("black", i * c("black_cpp") + k) == F.get("black", F.lit(0) + k))
    same = F.when(c("black_cpp") == 1, even(0)).otherwise(even(0) & even(1) & even(2))
    # black and white of each position: one for all, or each its own
    places = F.when(cfa, 4).otherwise(3)
    own = F.when(cfa, c("black_w") > 1).otherwise(c("black_cpp") == 3)
    index = lambda i: F.when(own, i).otherwise(0)
    each = F.sequence(F.lit(0), places - 1)
    black = lambda i: F.get("black", index(i))
    white = lambda i: F.get("white", F.when(F.size("white") == 1, 0).otherwise(i))
    return first_of(
        (pixels == 0, "empty RAW image"),
        (~c("active_full"), "RAW crop or active area is not the full frame"),
        (cfa & ((c("components") != 1) | (F.length("cfa") != 4)), "only 2x2 Bayer CFA is supported"),
        (cfa & ~bayer, "only RGB Bayer CFA is supported"),
        (~cfa & (c("components") != 3), "only 2x2 Bayer and three-component LinearRaw are supported"),
        (~c("integer_samples"), "floating-point RAW samples are not supported"),
        (c("samples") != pixels * channels, "RAW sample count differs from image dimensions"),
        (cfa & ~((c("black_cpp") == 1) & (c("black_w") == c("black_h")) & c("black_w").isin(1, 2)), "unsupported CFA black-level grid"),
        (~cfa & ((c("black_w") == 0) | (c("black_h") == 0) | ~c("black_cpp").isin(1, 3) | (grid * c("black_cpp") != F.size("black"))), "unsupported LinearRaw black-level grid"),
        (~cfa & ~same, "LinearRaw black level varies across the repeat grid"),
        (F.exists(each, lambda i: black(i).isNull()), "missing black level"),
        (F.exists(each, lambda i: black_level_error(black(i))), "fractional or out-of-range black level"),
        (F.exists(each, lambda i: white(i).isNull()), "missing white level"),
        (F.exists(each, lambda i: white(i) > U16), "white level exceeds 16 bits"),
        (F.exists(each, lambda i: white(i) <= black(i)), "white level is not greater than black level"),
    )


def display_neutral(coefficients: Column) -> Column:
    """Reciprocals of three white-balance coefficients; null unless all are finite and positive."""
    three = F.slice(coefficients, 1, 3)
    fine = (F.size(three) == 3) & F.forall(three, lambda v: v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < F.lit(float("inf"))))
    return F.when(fine, F.transform(three, lambda v: 1 / v))


def corrupt_frames(samples: DataFrame, white: int) -> DataFrame:
    """frame, corrupt: whether any sample (raw) of a frame is above twice the white level."""
    return samples.groupBy("frame").agg(F.bool_or(F.col("raw") > 2 * white).alias("corrupt"))


def same_camera(make: Column, model: Column, profile_make: Column, profile_model: Column) -> Column:
    """Exact identity, unlike preflight's: case and blanks count, and an unknown name is an empty one."""
    known = lambda v: F.coalesce(v, F.lit(""))
    return (known(make) == known(profile_make)) & (known(model) == known(profile_model))


def camera_check(df: DataFrame) -> DataFrame:
    """``df`` with error and warnings of applying a profile to an image.

    Columns: allow (whether mismatches only warn), camera_same, profile_consistent (camera and contract of the profile name one decoder),
    raw, decoder_known (the image's decoder is the one its contract names), contract_status (``same``, ``version``, or the
    setting that differs). A profile at odds with itself and an unknown raw decoder are errors under either policy.
    """
    c = F.col
    differs = ~c("contract_status").isin("same", "version")
    error = first_of(
        (~c("camera_same") & ~c("allow"), "camera mismatch"),
        (~c("profile_consistent"), "profile camera decoder identity disagrees with its decode contract"),
        (c("raw") & ~c("decoder_known"), "RAW decoder identity disagrees with its contract"),
        (differs & ~c("allow"), F.concat(F.lit("decode-contract mismatch: "), c("contract_status"))),
    )
    warnings = F.array_compact(
        F.array(
            F.when(~c("camera_same"), "camera mismatch allowed for library calibration"),
            F.when(c("contract_status") == "version", "decoder version differs"),
            F.when(differs, F.concat(F.lit("decode-contract mismatch allowed for library calibration: "), c("contract_status"))),
        )
    )
    return df.withColumns({"error": error, "warnings": F.when(error.isNull(), warnings)})


def provenance(failures: Column, forced: Column, quick: Column) -> dict[str, Column]:
    """passed, overridden, quick_and_dirty of a profile, from its number of gate failures and the user's choices."""
    return {"passed": failures == 0, "overridden": (failures > 0) & (forced | quick), "quick_and_dirty": quick}


def may_write(failures: Column, forced: Column) -> Column:
    """A profile with failures is written only if forced; the relaxed thresholds alone don't suffice."""
    return (failures == 0) | forced


def tag_rules(spark) -> DataFrame:
    rows = [(d, t, kind, n) for d, tags in ALLOWED_TAGS.items() for t, (kind, n) in tags.items()]
    return spark.createDataFrame(rows, "directory string, tag int, rule_kind string, rule_count int")


def checked_tags(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """``entries`` (directory, tag, kind, text, n_values, zero_denominator) with status: ``copied``, ``not allowed`` or ``bad value``. A text must
    end in NUL and hold no other, but for the copyright tag's, which has two parts."""
    short = F.substring("text", 1, F.length("text") - 1)
    fine = (
        F.when(F.col("rule_kind") == "ascii", F.col("text").endswith("\0") & (F.octet_length("text") <= U16) & ((F.col("tag") == 33432) | ~short.contains("\0")))
        .when(F.col("rule_kind") == "rational", (F.col("n_values") == F.col("rule_count")) & ~F.col("zero_denominator"))
        .otherwise(F.col("n_values") == F.col("rule_count"))
    )
    status = F.when(F.col("rule_kind").isNull(), "not allowed").when((F.col("kind") == F.col("rule_kind")) & F.coalesce(fine, F.lit(False)), "copied").otherwise("bad value")
    return entries.join(F.broadcast(rules), ["directory", "tag"], "left").withColumn("status", status).drop("rule_kind", "rule_count")


def dcp_refusal(quick: Column, name: Column, scales: list[Column], white: list[Column]) -> Column:
    """Why fitted stages can't become a camera profile, or null. ``white``: what D50 white is in the camera's colours."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v <= 0)
    some = lambda vs: F.greatest(*(bad(v).cast("int") for v in vs)) == 1
    return first_of(
        (quick, "quick-and-dirty profiles are measured from rendered images"),
        (F.coalesce(F.trim(name), F.lit("")) == "", "a camera name is required"),
        (~name.rlike(r"^[\x20-\x7E]+$"), "camera name must be printable ASCII"),
        (some(scales), "exposure and channel scales must be finite and positive"),
        (some(white), "fitted matrix is singular or maps no positive camera neutral to D50 white"),
    )


def signed_rational(value: Column) -> Column:
    """The numerator over a million, half away from zero; null where it does not fit 32 bits."""
    scaled = F.round(value * float(DENOMINATOR))
    return F.when(~F.isnan(scaled) & (F.abs(scaled) <= I32), scaled.cast("int"))


def export_error(format_: Column, quality: Column) -> Column:
    return F.when((format_ == "jpeg") & ~F.coalesce(quality.between(1, 100), F.lit(False)), F.concat(F.lit("JPEG quality must be 1-100, got "), quality.cast("string")))


EXIF_BUDGET, ENTRY_COST, LEAST_SIZE = 60_000, 14, 4


def within_budget(entries: DataFrame, budget: int = EXIF_BUDGET) -> DataFrame:
    """``entries`` (file, ord, directory, tag, size: an accepted value's bytes) with status: ``copied``, ``duplicate`` or ``too large``.

    Entries are taken in order of ord (of equal ones the lower directory and tag first); what is skipped uses nothing of the budget, so a
    smaller one may still fit after it. A file's entries are folded in one row: directories hold at most 65,535.
    """
    rows = F.sort_array(F.collect_list(F.struct("ord", "directory", "tag", "size")))
    cost = lambda e: F.greatest(e["size"], F.lit(LEAST_SIZE)).cast("long") + ENTRY_COST
    key = lambda e: F.concat_ws(":", e["directory"], e["tag"].cast("string"))

    def step(acc, e):
        status = F.when((e["size"] > acc["left"]) | (cost(e) > acc["left"]), "too large").when(F.array_contains(acc["seen"], key(e)), "duplicate").otherwise("copied")
        copied = status == "copied"
        return F.struct(
            F.when(copied, acc["left"] - cost(e)).otherwise(acc["left"]).alias("left"),
            F.when(copied, F.array_append(acc["seen"], key(e))).otherwise(acc["seen"]).alias("seen"),
            F.array_append(acc["out"], status).alias("out"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(budget).cast("long").alias("left"), none.alias("seen"), none.alias("out"))
    folded = entries.groupBy("file").agg(rows.alias("rows")).withColumn("status", F.aggregate("rows", start, step, lambda acc: acc["out"]))
    pairs = folded.select("file", F.explode(F.arrays_zip("rows", "status")).alias("e"))
    return pairs.select("file", "e.rows.ord", "e.rows.directory", "e.rows.tag", "e.rows.size", "e.status")


def image_error(width: Column, height: Column, samples: Column, icc_bytes: Column) -> Column:
    """Why an image of three channels can't be written, or null."""
    return first_of(
        ((width == 0) | (height == 0), "image has no pixels"),
        (F.coalesce(icc_bytes, F.lit(0)) == 0, "colour profile is empty"),
        (~(width.cast("long") * height * 3).eqNullSafe(samples.cast("long")), "sample count differs from dimensions"),
    )


#: What a chart dataset must say of itself, in the order in which it is checked.
CHART_FACTS = (("illuminant", "D50"), ("observer", "CIE 1931 2 Degree Standard Observer"), ("adaptation", "Bradford"), ("white", "D65"))


def chart_errors(datasets: DataFrame, patches: DataFrame, expected: DataFrame) -> DataFrame:
    """dataset, error: the first rule that a chart dataset breaks, or null.

    ``datasets``: dataset and the columns of ``CHART_FACTS``; ``patches``: dataset, patch_idx, patch, label, x, y, big_y; ``expected``: patch_idx and
    patch of the 24 places.
    """
    named = expected.select("patch_idx", F.col("patch").alias("__name"))
    odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = patches.join(F.broadcast(named), "patch_idx", "left")
    # a rule's number follows the order of its text; numbers alone let partial sums be hashed instead of all patches being sorted
    texts = {0: F.format_string("patch %d has no label", "patch_idx"), 1: F.format_string("patch %d is not finite", "patch_idx")}
    texts[2] = F.format_string("patch %d must be %s", "patch_idx", F.coalesce("__name", F.lit("absent")))
    rule = first_of((~F.col("patch").eqNullSafe(F.col("__name")), F.lit(2)), (F.coalesce(F.trim("label"), F.lit("")) == "", F.lit(0)), (odd("x") | odd("y") | odd("big_y"), F.lit(1)))
    no_place = -(1 << 40)
    code = F.coalesce(F.col("patch_idx").cast("long"), F.lit(no_place)) * 4 + rule
    checked = rows.groupBy("dataset").agg(F.count("*").alias("n"), F.min(code).alias("code"))
    place = F.shiftright("code", 2)
    checked = checked.withColumn("patch_idx", F.when(place != no_place, place)).join(F.broadcast(named), "patch_idx", "left")
    rule = F.col("code").bitwiseAND(3)
    checked = checked.select("dataset", "n", F.when(rule == 0, texts[0]).when(rule == 1, texts[1]).when(rule == 2, texts[2]).alias("first"))
    count = F.coalesce("n", F.lit(0))
    facts = [(~F.col(c).eqNullSafe(F.lit(v)), F.concat(F.lit(f"{c} must be {v}, found "), F.coalesce(c, F.lit("none")))) for c, v in CHART_FACTS]
    error = F.coalesce(first_of(*facts, (count != 24, F.concat(F.lit("24 patches expected, found "), count.cast("string")))), F.col("first"))
    return datasets.join(checked, "dataset", "left").select("dataset", error.alias("error"))


# Tags outside the allowed ones whose exclusion is reported, as are all of GPS.
REVIEWED = (274, 37500, 40961, 41987, 513, 514)
LARGEST = 65_500


def metadata_report(entries: DataFrame, rules: DataFrame, strip_gps: bool = False, budget: int = EXIF_BUDGET) -> DataFrame:
    """``entries`` (file, ord, directory, tag, name, size, and what ``checked_tags`` takes) that are copied or whose exclusion is reported, with copied and
    reason; others are left out. In the order of ord: GPS that is to be stripped, tags that are not allowed, values too large at once, values that
    are not as they should be, those beyond what is left of the budget, and repeats of a tag."""
    gps = F.col("directory") == "gps"
    rows = checked_tags(entries, rules)
    early = F.when(gps & F.lit(strip_gps), "GPS stripped").when(F.col("status") == "not allowed", F.when(gps | F.col("tag").isin(*REVIEWED), "").otherwise("left out"))
    rows = rows.withColumn("early", early).filter("early is null or early <> 'left out'")
    item = F.struct("ord", "directory", "tag", "name", "size", "early", (F.col("status") == "bad value").alias("bad"))
    cost = lambda e: F.greatest(e["size"], F.lit(LEAST_SIZE)).cast("long") + ENTRY_COST
    key = lambda e: F.concat_ws(":", e["directory"], e["tag"].cast("string"))

    def step(acc, e):
        large = (e["size"] > acc["left"]) | (e["size"] > LARGEST)
        reason = (
            F.when(e["early"].isNotNull(), e["early"])
            .when(large, "too large for JPEG EXIF")
            .when(e["bad"], "unsupported value")
            .when(cost(e) > acc["left"], "too large for JPEG EXIF")
            .when(F.array_contains(acc["seen"], key(e)), "duplicate")
        )
        copied = reason.isNull()
        return F.struct(
            F.when(copied, acc["left"] - cost(e)).otherwise(acc["left"]).alias("left"),
            F.when(copied, F.array_append(acc["seen"], key(e))).otherwise(acc["seen"]).alias("seen"),
            F.array_append(acc["out"], F.coalesce(reason, F.lit("copied"))).alias("out"),
        )

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(budget).cast("long").alias("left"), none.alias("seen"), none.alias("out"))
    folded = rows.groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    folded = folded.withColumn("reason", F.aggregate("rows", start, step, lambda acc: acc["out"]))
    pairs = folded.select("file", F.explode(F.arrays_zip("rows", "reason")).alias("e"))
    reason = F.col("e.reason")
    shown = F.when((reason == "copied") | (reason == ""), F.col("e.rows.name")).otherwise(F.concat("e.rows.name", F.lit(" ("), reason, F.lit(")")))
    return pairs.select("file", F.col("e.rows.ord").alias("ord"), (reason == "copied").alias("copied"), shown.alias("shown"))
