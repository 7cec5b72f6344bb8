"""Profiles as sealed JSON and CLF text, `.cube` text, library entries, batch results and paths: text projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_tags, fixed, slug
from ..sources.shared import small, written
from .acceptance import contract_error, dcp_refusal
from .batch import free_names
from .calibration import STAGES, report, validate
from .interchange import dcp_matrices, lut_arrays

SCHEMA_VERSION = "1.0"
DIGEST = r'"digest": "[0-9a-f]*"\n\}$'


def json_number(value: Column, places: int | None = None) -> Column:
    """A double as JSON, which reads back as the same double, or rounded to ``places`` first. Whole numbers have a decimal point; below 0.00001 and from
    1e16 on there is an exponent. Null and what is no number are ``null``."""
    v = (value if places is None else F.round(value, places)) + F.lit(0.0)
    text = v.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$|\.", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(v < 0, "-").otherwise("")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(sign, F.rpad(digits, power + 1, F.lit("0")), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substring(digits, power + 2, F.length(digits)))).otherwise(".0"))
    large = F.when(F.length(digits) > power + 1, F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits)))).otherwise(large)
    mantissa = F.concat(sign, F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""))
    apart = F.concat(mantissa, F.lit("e"), power.cast("string"))
    shown = F.when(power.isNull(), text).when((F.abs(v) < 1e-5) | (F.abs(v) >= 1e16), apart).when(power < 0, small).otherwise(large)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "null").otherwise(shown)


def text_number(value: Column, places: int | None = None) -> Column:
    """The same without a decimal point of its own and without exponents: a double's shortest decimal form, or rounded to ``places``."""
    if places is not None:
        return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", F.round(value, places) + F.lit(0.0)), "0+$", ""), r"\.$", "")
    number = json_number(value)
    power = F.regexp_extract(number, r"e(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(number, r"^-?([0-9.]+)e", 1), r"\.", "")
    sign = F.when(value < 0, "-").otherwise("")
    plain = F.when(power < 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)).otherwise(F.concat(sign, F.rpad(digits, power + 1, F.lit("0"))))
    return F.when(power.isNull(), F.regexp_replace(number, r"\.0$", "")).otherwise(plain)


def quoted(text: Column) -> Column:
    """A text as a JSON string: quotes, backslashes and the usual control characters are escaped."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), text, F.lit('"'))


def pretty(value, indent: int = 0) -> list:
    """The parts (texts and columns) of indented JSON with two spaces a level, keys in the order given. Leaves are columns of JSON text."""
    if not isinstance(value, (dict, list)):
        return [value]
    pad, ends = "  " * (indent + 1), "{}" if isinstance(value, dict) else "[]"
    out: list = [ends[0] + "\n"]
    items = list(value.items()) if isinstance(value, dict) else [(None, v) for v in value]
    for k, (key, v) in enumerate(items):
        out += [pad + (f'"{key}": ' if key else ""), *pretty(v, indent + 1), ",\n" if k + 1 < len(items) else "\n"]
    return [*out, "  " * indent + ends[1]]


def joined(parts: list) -> Column:
    """Parts in one column, texts next to each other as one constant."""
    merged: list = []
    for p in parts:
        if isinstance(p, str) and merged and isinstance(merged[-1], str):
            merged[-1] += p
        else:
            merged.append(p)
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in merged))


def failure_items(failures: Column, indent: int = 3) -> Column:
    """An array of (patch, reason, measured) as a JSON array's text; empty ones as ``[]``."""
    pad = "  " * indent
    key = lambda name, v: F.concat(F.lit(f'{pad}  "{name}": '), v)
    item = lambda f: F.concat(F.lit(pad + "{\n"), key("patch", F.coalesce(quoted(f["patch"]), F.lit("null"))), F.lit(",\n"), key("reason", quoted(f["reason"])), F.lit(",\n"), key("measured", quoted(f["measured"])), F.lit("\n" + pad + "}"))
    return F.when(F.size(failures) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(failures, item), ",\n"), F.lit("\n" + pad[2:] + "]")))


def contract_layout(of, text) -> dict:
    """The decode contract's keys: settings that are several numbers become arrays, and the white balance of fixed multipliers an object."""
    gamma, balance = of("gamma"), of("white_balance")
    numbers = lambda t, pad: F.concat(F.lit("[\n" + pad + "  "), F.array_join(F.transform(F.split(t, " "), lambda v: json_number(v.try_cast("double"))), ",\n" + pad + "  "), F.lit("\n" + pad + "]"))
    fixed = F.concat(F.lit('{\n      "unity": {\n        "user-mul": '), numbers(F.substring(balance, F.lit(7), F.length(balance)), "        "), F.lit("\n      }\n    }"))
    dashed = lambda n: text(F.replace(of(n), F.lit(" "), F.lit("-")))
    return {
        "decoder": text(of("decoder")),
        "decoder-version": text(of("decoder_version")),
        "output-color": dashed("output_color"),
        "output-depth": dashed("output_depth"),
        "gamma": numbers(gamma, "    "),
        "white-balance": F.when(balance.startswith("unity "), fixed).otherwise(dashed("white_balance")),
        "no-auto-bright": of("no_auto_bright"),
        "demosaic": dashed("demosaic"),
        "highlight": dashed("highlight"),
        "orientation": dashed("orientation"),
        "no-auto-scale": of("no_auto_scale"),
    }


def contract_of(json: str | Column) -> dict[str, Column]:
    """The settings of a profile's contract as columns of ``acceptance.PINNED``'s names, written as there."""
    at = lambda k: F.get_json_object(json, f"$.decode-contract.{k}")
    words = lambda k: F.replace(at(k), F.lit("-"), F.lit(" "))
    numbers = lambda k: F.array_join(F.transform(F.from_json(at(k), "array<double>"), lambda v: text_number(v)), " ")
    out = {n: words(n.replace("_", "-")) for n in ("output_color", "output_depth", "no_auto_bright", "demosaic", "highlight", "orientation", "no_auto_scale")}
    fixed = numbers("white-balance.unity.user-mul")
    return out | {"gamma": numbers("gamma"), "white_balance": F.when(fixed != "", F.concat(F.lit("unity "), fixed)).otherwise(words("white-balance"))}


def profile_layout(of, number, text, failures) -> dict:
    """The keys of a profile in their order; ``of(name)`` gives a field, ``number`` and ``text`` make JSON of it."""
    return {
        "schema-version": text(of("schema_version")),
        "decode-contract": contract_layout(of, text),
        "camera": {k: text(of(k.replace("-", "_"))) for k in ("make", "model", "decoder", "decoder-version")},
        "chart-revision": text(of("revision")),
        "dataset-digest": text(of("dataset_digest")),
        "reference-digest": text(of("reference_digest")),
        "transform": {
            "exposure-scale": number(of("exposure")),
            "channel-scale": [number(of(c)) for c in ("c_r", "c_g", "c_b")],
            "matrix": [[number(of(f"m{i}{j}")) for j in range(3)] for i in range(3)],
        },
        "validation": {
            **{k: number(of(k.replace("-", "_"))) for k in ("mean-delta-e", "max-delta-e", "p95-delta-e", "neutral-max-delta-e", "skin-max-delta-e", "condition-number")},
            "patch-count": of("patch_count_text"),
        },
        "quality": {**{k: of(k.replace("-", "_") + "_text") for k in ("passed", "overridden", "quick-and-dirty")}, "failures": failures},
    }


def profile_json(profiles: DataFrame, places: int | None = None) -> DataFrame:
    """``profiles`` with json (sealed) and digest: the SHA-256 of the JSON whose own digest is empty. Numbers keep every bit, or are rounded to ``places``.
    Columns: the keys of ``profile_layout``, the contract's settings as in ``acceptance.PINNED``, failures (patch, reason, measured)."""
    extra = {"patch_count_text": F.col("patch_count").cast("string")} | {f"{k}_text": F.col(k).cast("string") for k in ("passed", "overridden", "quick_and_dirty")}
    rows = profiles.withColumns(extra)
    bare = pretty({**profile_layout(F.col, lambda v: json_number(v, places), quoted, failure_items(F.col("failures"), 3)), "digest": "\0"})
    at = next(k for k, p in enumerate(bare) if isinstance(p, str) and p == "\0")
    head, tail = bare[:at], bare[at + 1 :]
    rows = rows.withColumn("digest", F.sha2(joined([*head, '""', *tail]), 256))
    return rows.withColumn("json", joined([*head, '"', F.col("digest"), '"', *tail])).drop(*extra)


def verified(sealed: DataFrame, major: str = "1") -> DataFrame:
    """``sealed`` (json in canonical form) with error: the first that holds of no JSON, another schema's major version, a digest that is not
    the text's, and what the decode contract inside it violates."""
    version = F.get_json_object("json", "$.schema-version")
    bare = F.regexp_replace("json", DIGEST, '"digest": ""\n}')
    inside = {f"_{k}": v for k, v in contract_of("json").items()}
    error = (
        F.when(version.isNull(), "invalid profile JSON")
        .when(F.substring_index(version, ".", 1) != major, F.concat(F.lit("unsupported schema version "), version, F.lit(f", expected {SCHEMA_VERSION}")))
        .when(~F.sha2(bare, 256).eqNullSafe(F.get_json_object("json", "$.digest")), "profile digest mismatch")
        .otherwise(F.concat(F.lit("invalid decode contract: "), contract_error("_")))
    )
    return sealed.withColumns(inside).withColumn("error", error).drop(*inside)


SUMMARY = ("mean_delta_e", "max_delta_e", "p95_delta_e", "neutral_max_delta_e", "skin_max_delta_e", "condition_number")


def read_profiles(sealed: DataFrame) -> DataFrame:
    """``sealed`` (json) with error (``verified``), the fitted stages, dataset_digest, the camera's make and model, the contract's settings and the summary
    of the fit (baseline_*), as its JSON has them; nulls where there is an error."""
    rows, known = verified(sealed), F.col("error").isNull()
    at = lambda k: F.when(known, F.get_json_object("json", f"$.{k}"))
    number = lambda k: at(k).cast("double")
    fields = {"exposure": number("transform.exposure-scale")} | {f"c_{c}": number(f"transform.channel-scale[{i}]") for i, c in enumerate("rgb")}
    fields |= {f"m{i}{j}": number(f"transform.matrix[{i}][{j}]") for i in range(3) for j in range(3)}
    fields |= {f"baseline_{k}": number("validation." + k.replace("_", "-")) for k in SUMMARY}
    fields |= {"dataset_digest": at("dataset-digest"), "digest": at("digest"), "make": at("camera.make"), "model": at("camera.model")}
    fields |= {"decoder": at("decode-contract.decoder"), "decoder_version": at("decode-contract.decoder-version"), "quick_and_dirty": at("quality.quick-and-dirty").cast("boolean")}
    return rows.withColumns(fields | {k: F.when(known, v) for k, v in contract_of("json").items()})


def chart_checks(samples: DataFrame, reference: DataFrame, sealed: DataFrame, dataset_digest: str, failures: DataFrame) -> DataFrame:
    """One row per frame of ``sealed`` (frame, json): how the profile's own stages do on that frame's chart, beside the summary stored at its fit. Nothing is fitted
    anew. ``failures`` are the frame's failed gates, which do not block. error: why the profile can't be used, or another chart dataset than the
    one at hand."""
    read = read_profiles(sealed)
    other = F.when(F.col("dataset_digest") != dataset_digest, "profile chart dataset digest does not match the pinned dataset")
    read = written(read.withColumn("error", F.coalesce("error", other)), "profiles")
    scored = report(validate(samples, reference, read.filter("error is null").select("frame", *STAGES)))
    gates = failures.groupBy("frame").agg(F.count("*").alias("gate_failures"))
    facts = read.select("frame", "error", *(F.when(F.col("error").isNull(), F.col(f"baseline_{k}")).alias(f"baseline_{k}") for k in SUMMARY))
    out = facts.join(scored, "frame", "left").join(gates, "frame", "left")
    n = F.when(F.col("error").isNull(), F.coalesce("gate_failures", F.lit(0)))
    return out.withColumns({"gate_failures": n, "quality_passed": n == 0})


def exports(requests: DataFrame, places: int | None = None, cube_size: int = 33) -> DataFrame:
    """``requests`` (json of a profile, format, camera_name) with content (text of a CLF or a cube; null for a camera profile, whose matrices are columns
    f00..f22 and k00..k22) and error, the first that holds: a profile that is refused, a camera name that is missing or not asked for, an unknown
    format, and why no camera profile can be made."""
    rows = read_profiles(requests.withColumn("_id", F.monotonically_increasing_id()))
    rows = written(rows, "exports")
    kind, name = F.col("format"), F.col("camera_name")
    clf = clf_text(rows, places).select("_id", "clf")
    luts = lut_arrays(rows.filter((kind == "cube") & F.col("error").isNull()).select(F.col("_id").alias("frame"), *STAGES), cube_size)
    line = lambda i: F.concat_ws(" ", *(text_number(F.get("lut", i * 3 + k), places) for k in range(3)))
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(cube_size**3 - 1)), line), "\n")
    cube = luts.select(F.col("frame").alias("_id"), F.concat(F.lit(f"LUT_3D_SIZE {cube_size}\nDOMAIN_MIN 0 0 0\nDOMAIN_MAX 1 1 1\n"), lines, F.lit("\n")).alias("cube"))
    dcp = dcp_matrices(rows.withColumn("frame", F.col("_id"))).withColumnRenamed("frame", "_id")
    white = [F.col(f"f{i}0") + F.col(f"f{i}1") + F.col(f"f{i}2") for i in range(3)]
    rows = rows.join(clf, "_id").join(cube, "_id", "left").join(dcp, "_id")
    refusal = dcp_refusal(F.col("quick_and_dirty"), name, [F.col(c) for c in ("exposure", "c_r", "c_g", "c_b")], white)
    error = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("profile validation failed: "), "error"))
        .when((kind == "dcp") & name.isNull(), "--camera-name is required for dcp; use the camera name Lightroom shows for your RAW files")
        .when((kind != "dcp") & name.isNotNull(), "--camera-name only applies to --format dcp")
        .when(~F.coalesce(kind.isin("clf", "cube", "dcp"), F.lit(False)), "unknown format")
        .when(kind == "dcp", refusal)
    )
    fine = error.isNull()
    content = F.when(fine & (kind == "clf"), F.col("clf")).when(fine & (kind == "cube"), F.col("cube"))
    matrices = [F.when(fine & (kind == "dcp"), F.col(c)).alias(c) for c in [f"{p}{i}{j}" for p in "fk" for i in range(3) for j in range(3)]]
    return rows.select(*requests.columns, content.alias("content"), error.alias("error"), *matrices)


def contract_digest(letters: int = 16) -> Column:
    """The first ``letters`` of the SHA-256 of the contract's JSON without white space, from columns as in ``profile_json``."""
    text = joined(pretty(contract_layout(F.col, quoted)))
    return F.left(F.sha2(F.regexp_replace(text, r"\n *|(?<=\":) ", ""), 256), F.lit(letters))


def clf_text(stages: DataFrame, places: int | None = None) -> DataFrame:
    """``stages`` with clf: a process list of two matrices, reciprocal scales (0 for a scale of 0) and the colour matrix; numbers keep every bit, or
    are rounded to ``places``. Where there are the columns of a sealed profile (digest, make, model and the contract's), the list is named by the
    profile's digest, and says what it takes."""
    scale = [F.coalesce(1 / F.nullif(F.col("exposure") * F.col(c), F.lit(0.0)), F.lit(0.0)) for c in ("c_r", "c_g", "c_b")]
    zero = F.lit(0.0)
    diagonal = [[scale[i] if i == j else zero for j in range(3)] for i in range(3)]
    colour = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]

    def matrix(title: str, m) -> list:
        rows: list = [f'    <Matrix inBitDepth="32f" outBitDepth="32f">\n        <Description>{title}</Description>\n        <Array dim="3 3">\n']
        for r in m:
            rows += ["            ", text_number(r[0], places), " ", text_number(r[1], places), " ", text_number(r[2], places), "\n"]
        return [*rows, "        </Array>\n    </Matrix>\n"]

    first = '<?xml version="1.0" encoding="UTF-8"?>\n<ProcessList compCLFversion="3.0"'
    head: list = [first, ">\n"]
    if "digest" in stages.columns:
        camera = F.concat_ws(" ", "make", "model")
        takes = ["    <InputDescriptor>normalized linear camera RGB, decode contract digest ", contract_digest(), ", camera ", camera, "</InputDescriptor>\n"]
        head = [first, ' id="profile-', F.left(F.col("digest"), F.lit(12)), '">\n    <Description>profile ', F.col("digest"), "</Description>\n", *takes]
    head.append("    <OutputDescriptor>linear sRGB D65</OutputDescriptor>\n")
    return stages.withColumn("clf", joined([*head, *matrix("channel and exposure scaling", diagonal), *matrix("color matrix", colour), "</ProcessList>\n"]))


def parsed_clf(df: DataFrame, clf: str = "clf") -> DataFrame:
    """``df`` with values (18 numbers, by matrix, row and column) and error: the first of an array that does not end, a word that is no number, an
    array that has not nine, and a list that has not two."""
    opens, arrays = F.regexp_count(clf, F.lit("<Array")), F.regexp_extract_all(clf, F.lit(r"<Array[^>]*>([^<]*)</Array>"), F.lit(1))
    words = F.transform(arrays, lambda a: F.filter(F.split(F.trim(F.regexp_replace(a, r"\s+", " ")), " "), lambda w: w != ""))
    numbers = F.transform(words, lambda ws: F.transform(ws, lambda w: w.try_cast("double")))
    bad = F.exists(numbers, lambda a: F.exists(a, lambda v: v.isNull()))
    error = (
        F.when(opens != F.size(arrays), "missing closing </Array> tag in CLF")
        .when(bad, "invalid float in Array")
        .when(F.exists(numbers, lambda a: F.size(a) != 9), "expected 9 float values in 3x3 Array")
        .when(F.size(numbers) != 2, "expected exactly 2 Matrix Array nodes")
    )
    return df.withColumns({"error": error, "values": F.when(error.isNull(), F.flatten(numbers))})


def cube_text(nodes: DataFrame, size: int) -> DataFrame:
    """frame, cube: the LUT's text, red fastest; ``size`` cubed lines a frame, so a frame's text is bounded."""
    line = F.concat_ws(" ", *(F.format_string("%.6f", F.round(F.col(f"out_{c}"), 6) + F.lit(0.0)) for c in "rgb"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("node", line.alias("line")))), lambda n: n["line"])
    head = F.lit(f"LUT_3D_SIZE {size}\nDOMAIN_MIN 0 0 0\nDOMAIN_MAX 1 1 1\n")
    return nodes.groupBy("frame").agg(F.concat(head, F.array_join(lines, "\n"), F.lit("\n")).alias("cube"))


def canonical_path(path: Column) -> Column:
    """A path without empty parts, ``.`` and ``..``; the latter takes the part before it, if there is one."""
    first = F.array().cast("array<string>")

    def step(done, part):
        return (
            F.when((part == "") | (part == "."), done)
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), first, step), "/"))


def library_listing(entries: DataFrame, major: str = "1") -> DataFrame:
    """Folders of a library as entries or problems: ``entries`` (entry_id, profile_error, has_entry, schema_version, entry_digest, digest, ...) without
    those whose name starts with a dot, with problem: the first that holds, null for an entry that loads."""
    c = F.col
    problem = (
        F.when(c("profile_error").isNotNull(), F.concat(F.lit("invalid profile: "), c("profile_error")))
        .when(~c("has_entry"), "cannot read entry.json")
        .when(F.substring_index("schema_version", ".", 1) != major, F.concat(F.lit("unsupported entry.json schema version "), c("schema_version")))
        .when(~c("entry_digest").eqNullSafe(c("digest")), "entry does not match its profile")
    )
    return entries.filter(~c("entry_id").startswith(".")).withColumn("problem", problem)


def badges() -> Column:
    """Badges of an entry: its status, and one for a profile measured from a rendered image."""
    status = F.when(F.col("overridden"), "OVERRIDDEN").when(F.col("passed"), "PASSED").otherwise("FAILED")
    return F.array_compact(F.array(status, F.when(F.col("quick_and_dirty"), "QUICK & DIRTY")))


def card() -> dict[str, Column]:
    """What a library card shows."""
    number = lambda c: fixed(F.col(c), 2)
    return {
        "title": F.col("label"),
        "camera": F.trim(F.concat_ws(" ", "make", "model")),
        "badges": F.array_join(badges(), ", "),
        "delta_e": F.concat(F.lit("ΔE mean "), number("mean_delta_e"), F.lit(" / max "), number("max_delta_e")),
        "decoder": F.trim(F.concat_ws(" ", "decoder", "decoder_version")),
    }


def batch_results(outcomes: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row a file: file, status, detail. ``outcomes``: file, status (written, skipped, failed), error; ``warnings``: file, warning, of which
    failed files show none. A file's warnings are few; those of all files are never together."""
    found = warnings.groupBy("file").agg(F.array_sort(F.collect_set("warning")).alias("found"))
    texts = F.coalesce("found", F.array().cast("array<string>"))
    detail = (
        F.when(F.col("status") == "failed", F.array("error"))
        .when(F.col("status") == "skipped", F.concat(F.array(F.lit("Output exists; not overwritten.")), texts))
        .otherwise(texts)
    )
    return outcomes.join(found, "file", "left").select("file", "status", detail.alias("detail"))


def batch_counts(outcomes: DataFrame, total: Column) -> DataFrame:
    """total, succeeded, skipped, failed, remaining: what a run that was stopped has left."""
    count = lambda s: F.count_if(F.col("status") == s)
    done = count("written") + count("skipped") + count("failed")
    return outcomes.agg(
        F.max(total).alias("total"), count("written").alias("succeeded"), count("skipped").alias("skipped"), count("failed").alias("failed"), (F.max(total) - done).alias("remaining")
    )


def batch_summary_json(counts: DataFrame, settings: dict[str, str | int | None]) -> DataFrame:
    """json: a run's settings and counts, keys in kebab case. Its files are rows of ``batch_results``."""
    fixed = [F.lit(v).alias(k) for k, v in settings.items()]
    columns = [F.col(c) for c in ("succeeded", "skipped", "failed", "total")]
    return counts.select(F.to_json(F.struct(*fixed, *columns), {"ignoreNullFields": "false"}).alias("json"))


ENTRY_VERSION, ID_LETTERS = "1.0", 8


def library_saves(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """``requests`` (place, label, notes, tags, json of a profile, reference_digest, and the capture's make, model, lens, iso, captured_at, latitude, longitude,
    altitude, include_gps) with name, entry (the JSON to be stored) and error, as if saved one after another by place into a library with the folders
    ``existing`` (name). The name is the label's slug and the first letters of the profile's digest, numbered where it is taken; only a
    request without an error takes one. A label of blanks, a profile that is refused and a reference that is not the profile's are errors."""
    key = F.sha2("json", 256)
    facts = requests.select("place", key.alias("_key"), F.trim("label").alias("_label"), F.lower("reference_digest").alias("_reference"))
    # many requests share a profile, which is long: each is verified once
    profiles = requests.groupBy(key.alias("_key")).agg(F.any_value("json").alias("json"))
    profiles = verified(profiles).select("_key", "error", F.get_json_object("json", "$.digest").alias("_digest"), F.lower(F.get_json_object("json", "$.reference-digest")).alias("_of"))
    profiles = small(written(profiles, "profiles"))
    facts = facts.withColumn("_key", F.coalesce("_key", F.lit(""))).join(profiles.withColumn("_key", F.coalesce("_key", F.lit(""))), "_key")
    wrong = F.concat(F.lit("the reference does not belong to this profile: its digest is "), "_reference", F.lit(", the profile was derived from "), "_of")
    error = F.when(F.coalesce("_label", F.lit("")) == "", "the library entry needs a label").when(F.col("error").isNotNull(), F.col("error")).when(~F.col("_reference").eqNullSafe(F.col("_of")), wrong)
    stem = F.concat(slug(F.col("_label")), F.lit("-"), F.left(F.col("_digest"), F.lit(ID_LETTERS)))
    facts = written(facts.select("place", "_label", "_digest", error.alias("error"), F.when(error.isNull(), stem).alias("stem")), "saves")
    named = free_names(facts.filter("error is null").select("place", "stem"), existing).select("place", "name")
    rows = requests.join(facts, "place").join(named, "place", "left")
    number = lambda c: F.coalesce(json_number(F.col(c)), F.lit("null"))
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    tags = clean_tags(F.col("tags"))
    listed = F.when(F.size(tags) == 0, "[]").otherwise(F.concat(F.lit("[\n    "), F.array_join(F.transform(tags, quoted), ",\n    "), F.lit("\n  ]")))
    place = F.concat(F.lit('{\n      "latitude": '), number("latitude"), F.lit(',\n      "longitude": '), number("longitude"), F.lit(',\n      "altitude": '), number("altitude"), F.lit("\n    }"))
    gps = F.when(F.col("include_gps") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place).otherwise("null")
    entry = {
        "schema-version": F.lit(f'"{ENTRY_VERSION}"'),
        "label": quoted(F.col("_label")),
        "notes": text("notes"),
        "tags": listed,
        "profile-digest": quoted(F.col("_digest")),
        "capture": {"make": text("make"), "model": text("model"), "lens": text("lens"), "iso": F.coalesce(F.col("iso").cast("string"), F.lit("null")), "date-time": text("captured_at"), "gps": gps},
    }
    error = F.when(F.col("error").isNull() & F.col("name").isNull(), "no free name for this library entry").otherwise(F.col("error"))
    return rows.select(*requests.columns, "name", F.when(error.isNull(), joined(pretty(entry))).alias("entry"), error.alias("error"))
