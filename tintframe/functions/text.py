"""String, hash and tag functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG_CHARS = 40


def slug(label: Column) -> Column:
    """ASCII letters and digits in lower case, joined by single dashes, of at most 40 characters; ``entry`` when nothing is left."""
    dashed = F.translate(F.regexp_replace(label, "[^A-Za-z0-9]+", "-"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.rtrim(F.substring(F.trim(dashed, F.lit("-")), 1, SLUG_CHARS), F.lit("-"))
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("entry"))


def clean_tags(tags: Column) -> Column:
    """Trimmed, without empty ones, first occurrences in order; upper and lower case differ."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))


def tags_without_case(tags: Column) -> Column:
    """Trimmed, without empty ones; of those that differ in case alone the first, in order."""
    clean = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    known = lambda done, t: F.exists(done, lambda d: F.lower(d) == F.lower(t))
    return F.aggregate(clean, F.array().cast("array<string>"), lambda done, t: F.when(known(done, t), done).otherwise(F.array_append(done, t)))


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def fixed(value: Column, places: int) -> Column:
    """A double with ``places`` decimals, rounded by its exact value, a tie to the even digit. ``format_string`` rounds the shortest decimal that reads back as
    the double, half up: where that ends in a five just beyond ``places``, and the double is no larger, the next smaller one is formatted."""
    size, scale = F.abs(value), 10.0 ** (places + 1)
    # Dekker's split: the upper half times the scale is exact, and so is its distance from the nearest whole number
    high = size * 134217729.0 - (size * 134217729.0 - size)
    near = F.rint(size * scale)
    beyond = (high * scale - near) + (size - high) * scale
    even = F.floor(near / 10) % 2 == 0
    down = (size * scale < 2.0**52) & (near % 10 == 5) & ((beyond < 0) | ((beyond == 0) & even))
    return F.format_string(f"%.{places}f", F.when(down, value * (1 - 2.0**-52)).otherwise(value))


def file_sha256(content: Column) -> Column:
    """The digest of a text with LF line ends, in lower-case hexadecimal."""
    return F.sha2(F.replace(content, F.lit("\r\n"), F.lit("\n")), 256)


def schema_major(version: Column) -> Column:
    return F.substring_index(version, ".", 1)


def parse_quad(text: Column) -> Column:
    """Eight numbers separated by commas; null unless there are exactly eight."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(parts) == 8) & F.forall(parts, lambda p: p.isNotNull()), parts)


def sniff(content: Column) -> Column:
    """``rendered`` for JPEG or PNG magic bytes, ``raw`` for all else; names are never trusted."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("FFD8FF") | (head == "89504E470D0A1A0A"), "rendered").otherwise("raw")


def default_quad(width: Column, height: Column, inset: float = 0.08) -> Column:
    """The frame's rectangle, inset by a share of its sides: eight numbers from top left, clockwise."""
    left, right, top, bottom = width * inset, width * (1 - inset), height * inset, height * (1 - inset)
    return F.array(left, top, right, top, right, bottom, left, bottom)
