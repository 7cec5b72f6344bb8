"""Capture facts from raw metadata fields, as column expressions: anything blank, malformed or out of range is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = r"^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})"


def known_text(raw: Column) -> Column:
    return F.nullif(F.regexp_replace(raw, r"^[\s\x00]+|[\s\x00]+$", ""), F.lit(""))


def iso(speed: Column, sensitivity: Column) -> Column:
    """The 32-bit speed if positive, else the 16-bit sensitivity unless it is 0 or saturated."""
    return F.when(speed > 0, speed).when((sensitivity > 0) & (sensitivity < 65535), sensitivity)


def capture_time(raw: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` without a zone. Fields are checked one by one, so 31 February passes."""
    part = [F.regexp_extract(raw, STAMP, k) for k in range(1, 7)]
    number = [p.try_cast("int") for p in part]
    fine = number[1].between(1, 12) & number[2].between(1, 31) & (number[3] < 24) & (number[4] < 60) & (number[5] < 60)
    return F.when(raw.rlike(STAMP) & fine, F.concat(F.concat_ws("-", *part[:3]), F.lit(" "), F.concat_ws(":", *part[3:])))


def degrees(d: Column, m: Column, s: Column, side: Column, negative: str, limit: float) -> Column:
    """Signed degrees of degrees, minutes, seconds and a hemisphere letter of either case; null beyond the limit."""
    size = d + m / 60.0 + s / 3600.0
    value = F.when(F.upper(F.substring(side, 1, 1)) == negative, -size).otherwise(size)
    return F.when(side.isNotNull() & (side != "") & (F.abs(value) <= limit), value)


def altitude(numerator: Column, denominator: Column, below: Column) -> Column:
    """Metres above the sea, negative where ``below`` is 1 (any other value, or none, is above); null without a denominator."""
    metres = numerator / F.nullif(denominator, F.lit(0))
    return F.when(F.coalesce(below, F.lit(0)) == 1, -metres).otherwise(metres)
