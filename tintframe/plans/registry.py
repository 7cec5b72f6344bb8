"""Every registered query of the library and the SQL it is checked with."""

from __future__ import annotations

from . import calibration, files, images, records, rules

QUERIES: dict = {**calibration.QUERIES, **files.QUERIES, **images.QUERIES, **records.QUERIES, **rules.QUERIES}
SQL: dict = {**calibration.SQL, **files.SQL, **images.SQL, **records.SQL, **rules.SQL}
