"""Small linear systems solved in columns, one a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def eliminated(matrix: Column, unknowns: int, least: float) -> Column:
    """The right sides solved, rows of an array of arrays with ``unknowns`` rows, each of as many coefficients and then its right sides. Every column
    is cleared by the row with the largest entry there (the last one of those), which goes up; null where no entry reaches ``least``,
    or where a value is null."""
    n = unknowns

    def cleared(m: Column, c: Column) -> Column:
        sizes = F.transform(F.sequence(c, F.lit(n - 1)), lambda i: F.struct(F.abs(F.get(F.get(m, i), c)).alias("size"), i.alias("at")))

        def swapped(top: Column) -> Column:
            up = F.transform(m, lambda row, i: F.when(i == c, F.get(m, top["at"])).when(i == top["at"], F.get(m, c)).otherwise(row))
            return F.when(top["size"] >= F.lit(least), let(up, without))

        def without(rows: Column) -> Column:
            pivot = F.get(rows, c)
            factor = lambda row: F.get(row, c) / F.get(pivot, c)
            return F.transform(rows, lambda row, i: F.when(i == c, row).otherwise(let(factor(row), lambda k: F.zip_with(row, pivot, lambda a, b: a - k * b))))

        return let(F.array_max(sizes), swapped)

    steps = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, cleared)
    sides = F.transform(steps, lambda row, i: F.transform(F.slice(row, n + 1, F.size(row) - n), lambda v: v / F.get(row, i)))
    whole = F.forall(matrix, lambda row: F.forall(row, lambda v: v.isNotNull() & ~F.isnan(v)))
    return F.when(whole, sides)
