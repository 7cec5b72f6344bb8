"""Places in a global order, by ranges of the order and the sizes of those ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written


def with_place(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``df`` with its rows' places (from 1) by ``order``, in which no two rows may tie. Rows are dealt by range and sorted within it; a
    place is the sum of the earlier ranges' sizes and the place there, so only one row for each range meets in one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged")  # ranges are drawn anew each time they are computed
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + row + 1).drop("__part", "__before", "__at")
