"""Free names for many requests, as if each were served after the one before it: ``stem``, then numbered ones.

A name ``p-k`` can be wanted by two only: stem ``p``, as its k-th made name, and stem ``p-k``, as its own. Numbers that are taken before ``p``
makes any name are gaps in its count, found by running counts. Where ``p`` may come first, the two stems are in conflict;
those few stems, by connected groups, are settled in order, and only the requests that can reach a contested number take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: A made name: a stem, a dash, and a number that no request count exceeds.
MADE = r"^(.+)-([1-9][0-9]{0,8})$"


def _parsed(names: DataFrame, name: str, first: int) -> DataFrame:
    """``names`` that may be made ones, with parent and slot (1 for the first made name)."""
    k = F.regexp_extract(name, MADE, 2).try_cast("int")
    return names.withColumns({"parent": F.regexp_extract(name, MADE, 1), "slot": k - (first - 1)}).filter("slot >= 1")


def _nth_free(wanted: DataFrame, gaps: DataFrame) -> DataFrame:
    """``wanted`` (stem, nth, ...) with slot: the nth slot from 1 that is not among the stem's ``gaps`` (stem, slot). The gap of rank r lies before
    the nth free slot if slot - r < nth, so the free slot is nth plus the last such rank."""
    rank = F.row_number().over(Window.partitionBy("stem").orderBy("slot"))
    marks = gaps.withColumn("rank", rank).select("stem", (F.col("slot") - F.col("rank") + 1).alias("nth"), "rank")
    running = Window.partitionBy("stem").orderBy("nth", F.col("rank").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(wanted, allowMissingColumns=True)
    both = both.withColumn("before", F.max("rank").over(running)).filter("rank is null").drop("rank")
    return both.withColumn("slot", F.col("nth") + F.coalesce("before", F.lit(0))).drop("before")


def _settle(pdf):
    """Rows (stem, shifts) of one group of conflicting stems: from which request on how many slots are skipped."""
    import pandas as pd

    lost, out = dict.fromkeys(pdf["stem"], False), []
    lost.update(pdf.loc[pdf["gone"], ["stem", "gone"]].itertuples(index=False))
    for stem, rows in sorted(pdf.groupby("stem"), key=lambda g: (g[0].count("-"), g[0])):
        kids = {int(r.nth): (r.place, r.child) for r in rows[rows["child"].notna()].itertuples()}
        shift, shifts = int(lost[stem]), []
        shifts.append((0, shift))
        for r in rows[rows["child"].isna() & rows["i"].notna()].sort_values("i").itertuples():
            at = int(r.i) + shift
            while at in kids and kids[at][0] < r.place:  # its own stem had it before
                at += 1
            if at - int(r.i) != shift:
                shift = at - int(r.i)
                shifts.append((int(r.i), shift))
            if at in kids:
                lost[kids[at][1]] = True
        out.append((stem, [{"from": i, "by": s} for i, s in shifts]))
    return pd.DataFrame(out, columns=["stem", "shifts"])


def assign_names(requests: DataFrame, first: int = 1, existing: DataFrame | None = None) -> DataFrame:
    """``requests`` (stem, and place, a whole number no two share) with name and slot, served in order of place: the first of ``stem``, ``stem-first``,
    ``stem-(first + 1)`` and so on that neither ``existing`` (name) nor an earlier request has; slot is 0 for the stem itself. A null stem
    gets no name. Names are compared as they are written.
    """
    order = Window.partitionBy("stem").orderBy("place")
    rows = written(requests.filter("stem is not null").withColumn("i", F.row_number().over(order) - 1), "requests")
    taken = existing.select("name").distinct() if existing is not None else requests.sparkSession.createDataFrame([], "name string")
    stems = rows.groupBy("stem").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.min(F.when(F.col("i") == 1, F.col("place"))).alias("second"), F.max("place").alias("last"))
    gone = taken.select(F.col("name").alias("stem"), F.lit(True).alias("gone"))
    stems = written(stems.join(gone, "stem", "left").withColumn("gone", F.coalesce("gone", F.lit(False))), "stems")
    kids = _parsed(stems, "stem", first).select(F.col("parent").alias("stem"), "slot", F.col("stem").alias("child"), F.col("first").alias("place"))
    old = _parsed(taken, "name", first).select(F.col("parent").alias("stem"), "slot")
    # a stem that may find its own name taken makes one with its first request, others with their second
    family = kids.join(stems.select("stem"), "stem", "left_semi").select(F.col("child").alias("stem")).withColumn("kid", F.lit(True))
    start = F.when(F.col("gone") | F.col("kid"), F.col("first")).otherwise(F.col("second"))
    makers = stems.join(family, "stem", "left").withColumn("kid", F.coalesce("kid", F.lit(False))).withColumn("start", start).filter("start is not null")
    pairs = kids.join(makers.select("stem", "n", "start", "last"), "stem")
    fixed = pairs.filter("place < start").select("stem", "slot").unionByName(old.join(makers.select("stem"), "stem", "left_semi"))
    fixed = written(fixed.distinct(), "gaps")
    open_ = written(pairs.filter("place > start").join(fixed, ["stem", "slot"], "left_anti"), "contested")
    shifts = None
    if not open_.isEmpty():
        # each request goes one slot on, and past those whose own stem comes before the last request
        most = open_.groupBy("stem").agg((F.max("n") + F.count_if(F.col("place") < F.col("last"))).cast("int").alias("nth"))
        reach = _nth_free(most, fixed).select("stem", F.col("slot").alias("reach"))
        open_ = open_.join(reach, "stem").filter("slot <= reach").select("stem", "slot", "child", "place")
        # contested slots counted as the requests do, without the gaps
        gap = F.count(F.when(F.col("child").isNull(), 1)).over(Window.partitionBy("stem").orderBy("slot"))
        both = open_.unionByName(fixed, allowMissingColumns=True).withColumn("nth", F.col("slot") - gap)
        open_ = written(both.filter("child is not null").select("stem", "nth", "child", "place"), "contested")
        members = open_.select("stem").union(open_.select("child")).distinct()
        # a group's name is the nearest ancestor that is in no conflict with its own parent
        up = members.select("stem", F.posexplode(F.expr(f"""transform(sequence(0, size(split(stem, '-'))), i -> regexp_replace(stem, concat('(?<=.)(-[1-9][0-9]{{0,8}}){{', i, '}}$'), ''))""")).alias("level", "top"))
        up = up.filter((F.col("level") == 0) | (F.col("top") != F.col("stem"))).join(open_.select(F.col("child").alias("top"), F.lit(1).alias("under")).distinct(), "top", "left")
        roots = up.filter("under is null").groupBy("stem").agg(F.min_by("top", "level").alias("root"))
        own = open_.groupBy("stem").agg(F.max("nth").alias("last"))
        near = rows.join(own, "stem").filter("i <= last").select("stem", "i", "place")
        facts = near.unionByName(open_, allowMissingColumns=True).unionByName(members, allowMissingColumns=True)
        facts = facts.join(roots, "stem").join(stems.select("stem", "gone"), "stem").select("root", "stem", "i", "place", "nth", "child", "gone")
        shifts = written(facts.groupBy("root").applyInPandas(_settle, "stem string, shifts array<struct<from:long,by:long>>"), "shifts")
        rows = rows.join(shifts, "stem", "left")
        shift = F.array_max(F.transform(F.filter("shifts", lambda s: s["from"] <= F.col("i")), lambda s: s["by"]))
        shift = F.coalesce(shift, F.col("gone").cast("long"))
    else:
        shift = F.col("gone").cast("long")
    rows = rows.join(stems.filter("gone").select("stem", "gone"), "stem", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    rows = rows.withColumn("nth", (F.col("i") + shift).cast("int"))
    plain = [c for c in requests.columns]
    # only stems that have gaps count past them
    gapped = fixed.select("stem").distinct().withColumn("gapped", F.lit(True))
    rows = rows.join(gapped, "stem", "left")
    easy = rows.filter("gapped is null or nth = 0").select(*plain, F.col("nth").alias("slot"))
    hard = _nth_free(rows.filter("gapped and nth > 0").select(*plain, "nth"), fixed).select(*plain, "slot")
    name = F.when(F.col("slot") == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), (F.col("slot") + (first - 1)).cast("string")))
    return easy.unionByName(hard).withColumn("name", name)
