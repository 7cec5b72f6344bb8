"""A profile that many requests share is verified once."""

from pyspark.sql import functions as F

from tintframe.operators import records


def test_profiles_are_verified_once(spark, monkeypatch):
    counts, verified = [], records.verified
    monkeypatch.setattr(records, "verified", lambda sealed: counts.append(sealed.count()) or verified(sealed))
    rows = spark.range(40).select(F.col("id").alias("place"), F.lit("a").alias("label"), F.lit("n").alias("notes"), F.array(F.lit("t")).alias("tags"), F.when(F.col("id") % 2 == 0, "{").alias("json"), F.lit("d").alias("reference_digest"))
    kinds = {"make": "string", "model": "string", "lens": "string", "iso": "int", "captured_at": "string", "latitude": "double", "longitude": "double", "altitude": "double", "include_gps": "boolean"}
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    got = records.library_saves(rows, spark.createDataFrame([], "name string")).select("place", "name", "error").collect()
    assert len(got) == 40 and {r.error for r in got} == {"invalid profile JSON"} and counts == [2]
