"""Tasks of tiled windows follow the rows."""

from tintframe.operators import stencil


def test_tasks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(stencil, "TASK_ROWS", 50)
    sites = spark.range(900).selectExpr("cast(0 as int) frame", "cast(id div 30 as int) y", "cast(id % 30 as int) x", "cast(id as double) value")
    tiled = stencil.with_halo(sites, 2, 5)
    assert tiled.rdd.getNumPartitions() >= tiled.count() / 50
