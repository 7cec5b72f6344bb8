"""Chart errors are found by hashed partial sums, without a sort of all patches."""

from tintframe.operators import acceptance


def test_chart_errors_sort_no_patches(spark):
    names = spark.createDataFrame([(i, f"p{i}") for i in range(24)], "patch_idx int, patch string")
    odd = {(1, 3): ("q", "l", 1.0), (2, 5): ("p5", " ", 1.0), (3, 9): ("p9", "l", float("inf")), (4, 30): ("p30", "l", 1.0)}
    rows = [(d, i, *odd.get((d, i), (f"p{i}", "l", 1.0)), 1.0, 1.0) for d in range(5) for i in ([*range(23), 30] if d == 4 else range(24))]
    patches = spark.createDataFrame(rows, "dataset int, patch_idx int, patch string, label string, x double, y double, big_y double")
    facts = spark.createDataFrame([(d, *(v for _, v in acceptance.CHART_FACTS)) for d in range(5)], ["dataset", *(c for c, _ in acceptance.CHART_FACTS)])
    found = acceptance.chart_errors(facts, patches, names)
    want = {0: None, 1: "patch 3 must be p3", 2: "patch 5 has no label", 3: "patch 9 is not finite", 4: "patch 30 must be absent"}
    assert {r.dataset: r.error for r in found.collect()} == want
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
