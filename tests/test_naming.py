"""Free names against the rule served one request after another."""

import random

import pytest

from tintframe.operators import batch, naming


def served(stems, first, taken=()):
    taken, out = set(taken), []
    for s in stems:
        name, k = s, first
        while name in taken:
            name, k = f"{s}-{k}", k + 1
        taken.add(name)
        out.append(name)
    return out


def named(spark, stems, first, have=()):
    rows = spark.createDataFrame([(10 * i, s) for i, s in enumerate(stems)], "place long, stem string").repartition(3)
    existing = spark.createDataFrame([(n,) for n in have], "name string")
    got = {r.place: r.name for r in naming.assign_names(rows, first, existing).collect()}
    return [got[10 * i] for i in range(len(stems))]


@pytest.mark.parametrize("seed", range(4))
def test_against_one_after_another(spark, seed):
    draw = random.Random(seed)
    stems = []
    for batch_no in range(12):  # many independent families in one run
        pool = [f"f{batch_no}" + e for e in ("", "-1", "-2", "-3", "-5", "-1-1", "-2-1", "-1-1-2", "-02", "-0", "-x")]
        stems += [draw.choice(pool[: draw.randint(1, len(pool))]) for _ in range(draw.randint(1, 14))]
    draw.shuffle(stems)
    first = 1 + seed % 2
    have = draw.sample([s + e for s in stems for e in ("", "-1", "-2", "-3", "-4")], 25) if seed > 1 else []
    assert named(spark, stems, first, have) == served(stems, first, have)


def test_library_names(spark):
    have = ["a", "a-2", "a-4", "b-2", "c", "c-02", "c-1", "d-x", "d", "e-2", "e-2-2"]
    stems = ["portrait", "portrait", "a", "b", "c", "d", "e", "e-2", "z", "portrait", "a", "a", "portrait-3", "portrait"]
    want = served(stems, 2, have)
    assert named(spark, stems, 2, have) == want and want[:2] == ["portrait", "portrait-2"]
    rows = spark.createDataFrame([(0, "portrait"), (1, "portrait"), (2, "portrait"), (3, None)], "place long, stem string")
    taken = spark.createDataFrame([("portrait",)], "name string")
    got = [r.name for r in batch.free_names(rows, taken).orderBy("place").collect()]
    assert got == ["portrait-2", "portrait-3", "portrait-4", None]
    assert [r.name for r in batch.free_names(rows, taken, 3).orderBy("place").collect()] == ["portrait-2", "portrait-3", None, None]


def test_numbered_shoots_settle_apart(spark, monkeypatch):
    """A shoot of numbered files, met by two files of its bare stem, has no conflict group at all or one of a few rows."""
    seen = []
    settle = naming.F.row_number  # plain column work stays as it is

    def spy(df, name):
        if name in ("contested", "shifts"):
            seen.append((name, df.count()))
        return kept(df, name)

    kept = naming.written
    monkeypatch.setattr(naming, "written", spy)
    stems = [f"img-{i}" for i in range(1, 20_001)] + ["img", "img"]
    rows = spark.createDataFrame(list(enumerate(stems)), "place long, stem string")
    got = {r.place: r.name for r in naming.assign_names(rows).collect()}
    assert [got[i] for i in range(len(stems))] == [*stems[:-1], "img-20001"]
    assert seen == [("contested", 0)] and settle
    early = spark.createDataFrame(list(enumerate(["img", "img", *stems[:-2]])), "place long, stem string")
    seen.clear()
    got = {r.place: r.name for r in naming.assign_names(early).collect()}
    assert [got[i] for i in range(4)] == ["img", "img-1", "img-1-1", "img-2"] and len(set(got.values())) == len(stems)
    assert dict(seen)["shifts"] <= 4
