"""As-of joins, deadlines with extensions, and bands: ties, open ends, gaps, hot keys."""

import random
from datetime import datetime, timedelta

import pytest

from gradeloom.operators import deadlines, grading
from gradeloom.operators.asof import as_of

NOON = datetime(2024, 3, 10, 12)


def days(n):
    return NOON + timedelta(days=n)


def as_of_loop(left, right):
    out = []
    for row in left:
        known = [r for r in right if r[0] is not None and r[0] == row[0] and row[1] is not None and r[1] is not None and r[1] <= row[1]]
        best = max(known, key=lambda r: (r[1], r[2] is not None, r[2] or 0), default=None)
        out.append((*row, best[2] if best else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_as_of_equals_a_loop_with_a_hot_key(spark, partitions):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), rng.choice([None, *range(40)]), i) for i in range(300)] + [("hot", 5, 1)] * 3
    right = [(key(), rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3])) for _ in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lefts, rights = spark.createDataFrame(left, "k string, at int, id int"), spark.createDataFrame(right, "k string, since int, v int")
        got = as_of(lefts, rights, ["k"], "at", "since", ["v"])
        assert got.columns == ["k", "at", "id", "v"]
        assert sorted(map(tuple, got.collect()), key=str) == as_of_loop(left, right)
        assert as_of(lefts, rights.limit(0), ["k"], "at", "since", ["v"]).filter("v is not null").count() == 0
        assert as_of(lefts.limit(0), rights, ["k"], "at", "since", ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


ATTEMPTS = "id long, student long, task string, at timestamp, score double"


def test_deadlines_extensions_and_penalties(spark):
    attempts = [
        (1, 1, "t", days(0), 10.0),  # before any deadline was announced
        (2, 1, "t", days(1), 10.0),  # announced at this very moment
        (3, 1, "t", days(4), 10.0),  # two days late
        (4, 2, "t", days(4), 10.0),  # extended by three days
        (5, 2, "t", days(5), 10.0),  # that extension has just ended, an open one of one day holds
        (6, 3, "t", days(6), 10.0),  # a newer deadline
        (7, 1, "t", days(30), 10.0),  # past the most
        (8, 1, "other", days(3), None),
        (9, None, None, None, 10.0),
        (3, 1, "t", days(4), 10.0),  # repeated row
    ]
    due = [("t", days(1), days(2)), ("t", days(1), days(1.5)), ("t", days(6), days(8)), ("other", days(0), days(2)), ("t", None, days(99))]
    extra = [("t", 2, days(3), days(5), 3), ("t", 2, days(3), days(5), 2), ("t", 2, None, None, 1), ("t", 9, None, None, 50), ("t", 1, days(4.5), days(5), 9)]
    placed = deadlines.effective_deadlines(
        spark.createDataFrame(attempts, ATTEMPTS),
        spark.createDataFrame(due, "task string, effective_from timestamp, deadline timestamp"),
        spark.createDataFrame(extra, "task string, student long, valid_from timestamp, valid_to timestamp, days int"),
        "task",
        "student",
        "at",
    )
    got = deadlines.late_penalties(placed, "score", "at", 0.1, 0.5)
    rows = sorted((r["id"], r["extra_days"], r["days_late"], r["penalty"], r["final_score"]) for r in got.filter("id <> 8").collect())
    assert rows == [
        (1, 0, 0, 0.0, 10.0),
        (2, 0, 0, 0.0, 10.0),
        (3, 0, 2, 0.2, 8.0),
        (3, 0, 2, 0.2, 8.0),
        (4, 3, 0, 0.0, 10.0),
        (5, 1, 2, 0.2, 8.0),
        (6, 0, 0, 0.0, 10.0),
        (7, 0, 22, 0.5, 5.0),
        (9, 0, 0, 0.0, 10.0),
    ]
    other = got.filter("id = 8").first()
    assert (other["days_late"], other["final_score"]) == (1, None)


BANDS = "task string, band string, low double, high double"


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_bands_by_section_gaps_and_open_ends(spark, monkeypatch, broadcast):
    monkeypatch.setattr(grading, "BROADCAST_BANDS", broadcast)
    bands = [("a", "low", 0.0, 5.0), ("a", "high", 6.0, None), ("b", "only", -1.0, 1.0), (None, "never", 0.0, 1.0)]
    scores = [(1, "a", 0.0), (2, "a", 5.0), (3, "a", 6.0), (4, "a", 1e9), (5, "b", -1.0), (6, "b", 1.0), (7, "c", 0.5), (8, None, 0.5), (9, "a", None), (1, "a", 0.0)]
    df = spark.createDataFrame(scores, "id int, task string, score double")
    got = grading.grade_bands(df, "score", spark.createDataFrame(bands, BANDS), ["task"])
    assert got.columns == ["id", "task", "score", "band"]
    assert sorted((r["id"], r["band"]) for r in got.collect()) == [(1, "low"), (1, "low"), (2, None), (3, "high"), (4, "high"), (5, "only"), (6, None), (7, None), (8, None), (9, None)]
    assert grading.grade_bands(df, "score", spark.createDataFrame([], BANDS), ["task"]).filter("band is not null").count() == 0


@pytest.mark.parametrize("second", [(4.0, 9.0), (5.0, 5.0), (0.0, 1.0), (-3.0, None)])
def test_bands_that_overlap_or_are_empty_raise(spark, second):
    bands = [("a", "one", 0.0, 5.0), ("a", "two", *second)]
    with pytest.raises(ValueError, match="overlap"):
        grading.grade_bands(spark.createDataFrame([(1.0,)], "score double"), "score", spark.createDataFrame(bands, BANDS).drop("task"))
