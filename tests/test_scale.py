"""Jobs on keys that very many rows share, and pages that a recogniser fails on."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from gradeloom.operators import grading
from gradeloom.sources import pages


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_phrase_that_all_answers_and_criteria_hold_makes_no_pairs(spark):
    common = "this phrase is in every answer and in every criterion of the rubric"
    own = [f"criterion {i} alone asks for item number {i} of list {i}" for i in range(40)]
    rubric = spark.createDataFrame([(i, f"{common} {x}") for i, x in enumerate(own)] + [(99, common), (98, None), (97, "too short")], "item int, passage string")
    texts = [(i, f"{common} so I write about other things {i}") for i in range(200)] + [(500, f"{common} {own[3]}"), (501, None), (502, "")]
    answers = spark.createDataFrame(texts, "doc int, text string")
    got = grading.rubric_coverage(answers, rubric, "doc", "text", "item", "passage", n=4, min_share=0.8)
    rows = {(r["doc"], r["item"]): r["share"] for r in got.collect()}
    assert rows == {**{(i, 99): 1.0 for i in range(200)}, (500, 99): 1.0, (500, 3): 1.0}


@pytest.mark.parametrize("min_share", [0.01, 0.34, 0.5, 0.75, 1.0])
def test_rubric_shares_equal_a_loop(spark, min_share):
    import random

    rng = random.Random(7)
    word = lambda: rng.choice("a a a b c d e".split())
    texts = [(i, " ".join(word() for _ in range(rng.randrange(25)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(9)))) for i in range(25)]
    grams = lambda x: {tuple(x.split()[i : i + 3]) for i in range(len(x.split()) - 2)}
    expected = {}
    for i, x in texts:
        for j, y in items:
            if grams(y) and len(grams(x) & grams(y)) / len(grams(y)) >= min_share:
                expected[i, j] = len(grams(x) & grams(y))
    got = grading.rubric_coverage(spark.createDataFrame(texts, "d int, t string"), spark.createDataFrame(items, "i int, p string"), "d", "t", "i", "p", 3, min_share)
    assert {(r["d"], r["i"]): r["grams_found"] for r in got.collect()} == expected


def test_blocks_of_examples_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(grading, "EXEMPLAR_BLOCK", 4)
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(64)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    seen = {}
    try:
        real = grading.materialize

        def noted(table, label):
            seen[label] = plan_of(table)
            return real(table, label)

        monkeypatch.setattr(grading, "materialize", noted)
        got = {r["id"]: r["predicted"] for r in grading.grade_by_exemplar(df, df, 3, "id", "v", "label").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Cross" not in seen["nearest"] and "hashpartitioning(part" in seen["nearest"]
    for i, v, _ in rows:
        near = sorted(rows, key=lambda r: (-sum(a * b for a, b in zip(v, r[1], strict=True)), r[0]))[:3]
        votes = [r[2] for r in near]
        assert got[i] == min(set(votes), key=lambda x: (-votes.count(x), x))


def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch):
    """Tables of a few kB, whose copies for all cells Spark takes to be no larger."""
    monkeypatch.setattr(grading, "EXEMPLAR_BLOCK", 4)
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(70)], "id long, v array<double>, label int").repartition(3)
    seen = {}
    real = grading.materialize

    def noted(table, label):
        seen[label] = plan_of(table)
        return real(table, label)

    monkeypatch.setattr(grading, "materialize", noted)
    kept = grading.grade_by_exemplar(df.filter("id % 4 = 0"), df.filter("id % 4 > 0"), 3, "id", "v", "label").collect()
    assert "Broadcast" not in seen["nearest"] and "hashpartitioning(part" in seen["nearest"]
    monkeypatch.setattr(grading, "PARTS", 1)
    assert sorted(kept) == sorted(grading.grade_by_exemplar(df.filter("id % 4 = 0"), df.filter("id % 4 > 0"), 3, "id", "v", "label").collect())


@pytest.mark.parametrize("n_own, n_near", [(0, 5), (5, 0), (1, 1), (3, 1000), (1000, 3), (30, 120), (500, 2000), (7, 11)])
def test_the_grid_of_blocks_makes_few_copies(n_own, n_near):
    rows, columns = grading._grid(n_own, n_near, 256)
    assert 1 <= rows <= max(1, n_own) and 1 <= columns <= max(1, n_near) and rows * columns <= 256
    # Copies grow with the tables and not with their product.
    assert n_own * columns + n_near * rows <= 2 * (256 * max(1, n_own) * max(1, n_near)) ** 0.5 + 2 * (n_own + n_near)


@pytest.mark.parametrize("k", [1, 2, 5, 9, 10])
def test_best_places_equal_a_whole_sort(k):
    rng = np.random.default_rng(k)
    for scores in (rng.normal(size=(40, 9)), rng.integers(0, 3, (40, 9)).astype(float), np.zeros((3, 9)), np.where(rng.random((40, 9)) < 0.2, np.nan, 1.0), np.where(rng.random((40, 9)) < 0.5, -np.inf, 0.0)):
        assert (grading._best(scores, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()


SCHEMA = T.StructType([T.StructField("page", T.LongType()), T.StructField("text", T.StringType())])


def test_bad_pages_go_to_quarantine_and_the_others_are_read_in_batches(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def recognise(frame: pd.DataFrame) -> pd.DataFrame:
        calls.add(1)
        if (frame["page"] % 1000 == 999).any():
            raise RuntimeError("smudged")
        found = pd.DataFrame({"page": frame["page"], "text": frame["content"].str.upper()})
        return found.iloc[:-1] if (frame["page"] == 5).any() else found

    rows = [(i, f"p{i}") for i in range(4_000)]
    given = spark.createDataFrame(rows, "page long, content string").coalesce(1)
    read, failed = pages.transcribe_with_quarantine(given, recognise, SCHEMA, "page", f"{tmp_path}/out", rows_per_call=500)
    assert sorted(map(tuple, failed.collect())) == [(5, "ValueError: 0 rows for 1 pages"), *[(i, "RuntimeError: smudged") for i in (999, 1999, 2999, 3999)]]
    assert {(r["page"], r["text"]) for r in read.collect()} == {(i, f"P{i}") for i in range(4_000) if i % 1000 != 999 and i != 5}
    assert calls.value < 8 + 5 * 2 * 10


def test_no_page_fails_and_no_page_at_all(spark, tmp_path):
    given = spark.createDataFrame([(1, "a"), (2, None)], "page long, content string")
    copy = lambda frame: pd.DataFrame({"page": frame["page"], "text": frame["content"]})
    read, failed = pages.transcribe_with_quarantine(given, copy, SCHEMA, "page")
    assert (sorted(map(tuple, read.collect())), failed.count()) == ([(1, "a"), (2, None)], 0)
    read, failed = pages.transcribe_with_quarantine(given.limit(0), copy, SCHEMA, "page")
    assert (read.count(), failed.count()) == (0, 0)
