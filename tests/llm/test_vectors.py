import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import vector_search
from gradeloom.llm.vector_search import file_block, scan_block, top_k_inner_product
from gradeloom.session import Scratch, shared_dir

SCHEMA = "vec_id long, embedding array<float>, extra string"


def shared_path(spark):
    return urlparse(shared_dir(spark)).path


def brute(rows, k, asked):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i in asked:
            best = sorted(((-int(v @ w), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def got(spark, rows, k, asked, **more):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    found = top_k_inner_product(df, df.filter(df.vec_id.isin(list(asked))), k=k, **more)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()))


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]
    asked = {0, 3, 50, 201}
    assert got(spark, rows, 5, asked, block_rows=32) == brute(rows, 5, asked)


def test_nulls_lengths_and_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, -0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (None, [1.0, 1.0])]
    assert got(spark, rows, 5, {0, 2, 4, 6}) == brute(rows, 5, {0, 2, 4, 6}) == [(0, 1, 1, 256 * 128)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_k_inner_product(df, df).count() == 0
    one = spark.createDataFrame([(1, [1.0], "x"), (2, [2.0], "x")], SCHEMA)
    assert top_k_inner_product(one, one.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("spread", [300, 300_000])
def test_bounds_lose_nothing(seed, spread):
    rng = np.random.default_rng(seed)
    exact = rng.integers(-spread, spread, size=(500, 16))
    block = {k: v[0] for k, v in file_block(exact, np.arange(500), np.arange(500)).to_pydict().items()}
    asked, ids = exact[[7, 8]], np.array([7, 900])
    scores = asked @ exact.T
    best = [sorted((-int(s), j) for j, s in enumerate(row) if j != i)[:5] for i, row in zip(ids, scores, strict=True)]
    for floors in (np.full(2, -np.inf), np.array([-row[4][0] for row in best], float)):
        found = [x for part in scan_block(asked, ids, floors, block, 5) for x in zip(*part, strict=True)]
        for q, row in enumerate(best):
            kept = {int(v): (low, high) for i, v, low, high in found if i == q}
            assert {j for _, j in row} <= set(kept)
            assert all(low <= scores[q, v] <= high for v, (low, high) in kept.items())
    assert not list(scan_block(asked, ids, np.full(2, 1e18), block, 5))


def test_repeated_rows_ask_once_and_are_candidates_as_often(spark):
    same = [1.0, 0.5]
    rows = [(0, same), (0, same), (1, same), (1, same), (2, same), (3, [0.25, 0.25]), (4, [1.0, 0.0])]
    assert got(spark, rows, 5, {0}) == [(0, 1, 1, 81920), (0, 2, 1, 81920), (0, 3, 2, 81920), (0, 4, 4, 65536), (0, 5, 3, 24576)]
    many = [(1, same)] * 20 + [(2, same), (3, same)]
    assert got(spark, many, 3, {1}) == [(1, 1, 2, 81920), (1, 2, 3, 81920)]
    assert [x[2] for x in got(spark, many, 3, {2})] == [1, 1, 1]


def test_floors_of_a_first_scan_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    asked = {0, 50, 100}
    for share in (1, 2, 1000):
        monkeypatch.setattr(vector_search, "FIRST_SHARE", share)
        monkeypatch.setattr(vector_search, "CELL_BITS", 3)
        assert got(spark, rows, 4, asked, block_rows=16) == brute(rows, 4, asked)


def test_copies_over_many_blocks_and_lengths(spark):
    """Most rows are copies of one vector, blocks are small, and two lengths lie in the same ranges of keys."""
    rng = np.random.default_rng(9)
    rows = [(i, [0.5, 0.25, -0.5] if i % 3 else rng.normal(size=3 + i % 2).round(1).tolist()) for i in range(240)]
    rows += [(7, [0.5, 0.25, -0.5])] * 30
    asked = {0, 1, 7, 90, 150}
    assert sorted(set(got(spark, rows, 5, asked, block_rows=7))) == sorted(set(brute(rows, 5, asked)))


def test_no_vector_is_shuffled_before_the_file_is_made(spark):
    df = spark.createDataFrame([(i % 5, [1.0, float(i % 2)], "x") for i in range(40)], "vec_id long, embedding array<float>, extra string")
    one, two = vector_search.digest_columns(F.col("row"))
    exact = vector_search.exact_rows(df, 256).select(F.monotonically_increasing_id().alias("key"), "vec_id", "row", one.alias("one"), two.alias("two"))
    assert "Exchange" not in exact._jdf.queryExecution().executedPlan().toString()
    exact = Scratch(spark, "vectors").write(exact, "exact")
    surplus = vector_search.surplus_by_block(exact, 2, 8)
    assert "row#" not in surplus._jdf.queryExecution().executedPlan().toString()
    dropped = {key for r in surplus.collect() for key in r["surplus"]}
    kept = [(r["row"], r["vec_id"]) for r in exact.collect() if r["key"] not in dropped]
    # Each of the two vectors has four rows of each id: two rows of ids 0 and 1 are kept.
    assert sorted(kept) == sorted(([256, 256 * odd], i) for odd in (0, 1) for i in (0, 0, 1, 1))
    assert all(key // 8 == r["block"] for r in surplus.collect() for key in r["surplus"])


def test_no_vector_is_broadcast(spark, monkeypatch):
    """Tables of a few kB, whose copies for all groups of blocks Spark takes to be no larger."""
    plans, real = {}, Scratch.write

    def noted(self, df, name, *by):
        plans[name] = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        return real(self, df, name, *by)

    monkeypatch.setattr(Scratch, "write", noted)
    got(spark, [(i, [1.0, i / 10, float(i % 3)]) for i in range(120)], 3, set(range(0, 120, 7)), block_rows=8)
    sent = {name: {c.split("#")[0] for x in re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*)\]", plan) for c in x.split(", ")} for name, plan in plans.items()}
    assert {"first-scan", "second-scan", "first-read", "found"} <= set(sent)
    assert not any(x & {"row", "query", "queries", "cells"} for x in sent.values()), sent
    assert all(re.search(r"SortMergeJoin\nLeft keys \[2\]: \[dim", plans[name]) for name in ("first-scan", "second-scan"))


@pytest.mark.parametrize("n_queries, n_blocks", [(0, 5), (5, 0), (1, 1), (1, 1000), (4, 152), (1000, 3), (75, 3700)])
def test_the_grid_of_blocks_copies_little(n_queries, n_blocks):
    rows, columns = vector_search.grid(n_queries, n_blocks, 200)
    assert 1 <= rows <= max(1, n_queries) and 1 <= columns <= max(1, n_blocks) and rows * columns <= 200
    # What is copied grows with the tables and not with their product.
    assert 8 * n_queries * columns + n_blocks * rows <= 2 * (200 * 8 * max(1, n_queries) * max(1, n_blocks)) ** 0.5 + 16 * n_queries + 2 * n_blocks


def test_many_blocks_of_queries_meet_all_blocks_of_the_file(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4 + (i % 3 == 0)).round(2).tolist()) for i in range(130)]
    assert got(spark, rows, 4, set(range(0, 130, 2)), block_rows=6) == brute(rows, 4, set(range(0, 130, 2)))


def test_blocks_of_the_first_scan_are_dealt_to_all_places(spark):
    blocks = spark.range(20_000).select(F.col("id").cast("string").cast("binary").alias("keys"))
    early = blocks.filter(F.pmod(F.xxhash64("keys"), F.lit(vector_search.FIRST_SHARE)) == 0)
    assert early.select(vector_search.dealt("keys", 8)).distinct().count() == 8


def test_only_the_result_stays_in_the_shared_folder(spark):
    before = set(Path(shared_path(spark)).glob("vector-search-*"))
    got(spark, [(i, [1.0, i / 10]) for i in range(60)], 3, {0, 50})
    (own,) = set(Path(shared_path(spark)).glob("vector-search-*")) - before
    assert [x.name for x in own.iterdir()] == ["found"]
