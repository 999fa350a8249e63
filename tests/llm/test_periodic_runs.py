"""Runs against a loop over all periods; the query against its own words."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from gradeloom.llm import periodic_runs as runs
from gradeloom.llm.queries import op11_periodic_runs, with_repeated_ends
from tests.oracle import SMALL


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(6, 4 * q) and not any(all(words[k] == words[k + r] for k in range(start, end - r)) for r in range(1, q)):
                out.append((start, end, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequence(rng):
    words, size = [], rng.choice([0, 5, 20, 80, 400])
    while len(words) < size:
        letters = rng.choice([2, 3, 50])
        if rng.random() < 0.6:
            q = rng.choice([1, 2, 3, 5, 9, 17, 33, 40])
            words += ([rng.randrange(letters) for _ in range(q)] * 9)[: rng.randrange(1, 6 * q + 1)]
        else:
            words += [rng.randrange(letters) for _ in range(rng.randrange(1, 20))]
    return words


@pytest.mark.parametrize("direct", [2, 16])
def test_runs_equal_a_loop_over_periods(monkeypatch, direct):
    monkeypatch.setattr(runs, "DIRECT", direct)
    rng = random.Random(direct)
    for _ in range(200):
        words = sequence(rng)
        assert runs.find_runs(np.array(words, np.int64)) == brute_runs(words)


def test_constant_and_long_periodic_text():
    assert runs.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.find_runs(np.arange(100_000) % 24_000) == [(0, 100_000, 24_000)]
    assert runs.find_runs(np.arange(100_000) % 26_000) == []


@pytest.mark.parametrize("prime, generator", runs.PRIMES)
def test_transform_goes_back(prime, generator):
    rows = np.random.default_rng(0).integers(0, prime, (3, 64)).astype(np.uint64)
    there = runs.transform(rows, prime, generator)
    assert (runs.transform(there, prime, generator, inverse=True) == rows).all()
    assert there[:, 0].tolist() == [sum(map(int, row)) % prime for row in rows]


def test_sums_are_exact_beyond_one_prime():
    rng = np.random.default_rng(1)
    blocks, windows = rng.integers(0, 1 << 24, (2, 32)), rng.integers(0, 1 << 24, (2, 64))
    windows[1, 5:37] = blocks[1]
    zero = runs.mismatch_sums(blocks, windows) == 0
    assert np.argwhere(zero).tolist() == [[1, 5]]


def test_one_list_of_texts_is_as_each_text():
    texts = ["a a a a a a", "", "a a a", "b a b a b a b a\x0bz", "x " * 9]
    each, short = runs.runs_of_texts(texts)
    assert [[(r["start"], r["length"], r["period"]) for r in own] for own in each] == [[(0, 6, 1)], [], [], [(0, 8, 2)], [(0, 9, 1)]]
    assert short == ["a", "", "a a a", "b a z", "x"]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    first = max(found, key=lambda x: (x[1] - x[0], -x[0], -x[2]), default=None)
    shown = (None,) * 4 if first is None else (first[0], first[1] - first[0], first[2], 1000 * (first[1] - first[0]) // first[2])
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = [row for row in docs if len(row["text"].split()) < 700]
    got = {row["doc_id"]: tuple(row) for row in op11_periodic_runs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    assert [got[row["doc_id"]] for row in short] == [expected(row["doc_id"], row["text"]) for row in short]


def test_nulls_empties_repeats_and_names(spark, tmp_path):
    ids = [None, None, *range(40), 3, 3]
    texts = [None, "a b a b a b a b c", *[f"w{i} x y z " * (i % 7) + "\t\r\n" for i in range(40)], "", None]
    rows = [(i, t, "lang", 7) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, words int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted([expected(i, t) for i, t in zip(ids, texts, strict=True)], key=key)
    found = runs.periodic_runs(docs)
    assert sorted(found.columns) == ["collapsed", "doc_id", "runs", "words"] and found.count() == len(rows)
    assert with_repeated_ends(docs.limit(0)).count() == 0 and runs.periodic_runs(docs.limit(0)).count() == 0
