import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import ngram_join, queries
from gradeloom.llm.ngram_join import Likeness, code_set, connected, decode_set, distinct_shingles, jaccard_components, ranked_shingles, shingles, with_class_ids, word_hashes
from gradeloom.session import Scratch

_UPPER = {c: c + 32 for c in range(65, 91)}


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_UPPER))


def gram_set(text, n):
    words = word_list(text)
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < n else frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute_components(docs, n, percent):
    """Every pair of sets compared; the smallest id reached."""
    sets = [(i, gram_set(t, n)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


@given(st.sets(st.one_of(st.integers(0, 300), st.integers(0, (1 << 54) - 1), st.integers((1 << 54) - 9, (1 << 54) - 1)), max_size=80))
def test_coded_sets_come_back(values):
    grams = np.array(sorted(values), np.uint64)
    coded = code_set(grams)
    assert decode_set(coded).tolist() == grams.tolist()
    assert len(coded) <= 4 + 6 * len(grams) + 64


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    common = rng.choices(words, k=40)
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            text = (docs[rng.randrange(len(docs))] or "a").split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs.append(" ".join(text))
        else:
            docs.append(" ".join((common if rng.random() < 0.4 else []) + rng.choices(words, k=rng.randint(1, 90))))
    docs[5], docs[6], docs[7], docs[8] = "", None, " \n", "ONE two"
    return list(enumerate([*docs, "one TWO", "one\ttwo "]))


@pytest.mark.parametrize(("seed", "n", "percent"), [(2, 5, 80), (3, 2, 60)])
def test_equals_brute_force(spark, seed, n, percent):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, jaccard_components(df, Likeness(n, percent)).collect()))
    assert got == brute_components(docs, n, percent)


def test_another_number_of_pivot_rounds_agrees(spark, monkeypatch):
    docs = corpus(9, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rounds in (2,):
        monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
        assert sorted(map(tuple, jaccard_components(df, Likeness(3, 70)).collect())) == brute_components(docs, 3, 70)


def test_edges(spark):
    rows = [(3, "a b c d e", 1), (3, "a b c d e", 1), (1, "A b C d e", 1), (4, None, 1), (5, None, 1), (None, "a b c d e", 1), (9, "word " * 50_000, 1), (8, "word " * 40_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = sorted(map(repr, map(tuple, jaccard_components(df, Likeness(4, 85)).collect())))
    assert got == sorted(map(repr, [(3, 2, 1), (3, 2, 1), (1, 2, 1), (4, 0, 4), (5, 0, 5), (None, 2, None), (9, 1, 8), (8, 1, 8)]))
    assert jaccard_components(df.limit(0), Likeness(4, 85)).count() == 0
    with pytest.raises(ValueError):
        Likeness(9, 85)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é\n\t中"), max_size=30), max_size=8))
def test_words_and_sets(texts):
    hashes, counts = word_hashes(texts)
    assert counts.tolist() == [len(word_list(t)) for t in texts]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for t in texts for w in word_list(t)], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    for n in (1, 3):
        _, sizes = distinct_shingles(texts, n)
        assert sizes.tolist() == [len(gram_set(t, n)) for t in texts]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 400), (300, 400)]
    got = {r["class_id"]: r["label"] for r in connected(spark.createDataFrame(links, "left long, right long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(1, 21)) and all(got[100 + i] == 100 for i in range(1, 30)) and got[500] == got[400] == 300


def test_prefix_matches_cost():
    like = Likeness(4, 85)
    rank = np.floor(np.log2(1.0 + np.array([1] * 33 + [900] * 21)) * 2000).astype(np.uint16)
    assert like.overlap(400, 400) == 368 and 400 - 368 + 1 == 33
    assert ngram_join.best_matches(rank, 400, 1.0, like) == 1  # longer prefixes meet frequent n-grams
    assert ngram_join.best_matches(np.full(54, rank[-1]), 400, 1.0, like) > 1  # all are frequent: share more


@pytest.mark.parametrize(("large", "crowded"), [(1, 4096), (64, 1)])
def test_large_labels_and_crowded_tokens_meet_others(spark, monkeypatch, large, crowded):
    docs = corpus(11, 140)
    monkeypatch.setattr(ngram_join, "LARGE_LABEL", large)
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, Likeness(3, 75)).collect())) == brute_components(docs, 3, 75)


def test_identical_sets_only(spark):
    docs = corpus(4, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df, Likeness(3, 100)).collect())) == brute_components(docs, 3, 100)


def test_order_is_the_smaller_of_both_sketches():
    texts = ["a b c d a b c d", "x y", "a b c x"]
    bits = 16
    rng = np.random.default_rng(3)
    ranks = rng.integers(0, 60_000, (1 << bits) + (1 << ngram_join.WORD_BITS)).astype(np.uint16)
    grams, sizes, rank = ranked_shingles(texts, 3, ranks, bits)
    plain, plain_sizes = distinct_shingles(texts, 3)
    assert grams.tolist() == plain.tolist() and sizes.tolist() == plain_sizes.tolist()
    hashes, _ = word_hashes(texts)
    of_word = dict(zip([w for t in texts for w in t.split()], ranks[ngram_join.word_slot(hashes) + (1 << bits)].tolist(), strict=True))
    expected = {}
    for text in texts:
        words = text.split()
        for i in range(max(1, len(words) - 2)):
            part = words[i : i + 3]
            gram = shingles([" ".join(part)], 3)[0]
            expected[int(gram[0])] = min(int(ranks[int(gram[0]) & ((1 << bits) - 1)]), *(of_word[w] for w in part))
    assert rank.tolist() == [expected[x] for x in grams.tolist()]


def test_sets_that_share_64_bits_are_told_apart(spark):
    rows = [(1, 5, 1), (2, 5, 2), (3, 5, 1), (4, 6, 9)]
    df = spark.createDataFrame(rows, "n long, class_key long, check long")
    got = {r["n"]: r["class_id"] for r in with_class_ids(df, Scratch(spark, "t")).collect()}
    assert got[1] == got[3] != got[2] and len(set(got.values())) == 3 and got[4] == 6


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_registered_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    expected = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4, 85)
    assert sorted(map(tuple, queries.QUERIES["op8_ngram_join"](spark, "/root/testdata/sf0.01").collect())) == expected
