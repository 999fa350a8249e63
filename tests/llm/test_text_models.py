"""Held-out accuracy of the two learned operators, and their edge cases."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import language_mixture, queries, toxicity
from gradeloom.llm.common import crc_fold
from gradeloom.llm.language_mixture import fit_languages, identify_languages, mixtures, trigrams
from gradeloom.llm.toxicity import ToxicityModel, fit_numpy, fit_toxicity, score_toxicity, text_words, word_features

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@tables
def test_language_accuracy_on_held_out_documents(spark):
    found = queries.QUERIES["op5_language_id"](spark, DIR)
    lang = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(lang, "doc_id")
    assert found.count() == lang.count()
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.filter("score < 0 or score > 1").count() == 0


@tables
def test_toxicity_on_held_out_documents(spark):
    big = "/root/testdata/sf0.1"
    found = queries.QUERIES["op9_toxicity"](spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet").select("doc_id", "toxic")
    rows = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert found.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert toxic.predicted.mean() >= 0.75  # a tenth of the labels has no word that gives them away
    assert clean.predicted.mean() <= 0.03
    better = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
    assert better >= 0.85


def mixed_docs(spark):
    rng = random.Random(4)
    words = {"aa": ["balo", "bamo", "bilu", "bolo"], "zz": ["xizk", "zixk", "kzix", "zkzx"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(["aa", "zz"] * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), words


def test_mixture_gives_both_languages(spark):
    df, words = mixed_docs(spark)
    model = fit_languages(df)
    assert model.languages == ["aa", "zz"]
    shares, _, known = mixtures([" ".join(words["aa"] * 6 + words["zz"] * 3), "", "12 34"], model)
    assert shares[0].argmax() == 0 and 0.5 < shares[0, 0] < 0.8 and shares[0, 1] > 0.2
    assert known.tolist() == [True, False, False] and not shares[1:].any()


def test_language_edges(spark):
    df, words = mixed_docs(spark)
    model = fit_languages(df.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))))
    rows = [(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (None, "balo bamo", "q"), (4, "xizk " * 40_000, "q"), (4, "xizk " * 40_000, "q"), (5, "b", "q")]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, score string"), model)
    assert got.columns == ["doc_id", "lang_pred", "score", "other_share", "lang_mix"]
    found = sorted(((r["doc_id"], r["lang_pred"], r["score"] > 0) for r in got.collect()), key=repr)
    assert found[:6] == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "zz", True), (4, "zz", True), (5, "aa", False)]
    assert found[6] == (None, "aa", True)
    assert identify_languages(df.limit(0), model).count() == 0
    nothing = fit_languages(df.limit(0))
    assert {r["lang_pred"] for r in identify_languages(df.limit(3), nothing).collect()} == {"und"}


def test_trigrams_do_not_cross_texts():
    owner, buckets, has = trigrams(["ab cd", "", "e", "?!", "ab cd"])
    assert has.tolist() == [True, False, True, False, True]
    assert np.bincount(owner, minlength=5).tolist() == [4, 0, 1, 0, 4]
    assert buckets[owner == 0].tolist() == buckets[owner == 4].tolist()


def planted(n, rng):
    """Texts of random words; every tenth holds a word beginning that marks it."""
    out = []
    for i in range(n):
        words = ["".join(rng.choices("abdeot", k=6)) for _ in range(30)]
        if i % 10 == 0:
            words[5] = "grumk" + "".join(rng.choices("abdeot", k=3))
        out.append((i, " ".join(words), int(i % 10 == 0)))
    return out


def test_toxicity_learns_beginnings_of_words(spark):
    rows = planted(3000, random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(df, df.filter("doc_id < 2500"))
    scored = score_toxicity(df.filter("doc_id >= 2500"), model).select("toxic", "predicted").toPandas()
    assert (scored.toxic == scored.predicted).mean() >= 0.99


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "fine words", 3), (2, "word " * 50_000, 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(df, none)
    got = score_toxicity(df, model).collect()
    assert {(r["predicted"]) for r in got} == {0} and all(0 <= r["score"] <= 1 for r in got) and len(got) == 4
    assert score_toxicity(df.limit(0), model).count() == 0
    assert model.weights == {}


def test_fit_equals_plain_gradient_steps():
    """The learner's steps with dense matrices and losses written out."""
    rng = np.random.default_rng(2)
    n_features, prior = 12, 0.1
    dense = [(rng.random((n, n_features)) < share).astype(float) for n, share in ((30, 0.4), (80, 0.15))]
    weight, bias = fit_numpy(*[[np.flatnonzero(row).astype(np.int32) for row in x] for x in dense], n_features, prior)
    w, b = np.zeros(n_features), math.log(prior / (1 - prior))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, toxicity.STEPS + 1):
        grads, risks = [], []
        for x, sign in ((dense[0], -1), (dense[0], 1), (dense[1], 1)):  # positives as such, as negatives; unlabelled as negatives
            z = x @ w + b
            risks.append(np.mean([math.log1p(math.exp(sign * a)) for a in z]))
            each = sign / (1 + np.exp(-sign * z)) / len(x)
            grads.append(np.append(x.T @ each, each.sum()))
        negative = risks[2] - prior * risks[1]
        g = prior * grads[0] + grads[2] - prior * grads[1] if negative >= -toxicity.TOLERANCE else prior * grads[1] - grads[2]
        g[:-1] += toxicity.DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    assert weight == pytest.approx(w, abs=1e-9) and bias == pytest.approx(b, abs=1e-9)


def test_unlabelled_texts_are_drawn_from_all_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)] + [(7, "again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    drawn = toxicity.sampled_texts(docs, labels, docs.filter("doc_id <> 3"), 5, 100).collect()
    assert sorted(r["text"] for r in drawn if r["positive"]) == ["text 0"]
    rest = [r["text"] for r in drawn if not r["positive"]]
    assert len(rest) == 19 and "text 3" not in rest


def test_mixture_equals_plain_em():
    """Proportions of one text by loops over its trigrams, for every set of languages."""
    rng = np.random.default_rng(5)
    table = rng.dirichlet(np.full(language_mixture.BUCKETS, 0.05), 3)
    table = np.vstack([table, np.full(language_mixture.BUCKETS, 1 / language_mixture.BUCKETS)]).astype(np.float32)
    table = np.maximum(table, 1e-7)
    model = language_mixture.LanguageModel(["a", "b", "c"], table)
    text = "one text of a few words, and of some more"
    _, buckets, _ = trigrams([text])
    n = len(buckets)

    def em(chosen):
        share = dict.fromkeys(chosen, 1 / len(chosen))
        for _ in range(language_mixture.EM_STEPS):
            total = dict.fromkeys(chosen, 0.0)
            for x in buckets:
                mass = {j: share[j] * float(table[j, x]) for j in chosen}
                for j in chosen:
                    total[j] += mass[j] / sum(mass.values())
            share = {j: total[j] / n for j in chosen}
        return share, sum(math.log(sum(share[j] * float(table[j, x]) for j in chosen)) for x in buckets)

    alone = [sum(math.log(float(table[j, x])) for x in buckets) for j in range(4)]
    first = int(np.argmax(alone))
    full, _ = em(range(4))
    order = [first, *sorted((j for j in range(4) if j != first), key=lambda j: -full[j])]
    best, best_share = alone[first], {first: 1.0}
    for size in range(2, 5):
        share, likelihood = em(order[:size])
        gained = likelihood - language_mixture.PENALTY * (size - 1) * math.log(n + 1) / 2
        if gained > best:
            best, best_share = gained, share
    got, _, _ = mixtures([text], model)
    assert got[0] == pytest.approx([best_share.get(j, 0.0) for j in range(4)], abs=1e-4)


def test_words_of_a_text_score_once():
    word = word_features("grumk")
    model = ToxicityModel({word[0]: 2.0}, -1.0)
    one, many = model.score(["Grumk, x", "grumk grumk GRUMK."])
    assert one == many == pytest.approx(1 / (1 + np.exp(-1.0)))
    assert text_words("A-b c1d É") == {"a", "b", "c", "d", "é"}


def test_folds(spark):
    df = spark.createDataFrame([(7,), (None,)], "doc_id long")
    import zlib

    assert [r[0] for r in df.select(crc_fold(F.col("doc_id"), 3)).collect()] == [zlib.crc32(b"7") % 3, 0]


def test_a_text_of_six_languages(spark):
    rng = random.Random(6)
    words = {f"l{i}": ["".join(rng.choices(letters, k=5)) for _ in range(8)] for i, letters in enumerate(("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzßæ"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate([*words] * 20)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [" ".join(w for lang in sorted(words)[:n] for w in rng.choices(words[lang], k=40)) for n in (6, 2, 5)]
    shares, _, _ = mixtures(mixed, model)
    for row, n in zip(shares, (6, 2, 5), strict=True):
        assert np.flatnonzero(row > 0).tolist() == list(range(n))
        assert np.abs(row[:n] - 1 / n).max() < 0.03
