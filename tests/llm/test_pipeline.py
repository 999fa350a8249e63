"""The whole pipeline against a brute-force version of its last three stages and the operators' own decisions."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from gradeloom.llm import stages
from gradeloom.llm.packing import WordEncoder
from gradeloom.llm.vocabularies import vocabulary
from tests.llm.test_ngram_join import brute_components

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "line_dedup", "ngram_jaccard_join", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert docs.columns == stages.COLUMNS
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    before, deduped = kept["toxicity"], kept["line_dedup"]
    assert set(kept["language_id"]) >= set(before) == set(deduped)

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\r\x0b\x0c"))

    held = Counter(k for r in before.values() for k in {key(x) for x in r["text"].split("\n")} if k)
    for i, r in before.items():
        text = "\n".join(x for x in r["text"].split("\n") if held[key(x)] < 10)
        assert deduped[i]["text"] == text and deduped[i]["n_chars"] == len(text)
    groups = brute_components([(i, r["text"]) for i, r in deduped.items()], 5, 80)
    assert set(kept["ngram_jaccard_join"]) == {i for i, _, first in groups if i == first}

    encoder = WordEncoder.of(vocabulary("word_bpe_49k.json"))
    lengths = Counter()
    for r in corpus_pipeline.run(spark, DIR).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(np.frombuffer(encoder.encode([r["text"]])[0], np.uint32)) + 1 for i, r in kept["ngram_jaccard_join"].items()}


def test_rejected_documents(spark):
    docs = spark.createDataFrame([(1, "12345 67", "en", "s", 8), (2, "the words are of a language", "en", "s", 27), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in stages.language_id(spark, docs, "").collect()] == [2]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_with_one_id_are_judged_by_their_own_texts(spark):
    w, u, x = ("one two three four five six", "quite another text of seven words", "and a third one that is long enough")
    rows = [(1, w), (3, w), (3, u), (7, x), (7, x), (None, w), (None, "only here and with no id at all"), (None, None), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in stages.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, w), (3, u), (7, x), (None, rows[6][1]), (None, None), (4, None), (5, "")], key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_nulls_extra_columns_and_empty_tables(spark, stage):
    rows = [(1, "The words of a text", "en", "s", 19), (1, "The words of a text", "en", "s", 19), (None, None, None, None, None), (2, "", None, "s", 0), (3, "long " * 40_000, "en", None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], f"{SCHEMA}, Component_id int, _text string, length double")
    got = stage(spark, docs, DIR)
    if stage is not stages.packed_sequences:
        assert got.columns == stages.COLUMNS
    assert got.count() >= 1
    assert stage(spark, docs.limit(0), DIR).count() == 0
