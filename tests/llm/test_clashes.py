"""Extra columns may have any names: those of outputs in any case of letters, and those used inside."""

import pytest

from gradeloom.llm import fingerprints, html_text, language_mixture, line_dedup, ngram_join, packing, sentencepieces, toxicity, url_filters, vector_search
from gradeloom.llm.toxicity import ToxicityModel
from gradeloom.llm.url_filters import Rule
from gradeloom.llm.vocabularies import vocabulary

INSIDE = "_text c0 c1 C2 lines drop row1 row2 pos line1 line2 _lines _drop _row1 host html page_key said ids kinds template slot own token class vector url whole met_url best text_hash row_no part place following key size check class_id class_key component n tokens row block dim cells low width".split()


def model_of_languages(spark):
    return language_mixture.fit_languages(spark.createDataFrame([("some words", "aa", 1), ("zzz", "zz", 2)], "Text string, LANG string, n int"))


OPERATORS = {
    "line_dedup": (lambda spark, df: line_dedup.drop_common_lines(df, 2), ["n_lines", "n_dropped"], True),
    "url_filters": (lambda spark, df: url_filters.filter_urls(df, [Rule("com", "/", "block")], url_col="page_url"), ["host", "path", "rule", "verdict"], True),
    "html_text": (lambda spark, df: html_text.extract_main_text(df.withColumnRenamed("page_url", "url").withColumnRenamed("text", "html")), ["text", "n_chars"], False),
    "language": (lambda spark, df: language_mixture.identify_languages(df, model_of_languages(spark)), ["lang_pred", "score", "other_share", "lang_mix"], False),
    "pieces": (lambda spark, df: sentencepieces.encode_and_decode(df, vocabulary("piece_bpe_32k.model")), ["ids", "decoded"], False),
    "toxicity": (lambda spark, df: toxicity.score_toxicity(df, ToxicityModel({}, 0.0), keep_text=True), ["score", "predicted"], True),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
@pytest.mark.parametrize("form", [str.lower, str.upper, str.title])
def test_carried_columns(spark, name, form):
    operator, outputs, keeps_text = OPERATORS[name]
    extra = {form(x): form(x) for x in INSIDE if x not in ("url", "html")}
    extra = {k: v for k, v in extra.items() if k.lower() not in [x.lower() for x in outputs] + ["doc_id", "text", "page_url"]}
    replaced = [form(x) for x in outputs if x != "text"]
    names = ["doc_id", "text", "page_url", *extra, *replaced]
    row = (1, "a text", "http://a.com/x", *extra.values(), *["mine"] * len(replaced))
    df = spark.createDataFrame([row, row], ", ".join(f"`{x}` {'long' if x == 'doc_id' else 'string'}" for x in names))
    got = operator(spark, df)
    assert got.columns[-len(outputs):] == outputs
    found = got.collect()
    assert len(found) == 2
    carried = {c: v for c, v in zip(got.columns, found[0], strict=True) if c in extra}
    assert carried == extra
    assert not set(replaced) & set(got.columns[: -len(outputs)])
    assert ("text" in got.columns) == (keeps_text or "text" in outputs)


@pytest.mark.parametrize("form", [str.lower, str.upper])
def test_operators_that_carry_nothing(spark, form):
    extra = [form(x) for x in INSIDE if x.lower() not in ("embedding",)] + [form(x) for x in "n_chars fingerprint n_shingles component_id start length sequence_id offset rank score query_id".split()]
    types = ", ".join(f"`{x}` string" for x in extra)
    docs = spark.createDataFrame([(1, "a text of five whole words", *extra)], f"doc_id long, text string, {types}")
    assert fingerprints.fingerprint_documents(docs).count() == 1
    assert ngram_join.jaccard_components(docs, ngram_join.Likeness(4, 85)).first()["component_id"] == 1
    assert packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).count() == 1
    vectors = spark.createDataFrame([(i, [1.0, float(i)], *extra) for i in range(3)], f"vec_id long, embedding array<float>, {types}")
    assert vector_search.top_k_inner_product(vectors, vectors, k=1).count() == 3
