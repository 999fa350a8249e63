"""The stages of the corpus pipeline: each takes ``(spark, docs, sf_dir)`` and returns a DataFrame.

Only the columns of ``documents`` are read, whatever else a table has; all stages but the last
return them. Any of them may be null. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm import language_mixture, line_dedup, ngram_join, packing, toxicity
from gradeloom.llm.common import TEXT_ROWS, crc_fold, digest_columns
from gradeloom.llm.vocabularies import vocabulary
from gradeloom.session import materialize, ship_package
from gradeloom.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few_texts(spark: SparkSession) -> None:
    """From here on this session's Python stages get few texts at a time, as five operators share an executor.

    Whole texts pass through the first two stages, and are written by the caller's job, so the
    session has to hold the setting until then; ``corpus_pipeline.run`` puts the old one back.
    """
    ship_package(spark)
    spark.conf.set(BATCH, str(min(TEXT_ROWS, int(spark.conf.get(BATCH)))))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: without a letter, or of what no language explains by nine tenths.

    The languages are learned from all rows with a text and a ``lang``. Null and empty texts
    go; repeated rows stay or go together. Where no row has a ``lang``, no document stays.
    """
    few_texts(spark)
    model = language_mixture.fit_languages(docs)
    found = language_mixture.identify_languages(docs.select(COLUMNS), model, keep_text=True)
    return found.filter((F.col("lang_pred") != language_mixture.UNKNOWN) & (F.col("other_share") <= 0.9)).select(COLUMNS)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from labels and texts outside the held-out fifth.

    Null and empty texts hold no word that tells, and stay. Without a toxic label all stay.
    """
    few_texts(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_fold(F.col("doc_id"), 5) != 0)
    model = toxicity.fit_toxicity(docs, labels, unlabelled=docs.filter(crc_fold(F.col("doc_id"), 5) != 0))
    return toxicity.score_toxicity(docs.select(COLUMNS), model, keep_text=True).filter(F.col("predicted") == 0).select(COLUMNS)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that at least ten documents hold; the documents stay, with ``n_chars`` of what is left.

    A null text comes out empty. Rows with one ``doc_id`` count as one document.
    """
    kept = line_dedup.drop_common_lines(docs.select(COLUMNS), min_docs=10, min_chars=1)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the smallest id, null after all others; five words, similarity 0.8.

    Rows are told apart by id and text, so rows that share an id are judged by their own texts.
    Null and empty texts are like nothing, and stay. Of rows with the same id and the same text,
    null and empty ones too, one stays.
    """
    key, check = digest_columns(F.col("doc_id"), F.col("text"))
    rows = docs.select(COLUMNS).withColumns({"row_key": key, "row_check": check})
    groups = materialize(ngram_join.jaccard_components(rows.select(F.col("row_key").alias("doc_id"), "text"), ngram_join.Likeness(words=5, percent=80)), "groups")
    counted = groups.groupBy(F.col("doc_id").alias("row_key"), "component_id").agg(F.count(F.lit(1)).alias("copies"))
    ids = rows.select("row_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "copies")).alias("first")
    winners = counted.join(ids, "row_key").groupBy("component_id").agg(first)
    kept = materialize(winners.groupBy("first.row_key").agg(F.max(F.struct(F.col("first.copies"))).getField("copies").alias("copies"), F.count(F.lit(1)).alias("groups")), "kept-rows")
    found = rows.join(kept.filter("copies = 1 and groups = 1").select("row_key"), "row_key", "left_semi")
    repeated = kept.filter("copies > 1 or groups > 1").select("row_key")
    if not repeated.isEmpty():
        one = Window.partitionBy("row_key", "row_check").orderBy("lang", "source", "n_chars")
        several = rows.join(repeated, "row_key", "left_semi").withColumn("place", F.row_number().over(one)).filter("place = 1").drop("place")
        found = found.unionByName(several)
    return found.select(COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 4,096 tokens at most, each document ended by id 2.

    Returns the pieces of ``packing.pack_documents``. A null text is an empty one; repeated
    rows are packed each for itself.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"), size=4096, end_id=2)
