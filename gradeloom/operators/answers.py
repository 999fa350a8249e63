"""From transcribed pages to answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import C_FRACTION, C_IDENTIFIER, C_KEYWORDS, C_NUMBER, C_PUNCTUATION, c_identifiers, normalize_answer


def missing_pages(transcripts: DataFrame, expected: DataFrame, keys: list[str], page: str, count: str) -> DataFrame:
    """Pages 1 to ``count`` of each of ``expected`` that are not among the transcripts."""
    wanted = expected.filter(F.col(count) >= 1).select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint"))).alias(page))
    return wanted.join(transcripts.select(*keys, F.col(page).cast("bigint").alias(page)), [*keys, page], "left_anti")


def assemble_answers(transcripts: DataFrame, keys: list[str], page: str, text: str, separator: str = "\n") -> DataFrame:
    """One text for each answer, its pages in order; pages without text are left out."""
    pages = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(page), F.col(text)))))
    joined = F.array_join(F.transform(pages, lambda x: x[text]), separator)
    return transcripts.groupBy(*keys).agg(joined.alias("text"), F.count(text).alias("n_pages"))


def review_queue(transcripts: DataFrame, n: int, section: str, confidence: str, key: str) -> DataFrame:
    """The ``n`` least certain answers of each section; ties go to the smaller key."""
    order = Window.partitionBy(section).orderBy(F.col(confidence), F.col(key))
    return transcripts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def normalize_answers(df: DataFrame, col: str, fold_case: bool = True) -> DataFrame:
    return df.withColumn(col, normalize_answer(F.col(col), fold_case))


def c_token_counts(df: DataFrame, col: str) -> DataFrame:
    """Counts of identifiers (keywords among them), keywords, numbers and punctuation."""
    text = F.col(col)

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("bigint")

    keywords = F.size(F.filter(c_identifiers(text), lambda x: x.isin(C_KEYWORDS))).cast("bigint")
    return df.withColumns({"identifiers": count(C_IDENTIFIER), "keywords": keywords, "numbers": count(C_NUMBER), "punctuation": count(C_PUNCTUATION) - count(C_FRACTION)})
