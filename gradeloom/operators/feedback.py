"""From marks to feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_messages(marks: DataFrame, rubric: DataFrame, on: list[str], message: str) -> DataFrame:
    """Each mark with the rubric's ``message`` for its criterion; null where the rubric has none.

    The rubric should hold a criterion once. Spark sends it to every task while it is small.
    """
    return marks.join(rubric.select(*on, message), on, "left")


def feedback_text(marks: DataFrame, keys: list[str], order: str, missed: Column, message: Column, separator: str = "; ") -> DataFrame:
    """The messages of all criteria missed, in order, one row for each submission with any.

    A criterion missed without a message counts, and adds no text.
    """
    items = marks.filter(missed).select(*keys, F.col(order).alias("_order"), message.alias("_message"))
    listed = F.array_sort(F.collect_list(F.struct("_order", "_message")))
    return items.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["_message"]), separator).alias("feedback"), F.count(F.lit(1)).alias("n_missed"))


def common_faults(marks: DataFrame, question: str, criterion: str, missed: Column, k: int) -> DataFrame:
    """The ``k`` criteria of each question that are missed most; ties go to the smaller one."""
    counted = marks.filter(missed).groupBy(question, criterion).agg(F.count(F.lit(1)).alias("n_missed"))
    most = Window.partitionBy(question).orderBy(F.col("n_missed").desc(), F.col(criterion))
    return counted.withColumn("place", F.row_number().over(most).cast("bigint")).filter(F.col("place") <= k)
