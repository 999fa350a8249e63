"""Late submissions: which deadline held for an attempt, and what being late costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.asof import as_of

DAY_SECONDS = 86_400


def effective_deadlines(attempts: DataFrame, deadlines: DataFrame, extensions: DataFrame, assessment: str, student: str, submitted: str) -> DataFrame:
    """Attempts with ``deadline`` and ``extra_days``.

    ``deadlines`` has the assessment, ``effective_from`` and ``deadline``: the one announced last at
    or before the submission holds; before the first there is none. ``extensions`` has assessment,
    student, ``valid_from``, ``valid_to`` and ``days``: of those with ``valid_from <= submitted <
    valid_to`` (a null end is open) the most days count, none give 0. An attempt comes out once.
    """
    placed = as_of(attempts, deadlines, [assessment], submitted, "effective_from", ["deadline"])
    # Extensions are for one student and assessment, so the join's keys are as fine as attempts are.
    asked = attempts.select(F.col(assessment).alias("_assessment"), F.col(student).alias("_student"), F.col(submitted).alias("_submitted")).distinct()
    given = extensions.select(F.col(assessment).alias("_assessment"), F.col(student).alias("_student"), "valid_from", "valid_to", "days")
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_submitted"))) & (F.col("valid_to").isNull() | (F.col("_submitted") < F.col("valid_to")))
    longest = asked.join(given, ["_assessment", "_student"]).filter(valid).groupBy("_assessment", "_student", "_submitted").agg(F.max("days").alias("extra_days"))
    same = (F.col(assessment) == F.col("_assessment")) & (F.col(student) == F.col("_student")) & (F.col(submitted) == F.col("_submitted"))
    joined = placed.join(longest, same, "left")
    return joined.select(*placed.columns, F.coalesce("extra_days", F.lit(0)).alias("extra_days"))


def late_penalties(placed: DataFrame, score: str, submitted: str, per_day: float, most: float) -> DataFrame:
    """Adds ``days_late`` (each day begun after deadline and extension), ``penalty`` and ``final_score``.

    A day late costs ``per_day`` of the score, ``most`` of it at the most. Without a deadline, or a time, nothing
    is late; a null score stays null.
    """
    over = F.unix_timestamp(F.col(submitted).cast("timestamp")) - F.unix_timestamp(F.col("deadline").cast("timestamp")) - F.col("extra_days") * DAY_SECONDS
    days = F.coalesce(F.greatest(F.ceil(over / DAY_SECONDS), F.lit(0)), F.lit(0)).cast("bigint")
    late = placed.withColumn("days_late", days)
    cost = F.least(F.col("days_late") * F.lit(per_day), F.lit(most))
    return late.withColumn("penalty", cost).withColumn("final_score", F.col(score) * (1 - F.col("penalty")))
