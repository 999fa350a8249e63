"""From scores to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import materialize


def in_order(rows: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``before_x`` and ``total_x`` for each of ``sums``: what the rows of the same group
    that come before hold together, and what all of them do.

    Rows are dealt by ranges of group and order, so that no group, however large, is sorted
    in one task; each range adds what the ranges before it hold. ``order`` should settle ties.
    """
    group = [F.col(c) for c in by]
    dealt = materialize(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "in-order")
    ranges = dealt.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_offset_{c}") for c in sums]
    totals = [F.sum(f"_sum_{c}").over(Window.partitionBy(*by)).alias(f"total_{c}") for c in sums]
    known = ranges.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_range"), *offsets, *totals)
    same = F.col("_part") == F.col("_range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    so_far = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_local_{c}": F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in sums})
    before = [(F.col(f"_offset_{c}") + F.col(f"_local_{c}")).alias(f"before_{c}") for c in sums]
    return local.join(known, same).select(*rows.columns, *before, *[f"total_{c}" for c in sums])


def score_rollup(scores: DataFrame, by: list[str], score: str) -> DataFrame:
    """Count and mean for each group, each outer group, and overall, with grouping flags."""
    flags = [F.grouping(c).cast("int").alias(f"all_{c}") for c in by]
    return scores.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), *flags)


QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def score_distribution(scores: DataFrame, by: str, score: str, exact: bool = True) -> DataFrame:
    """Least, quartiles, most, standard deviation and mean; missing scores are left out of all.

    The exact form counts each group's distinct scores and finds the quartiles by their
    places, between two scores in proportion. ``exact=False`` keeps a sketch for each group:
    it gives a score that is there, and needs one shuffle of sketches only.
    """
    moments = [F.count(score).alias("n"), F.min(score).alias("least"), F.max(score).alias("most"), F.stddev_samp(score).alias("sd"), F.avg(score).alias("mean_score")]
    names = [by, "n", "least", *[name for name, _ in QUARTILES], "most", "sd", "mean_score"]
    if not exact:
        quartiles = [F.percentile_approx(score, F.lit(q)).cast("double").alias(name) for name, q in QUARTILES]
        return scores.groupBy(by).agg(*moments, *quartiles).select(*names)
    counted = scores.filter(F.col(score).isNotNull()).groupBy(by, score).agg(F.count(F.lit(1)).alias("held"))
    placed = in_order(counted, [by], [F.col(score)], ["held"])

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before_held") <= place) & (place < F.col("before_held") + F.col("held")), F.col(score).cast("double")))

    found = []
    for name, q in QUARTILES:
        place = (F.col("total_held") - 1) * F.lit(q)
        found += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_share_{name}")]
    quartiles = placed.groupBy(F.col(by).alias("_by")).agg(*found)
    between = [(F.col(f"_low_{name}") + F.col(f"_share_{name}") * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))).alias(name) for name, _ in QUARTILES]
    plain = scores.groupBy(by).agg(*moments)
    return plain.join(quartiles.select("_by", *between), F.col(by).eqNullSafe(F.col("_by")), "left").select(*names)


def score_bins(scores: DataFrame, by: str, score: str, width: float) -> DataFrame:
    return scores.groupBy(by, F.floor(F.col(score) / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rank_students(scores: DataFrame, section: str, score: str, key: str, parts: int = 4) -> DataFrame:
    """Places in the section, best first, missing scores last; the key settles which quarter ties fall in.

    Places are made over ranges of scores, not by sorting a section in one task. Rows with
    one section, score and key share a quarter.
    """
    held = scores.withColumn("_row", F.lit(1))
    by_score = scores.groupBy(section, score).agg(F.count(F.lit(1)).alias("held"), F.lit(1).alias("kind"))
    best = in_order(by_score, [section], [F.col(score).desc()], ["held", "kind"])
    by_key = held.groupBy(section, score, key).agg(F.sum("_row").alias("held"))
    settled = in_order(by_key, [section], [F.col(score).desc(), F.col(key)], ["held"]).select(
        F.col(section).alias("_section"), F.col(score).alias("_score"), F.col(key).alias("_key"), F.col("before_held").alias("_settled")
    )
    best = best.select(F.col(section).alias("_s"), F.col(score).alias("_x"), "before_held", "before_kind", "total_held")
    same_score = F.col(section).eqNullSafe(F.col("_s")) & F.col(score).eqNullSafe(F.col("_x"))
    same_row = F.col(section).eqNullSafe(F.col("_section")) & F.col(score).eqNullSafe(F.col("_score")) & F.col(key).eqNullSafe(F.col("_key"))
    n, at = F.col("total_held"), F.col("_settled")
    size, over = F.floor(n / parts), n % parts  # the first `over` parts have one row more
    quarter = F.when(at < over * (size + 1), F.floor(at / (size + 1))).otherwise(over + F.floor((at - over * (size + 1)) / F.greatest(size, F.lit(1))))
    placed = {
        "place": F.col("before_held") + 1,
        "dense_place": F.col("before_kind") + 1,
        "percent_place": F.coalesce(F.try_divide(F.col("before_held"), n - 1), F.lit(0.0)),
        "quarter": (quarter + 1).cast("bigint"),
    }
    joined = scores.join(best, same_score).join(settled, same_row)
    return joined.select(*scores.columns, *[value.alias(name) for name, value in placed.items()])


def item_analysis(marks: DataFrame, paper: str, item: str, mark: str) -> DataFrame:
    """Each item's mean mark, and how its marks go with the rest of the paper.

    ``discrimination`` is null where either side does not vary. A missing mark takes no part.
    """
    given = marks.filter(F.col(mark).isNotNull()).select(paper, item, mark)
    totals = given.groupBy(paper).agg(F.sum(mark).alias("_total"))
    rest = given.join(totals, paper).withColumn("_rest", F.col("_total") - F.col(mark))
    varied = (F.min(mark) < F.max(mark)) & (F.min("_rest") < F.max("_rest"))
    together = F.try_divide(F.covar_samp(mark, "_rest"), F.stddev_samp(mark) * F.stddev_samp("_rest"))
    return rest.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.avg(mark).alias("difficulty"), F.when(varied, together).alias("discrimination"))


def agreement(pairs: DataFrame, machine: Column, human: Column) -> DataFrame:
    """Confusion counts of two 0/1 marks, their agreement rate and Cohen's kappa."""
    counts = [F.sum(((machine == a) & (human == b)).cast("bigint")).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    table = pairs.filter(machine.isNotNull() & human.isNotNull()).agg(*counts)
    n = sum((F.col(f"n{a}{b}") for a in (0, 1) for b in (0, 1)), F.lit(0)).cast("double")
    observed = F.try_divide(F.col("n00") + F.col("n11"), n)
    chance = F.try_divide((F.col("n10") + F.col("n11")) * (F.col("n01") + F.col("n11")) + (F.col("n00") + F.col("n01")) * (F.col("n00") + F.col("n10")), n * n)
    return table.withColumns({"agreement": observed, "kappa": F.try_divide(observed - chance, 1 - chance)})


def cutoff_sweep(scores: DataFrame, score: str, human: str) -> DataFrame:
    """For every score as a cut-off: how many are flagged, and the share of those that are right.

    Scores are counted before the running sum, which then has a row for each distinct score
    and is made over ranges of scores. Rows without a score or without a human mark take no part.
    """
    known = scores.filter(F.col(score).isNotNull() & F.col(human).isNotNull())
    counted = known.groupBy(F.col(score).alias("cutoff")).agg(F.count(F.lit(1)).alias("n"), F.sum(human).cast("bigint").alias("good"))
    placed = in_order(counted, [], [F.col("cutoff").desc()], ["n", "good"])
    flagged = F.col("before_n") + F.col("n")
    return placed.select("cutoff", flagged.alias("flagged"), ((F.col("before_good") + F.col("good")) / flagged).alias("precision"))


def ungraded(answers: DataFrame, marks: DataFrame, on: list[str]) -> DataFrame:
    return answers.join(marks.select(*on), on, "left_anti")


def attempt_delta(scores: DataFrame, student: str, score: str, order: list[str]) -> DataFrame:
    """Attempt number, change since the attempt before, and best so far."""
    attempts = Window.partitionBy(student).orderBy(*order)
    so_far = attempts.rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumns({"attempt": F.row_number().over(attempts).cast("bigint"), "change": F.col(score) - F.lag(score).over(attempts), "best": F.max(score).over(so_far)})
