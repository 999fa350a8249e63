"""As-of joins: for each row what was last known of its key at its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import materialize


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` for the same ``by`` at or before ``left_time``.

    Null where there is none, where a key or the time is null, or where that row's value is null. Of
    rows of ``right`` with one key and time the greatest by ``values`` counts. ``values`` are new
    names in ``left``, which keeps all its rows and columns; times of both sides, and keys, must have one type.

    Both sides are dealt together by ranges of key and time, so a key with very many rows lies in
    several ranges: each looks back within itself, and beyond by what the ranges before knew last.
    """
    known = right.filter(F.expr(" and ".join(f"`{c}` is not null" for c in [*by, right_time]))).groupBy(*by, F.col(right_time).alias("_time")).agg(F.max(F.struct(*values)).alias("_known"))
    told = known.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_time", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_spread"), F.struct(F.col("_time").alias("at"), F.col("_known").alias("held")).alias("_told"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    asked = left.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.xxhash64(row).alias("_spread"), row.alias("_row"))
    keys = [f"_by_{c}" for c in by]
    order = ["_time", "_side", "_spread"]
    both = told.unionByName(asked, allowMissingColumns=True).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(both, "as-of")
    ends = dealt.groupBy(*keys, "_part").agg(F.max("_told").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("_part").alias("_part_"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("_seen", F.last("_told", ignorenulls=True).over(so_far)).filter("_side = 1")
    same = F.col("_part") == F.col("_part_")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = local.join(carried, same).withColumn("_now", F.when(F.col("_time").isNotNull(), F.coalesce("_seen", "_carried")))
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in left.columns], *[F.col(f"_now.held.`{v}`").alias(v) for v in values])
