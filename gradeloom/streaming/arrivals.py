"""Page arrival as a stream: answers kept up to date, and counts of arrivals by hour.

Each micro-batch writes folders named by its number, or by the buckets that it touches, and
overwrites them. A batch that is run again after a failure therefore leaves the same tables,
and a stream that starts again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gradeloom.operators.answers import assemble_answers


def read_arrivals(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 1_000) -> DataFrame:
    """New Parquet files of ``folder`` as a stream. The schema is given: a stream can't guess one from files to come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_pages(arrivals: DataFrame, keys: list[str], page: str, arrived: str, delay: str) -> DataFrame:
    """The first arrival of each page; a page sent again within ``delay`` is dropped, one sent later counts anew.

    The state holds pages for ``delay`` after the latest arrival, not for ever.
    """
    return arrivals.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([*keys, page])


class AnswerStore:
    """Pages and assembled answers below one folder, in buckets by key.

    ``pages`` is partitioned by bucket and batch, ``answers`` by bucket. A batch rewrites the
    answers of the buckets that it has pages for, from all their pages so far.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], page: str, text: str, buckets: int = 64):
        self.spark, self.folder, self.keys, self.page, self.text, self.buckets = spark, folder, keys, page, text, buckets

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; running it again for the same batch changes nothing."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.keys, self.page, self.text, bucket.alias("bucket"), F.lit(batch_id).cast("bigint").alias("batch"))
        dynamic = {"partitionOverwriteMode": "dynamic"}
        rows.repartition("bucket").write.mode("overwrite").options(**dynamic).partitionBy("bucket", "batch").parquet(f"{self.folder}/pages")
        # Bucket numbers are few, whatever a batch holds. They come from the table that was written, so that a batch is read once.
        pages = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/pages")
        touched = [row["bucket"] for row in pages.filter(F.col("batch") == batch_id).select("bucket").distinct().collect()]
        if touched:
            known = pages.filter(F.col("bucket").isin(touched) & (F.col("batch") <= batch_id))
            answers = assemble_answers(self.newest(known), ["bucket", *self.keys], self.page, self.text)
            answers.write.mode("overwrite").options(**dynamic).partitionBy("bucket").parquet(f"{self.folder}/answers")

    def newest(self, pages: DataFrame) -> DataFrame:
        """Of a page that arrived in several batches the last one counts; within one batch all of them do."""
        last = Window.partitionBy(*self.keys, self.page)
        return pages.withColumn("_last", F.max("batch").over(last)).filter("batch = _last").drop("_last", "batch")

    def answers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/answers").drop("bucket")


def keep_answers(arrivals: DataFrame, store: AnswerStore, checkpoint: str) -> StreamingQuery:
    """Start the stream into the store over all that is there; it ends when that is done."""
    return arrivals.writeStream.foreachBatch(store.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(arrivals: DataFrame, by: list[str], arrived: str, delay: str, width: str) -> DataFrame:
    """Running counts of arrivals in windows of time; those later than ``delay`` behind the latest one are dropped."""
    counted = arrivals.withWatermark(arrived, delay).groupBy(F.window(arrived, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")


def keep_counts(counts: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Start the stream of changed counts: each batch writes its own folder, again if it is run again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """The counts as of the last batch that changed each."""
    return spark.read.parquet(folder).groupBy("window_start", *by).agg(F.max_by("n", "batch").alias("n"))
