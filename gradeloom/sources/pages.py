"""Page images: reading them, and handing them to a recogniser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from gradeloom.session import Scratch


def scan_page_images(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """Files below ``directory`` with path, time, length and content.

    Folders named ``key=value`` become columns; a query that leaves ``content`` out does not
    read the files' bytes.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(directory)


def with_page_keys(images: DataFrame, pattern: str = r"([^/_]+)_(\d+)_(\d+)\.[^./]+$") -> DataFrame:
    """``submission question page_no`` from file names like ``17_2_1.png``; null where they don't fit."""

    def part(i: int):
        found = F.regexp_extract("path", pattern, i)
        return F.when(found != "", found)

    return images.withColumns({"submission": part(1), "question": part(2).cast("int"), "page_no": part(3).cast("int")})


def transcribe_pages(pages: DataFrame, recognise: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str, on_error: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """Run the caller's recogniser over the pages in batches.

    Filter ``pages`` first: Spark can't move a filter below this step. With ``on_error`` a batch
    that fails is tried page by page, and the pages that fail alone are given to ``on_error``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if on_error is None:
                yield recognise(frame)
                continue
            try:
                yield recognise(frame)
            except Exception:
                for i in range(len(frame)):
                    page = frame.iloc[i : i + 1]
                    try:
                        yield recognise(page)
                    except Exception:
                        yield on_error(page)

    return pages.mapInPandas(run, schema)


def transcribe_with_quarantine(
    pages: DataFrame, recognise: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType, key: str, folder: str | None = None, rows_per_call: int = 64
) -> tuple[DataFrame, DataFrame]:
    """``(transcripts, failures)``: what the recogniser gives, and the pages that it fails on by themselves.

    Pages are handed over ``rows_per_call`` at a time. A call that raises is made again for each half of
    its pages, and so on, so a bad page among ``n`` costs about ``2 log2(n)`` calls more and the others
    are still read in batches. A page that fails alone is a row of ``failures``: its ``key`` and the
    error's type and text as ``reason``. A call that gives another number of rows than it had pages
    counts as failed. Both are tables below ``folder`` (the shared scratch folder if there
    is none), written in one pass: recognition is not run again when they are read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "transcripts")
    if folder is not None:
        scratch.folder = folder
    names, key_type = schema.fieldNames(), pages.schema[key].dataType
    both = StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("_failed_key", key_type), T.StructField("_reason", T.StringType())])

    def attempt(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        try:
            found = recognise(frame)
            if len(found) != len(frame):
                raise ValueError(f"{len(found)} rows for {len(frame)} pages")
            yield found.assign(_failed_key=None, _reason=None)
        except Exception as error:
            if len(frame) == 1:
                yield pd.DataFrame({**dict.fromkeys(names, [None]), "_failed_key": [frame[key].iloc[0]], "_reason": [f"{type(error).__name__}: {error}"]})
            else:
                middle = len(frame) // 2
                yield from attempt(frame.iloc[:middle])
                yield from attempt(frame.iloc[middle:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), rows_per_call):
                yield from attempt(frame.iloc[start : start + rows_per_call])

    told = F.col("_reason").isNotNull().alias("failed")
    written = scratch.write(pages.mapInPandas(run, both).select("*", told), "all", "failed")
    transcripts = written.filter("not failed").select(*names)
    failures = written.filter("failed").select(F.col("_failed_key").alias(key), F.col("_reason").alias("reason"))
    return transcripts, failures
