"""Small expressions and settings that several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gradeloom.session import ship_package

#: The white space of the contracts (space, tab to carriage return), ASCII letters.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def digest_columns(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the same values: 128 bits against collisions."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


class Carried:
    """A table whose columns have names that clash with nothing.

    The ``needed`` columns keep the names that the operator asks for, all others are ``c0``,
    ``c1`` and so on by their place, so a caller's column may be called anything. ``rest`` has
    (name here, caller's name) of the columns that come back: all but those named like an
    output, in any case of letters, since Spark does not tell cases apart.
    """

    def __init__(self, df: DataFrame, needed: list[str], outputs: list[str]):
        places = {}
        for name in needed:
            fits = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
            if len(fits) != 1:
                raise ValueError(f"one column {name} is needed, the table has {df.columns}")
            places[fits[0]] = name
        ids = [places.get(i, f"c{i}") for i in range(len(df.columns))]
        replaced = {x.lower() for x in outputs}
        self.df = df.toDF(*ids)
        self.rest = [(x, c) for x, c in zip(ids, df.columns, strict=True) if c.lower() not in replaced]

    def without(self, *names: str) -> list[tuple[str, str]]:
        return [(x, c) for x, c in self.rest if x not in names]


def named(df: DataFrame, rest: list[tuple[str, str]], outputs: list[str]) -> DataFrame:
    """The caller's columns under their own names, then the outputs."""
    return df.select(*[F.col(x).alias(c) for x, c in rest], *outputs)


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """Add output columns made from ``df``'s own; a column of the same name, in any case of letters, gives way."""
    replaced = {x.lower() for x in outputs}
    kept = [c for c in df.columns if c.lower() not in replaced]
    return df.select(*[df[f"`{c}`"] for c in kept], *[value.alias(name) for name, value in outputs.items()])


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


#: Code points that numpy steps work on at once, but for longer single texts.
BATCH_CHARS = 400_000


def text_slices(texts: list[str], rows: int = 512, chars: int = BATCH_CHARS) -> Iterator[slice]:
    """Consecutive parts of the list with about ``chars`` code points and ``rows`` texts at most."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and (held + len(text) > chars or i - start >= rows):
            yield slice(start, i)
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def batch_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """As ``text_slices``, of an Arrow batch by the lengths of one of its columns."""
    start = held = 0
    for i, size in enumerate(pc.utf8_length(batch.column(column)).to_pylist()):
        if i > start and (held + size > BATCH_CHARS or i - start >= 512):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(docs: DataFrame, added: list[T.StructField], results: Callable[[list[str]], list], keep_text: bool = False) -> DataFrame:
    """The documents with the columns ``added`` that ``results`` gives for each part of their texts (null: empty).

    ``text`` itself comes back with ``keep_text`` only. All other columns pass through Arrow as
    they are; one named like an added one gives way.
    """
    names = [f.name for f in added]
    held = Carried(docs, ["text"], names)
    rest = held.without() if keep_text else held.without("text")
    sent = held.df.select(*[x for x, _ in rest], F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([*sent.drop("_text").schema.fields, *added])
    types = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch_slices(batch, "_text"):
                texts = own.column("_text").to_pylist()
                found = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(results(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], *found], names=schema.names)
        pa.default_memory_pool().release_unused()

    return named(sent.mapInArrow(run, schema), rest, names)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of texts that JVM and worker hold at once where an operator runs its own job.
TEXT_ROWS = 500


@contextmanager
def arrow_batches(spark, rows: int = TEXT_ROWS):
    """Arrow batches of so many rows at most for the jobs that are run inside; a lower setting stays.

    For what runs later, in the caller's jobs, Spark's own bound holds: 64 MB a batch
    (``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    ship_package(spark)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def release_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of jobs whose result is written.

    Its cleaner deletes them soon after the driver has collected its garbage, which may be long in
    coming. The scheduler holds on to its last job, so a job of one row comes first.
    """
    spark.range(1).count()
    gc.collect()
    spark._jvm.System.gc()


#: What a word and its ids take besides their own letters and bytes, about.
ENTRY_BYTES = 200


class Remembered:
    """What a worker remembers of words, bounded by bytes: when one half is full, the older half goes."""

    def __init__(self, limit: int):
        self.limit, self.held = limit // 2, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, words: set[str]) -> list[str]:
        """Those of the words that are not known; the known ones are in ``new`` from here on."""
        unknown = words.difference(self.new)
        again = unknown.intersection(self.old)
        if again:
            self.learn(list(again), [self.old[x] for x in again])
        return list(unknown.difference(again))

    def learn(self, words: list[str], values: list[bytes]) -> None:
        self.new.update(zip(words, values, strict=True))
        self.held += sum(map(len, words)) + sum(map(len, values)) + ENTRY_BYTES * len(words)

    def settle(self) -> None:
        """Call when a batch is done: its words need not be known any more."""
        if self.held > self.limit:
            self.old, self.new, self.held = self.new, {}, 0
