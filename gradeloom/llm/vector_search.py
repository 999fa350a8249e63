"""Exact top-k search by inner product with a vector-approximation file.

The file is a table of blocks. A block holds the cells of up to ``block_rows`` vectors: each
component's cell number, one byte, on the block's own grid. A search scans the cells for
bounds of every score; a part of the file is scanned first, so that for the rest each query
knows a score that its kth best reaches at least, and blocks and vectors below it drop out.
What is left is read exactly, by id, in the order of the bounds: first the best few of each
query, then all that may still reach the kth score of those.

Blocks of queries meet blocks of cells, so no task holds more than one of each at a time. The
file is made where the vectors are read, without a shuffle; its cells and the queries are dealt
to a grid and meet by a merge join. So do exact vectors and their candidates: no vector goes
through the driver, however small its table is. Equal vectors differ in their ids alone: those
that can't be among the best ``k`` of any query are left out of the scans, so a vector with very
many copies makes no more candidates than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Carried, arrow_batches, digest_columns
from gradeloom.session import Scratch

BLOCK_ROWS = 4096
CELL_BITS = 8
#: One block in so many is scanned first.
FIRST_SHARE = 64
#: So many times k vectors of each query are read before the others.
FIRST_READ = 4
#: Queries whose bounds are held at once.
SCANNED_QUERIES = 256
FILE_SCHEMA = "dim int, block long, keys binary, ids binary, cells binary, low binary, width binary"
QUERY_SCHEMA = "dim int, query_keys binary, query_ids binary, floors binary, queries binary"
BOUNDS_SCHEMA = "query_key long, key long, low double, high double"


def usable(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def exact_rows(table: DataFrame, scale: int) -> DataFrame:
    """``vec_id row`` of all rows that take part."""
    held = Carried(table, ["vec_id", "embedding"], []).df
    return held.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("row"))


def surplus_by_block(exact: DataFrame, k: int, block_rows: int) -> DataFrame:
    """``block surplus``: keys of rows that can't be among any query's best ``k``, by ranges of ``block_rows`` keys.

    Of equal vectors those can that are first by id: ``k`` besides those of any one id, which may
    be the query's own. Both limits are kept within each task before anything is shuffled, and
    what is shuffled are digests, ids and keys, not vectors.
    """
    seen = exact.select("one", "two", "vec_id", "key")
    same_id = Window.partitionBy("one", "two", "vec_id").orderBy("key")
    same_row = Window.partitionBy("one", "two").orderBy("vec_id", "key")
    first = seen
    for window, most in ((same_id, k), (same_row, 2 * k)):
        first = first.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= most).drop("place")
    others = seen.select("key").hint("merge").join(first.select("key"), "key", "left_anti")
    return others.groupBy(F.floor(F.col("key") / F.lit(block_rows)).cast("long").alias("block")).agg(F.collect_list("key").alias("surplus"))


def blocks_of(batches: Iterator[pa.RecordBatch], names: list[str], block_rows: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The vectors ``row`` of one length, up to ``block_rows`` at a time, with their other columns."""
    waiting: dict[int, list[pa.RecordBatch]] = {}

    def whole(dim: int, parts: list[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray]]:
        block = pa.Table.from_batches(parts).combine_chunks()
        rows = np.concatenate([x.flatten().to_numpy() for x in block.column("row").chunks]).reshape(block.num_rows, dim)
        return rows, [block.column(name).to_numpy() for name in names]

    for batch in batches:
        dims = pc.list_value_length(batch.column("row")).to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            held = waiting.setdefault(dim, [])
            while own.num_rows:
                room = block_rows - sum(x.num_rows for x in held)
                held.append(own.slice(0, room))
                own = own.slice(room)
                if sum(x.num_rows for x in held) == block_rows:
                    yield whole(dim, held)
                    held.clear()
    for dim, held in waiting.items():
        if held:
            yield whole(dim, held)


def key_ranges(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows that follow each other and whose keys lie in one range of ``block_rows``, with its number."""
    held: list[pa.RecordBatch] = []
    number = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers = batch.column("key").to_numpy() // block_rows
        cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if held and numbers[start] != number:
                yield number, held
                held = []
            number = int(numbers[start])
            held.append(batch.slice(start, end - start))
    if held:
        yield number, held


def record(**values: object) -> pa.RecordBatch:
    kinds = {"dim": pa.int32(), "block": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([x], kinds[name]) if name in kinds else pa.array([x.tobytes()], pa.binary()) for name, x in values.items()], names=list(values))


def file_block(rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, number: int = 0) -> pa.RecordBatch:
    """One row of the file: cells and their grid."""
    low = rows.min(axis=0)
    width = (rows.max(axis=0) - low) // (1 << CELL_BITS) + 1
    return record(dim=rows.shape[1], block=number, keys=keys, ids=ids, cells=((rows - low) // width).astype(np.uint8), low=low, width=width)


def file_frames(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    for number, parts in key_ranges(batches, block_rows):
        for rows, (keys, ids) in blocks_of(parts, ["key", "vec_id"], block_rows):
            yield file_block(rows, keys, ids, number)


def query_frames(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    for rows, (keys, ids, floors) in blocks_of(batches, ["query_key", "query_id", "floor"], block_rows):
        yield record(dim=rows.shape[1], query_keys=keys, query_ids=ids, floors=floors, queries=rows)


def scan_block(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, block: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(queries' places, vectors' places, low bounds, high bounds) of what may be among the best ``k``.

    That is what reaches the query's floor, and the kth best low bound in the block.
    """
    dim = queries.shape[1]
    ids, low, width = (np.frombuffer(block[x], np.int64) for x in ("ids", "low", "width"))
    cells = np.frombuffer(block["cells"], np.uint8).reshape(len(ids), dim)
    half = (width - 1) / 2
    centre = None
    reach = width * ((1 << CELL_BITS) - 1) / 2 + half
    box = low + reach
    for start in range(0, len(queries), SCANNED_QUERIES):
        part = queries[start : start + SCANNED_QUERIES].astype(np.float64)
        error = 1e-9 * (np.abs(part) @ (np.abs(box) + reach) + 1)
        floor = floors[start : start + SCANNED_QUERIES]
        open_ = np.flatnonzero(part @ box + np.abs(part) @ reach + error >= floor)  # the others can't be served by any vector of the block
        if not len(open_):
            continue
        if centre is None:
            centre = (low + cells * width + half).T
        part, floor, own = part[open_], floor[open_], query_ids[start + open_]
        middle = part @ centre
        middle[own[:, None] == ids[None, :]] = -np.inf
        slack = np.abs(part) @ half + error[open_]
        if len(ids) > k:
            floor = np.maximum(floor, np.partition(middle, len(ids) - k, axis=1)[:, len(ids) - k] - slack)
        at, vector = np.nonzero((middle + slack[:, None] >= floor[:, None]) & (middle > -np.inf))
        found = middle[at, vector]
        yield start + open_[at], vector, found - slack[at], found + slack[at]


def scan_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            query_keys, query_ids = (np.frombuffer(row[x], np.int64) for x in ("query_keys", "query_ids"))
            queries, floors = np.frombuffer(row["queries"], np.int64).reshape(len(query_ids), row["dim"]), np.frombuffer(row["floors"], np.float64)
            keys = np.frombuffer(row["keys"], np.int64)
            if row["surplus"]:
                kept = ~np.isin(keys, row["surplus"])
                if not kept.any():
                    continue
                row["ids"] = np.frombuffer(row["ids"], np.int64)[kept].tobytes()
                row["cells"] = np.frombuffer(row["cells"], np.uint8).reshape(len(keys), row["dim"])[kept].tobytes()
                keys = keys[kept]
            for query, vector, low, high in scan_block(queries, query_ids, floors, row, k):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_keys[query], keys[vector], low, high)], names=["query_key", "key", "low", "high"])


def grid(n_queries: int, n_blocks: int, cells: int) -> tuple[int, int]:
    """Rows and columns, of ``cells`` at most, for which the least is copied; a block of queries is eight times one of the file."""
    cells = max(1, min(cells, n_queries * n_blocks))
    rows = max(1, min(n_queries, cells, round(math.sqrt(8 * cells * n_queries / max(1, n_blocks)))))
    return rows, max(1, min(n_blocks, cells // rows))


def dealt(keys: str, n: int) -> Column:
    """One of ``n`` places for a block, whether it is scanned first or not."""
    return F.pmod(F.xxhash64(F.lit("dealt"), keys), F.lit(n).cast("long"))


def scanned(filed: DataFrame, asked: DataFrame, k: int, block_rows: int, scratch: Scratch, name: str) -> DataFrame:
    """Bounds of what may be among each query's best ``k`` in the blocks of ``filed``.

    Each block of queries meets each of the file in one cell of a grid: it goes to every cell of
    its row, a block of the file to every cell of its column.
    """
    spark = asked.sparkSession
    blocks = scratch.write(asked.mapInArrow(lambda batches: query_frames(batches, block_rows), QUERY_SCHEMA), f"{name}-queries")
    rows, columns = grid(blocks.count(), filed.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    row, column = dealt("query_keys", rows), dealt("keys", columns)
    left = blocks.withColumn("part", F.explode(F.sequence(row * columns, row * columns + (columns - 1))))
    right = filed.withColumn("part", F.explode(F.sequence(column, column + (rows - 1) * columns, F.lit(columns).cast("long"))))
    with arrow_batches(spark, 4):  # rows of megabytes
        # Spark takes the copies of a table for no larger than the table, and would send them all through the driver.
        return scratch.write(left.hint("merge").join(right, ["dim", "part"]).drop("part").mapInArrow(lambda batches: scan_pairs(batches, k), BOUNDS_SCHEMA), name)


def kth(rows: DataFrame, k: int, value: str, name: str) -> DataFrame:
    """``query_key`` and its kth largest ``value``, where there are so many."""
    order = Window.partitionBy("query_key").orderBy(F.col(value).desc())
    placed = rows.select("query_key", value).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return placed.filter(F.col("place") == k).select("query_key", F.col(value).alias(name))


def top_k_inner_product(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each query's ``k`` highest integer inner products over ``vectors``, exactly.

    Components become ``floor(scale * x)``. Returns ``query_id rank vec_id score``; ties go
    to the smaller ``vec_id``; all rows where there are fewer than ``k``. Rows with the
    query's own ``vec_id`` are no candidates. Rows whose id or vector is null, or whose vector
    holds a null or non-finite component, take no part, and vectors of different lengths
    never meet. A repeated row is a candidate as often as it occurs, but asks once; rows with
    one ``vec_id`` and different vectors ask each for itself, under the same ``query_id``. Other
    columns are ignored. Empty tables give an empty result. Scores must fit a long:
    components up to about 2 ** 20 do.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vector-search")
    one, two = digest_columns(F.col("row"))
    exact = scratch.write(exact_rows(vectors, scale).select(F.monotonically_increasing_id().alias("key"), "vec_id", "row", one.alias("one"), two.alias("two")), "exact")
    with arrow_batches(spark, block_rows):
        cells = scratch.write(exact.select("key", "vec_id", "row").mapInArrow(lambda batches: file_frames(batches, block_rows), FILE_SCHEMA), "file")
    filed = cells.join(scratch.write(surplus_by_block(exact, k, block_rows), "surplus"), "block", "left").drop("block")
    one_each = exact_rows(queries, scale).distinct().repartition(max(1, -(-queries.count() // block_rows)))
    asked = scratch.write(one_each.select(F.monotonically_increasing_id().alias("query_key"), F.col("vec_id").alias("query_id"), "row"), "asked")

    none = F.lit(float("-inf"))
    early = F.pmod(F.xxhash64("keys"), F.lit(FIRST_SHARE)) == 0
    first = scanned(filed.filter(early), asked.withColumn("floor", none), k, block_rows, scratch, "first-scan")
    floors = asked.join(kth(first, k, "low", "known"), "query_key", "left").withColumn("floor", F.coalesce("known", none)).drop("known")
    rest = scanned(filed.filter(~early), floors, k, block_rows, scratch, "second-scan")
    bounds = first.unionByName(rest)
    reached = bounds.join(kth(bounds, k, "low", "bar"), "query_key", "left").filter(F.col("bar").isNull() | (F.col("high") >= F.col("bar")))
    order = Window.partitionBy("query_key").orderBy(F.col("high").desc(), "key")
    queue = scratch.write(reached.select("query_key", "key", "high", F.row_number().over(order).alias("place")), "queue")
    scratch.drop("file", "surplus", "first-scan", "first-scan-queries", "second-scan", "second-scan-queries")

    def read(rows: DataFrame) -> DataFrame:
        product = F.aggregate(F.zip_with("row", "query", lambda x, y: x * y), F.lit(0).cast("long"), lambda total, x: total + x)
        # Equal vectors take next to nothing in a file: its size doesn't tell what a broadcast of them would hold.
        known = rows.select("query_key", "key").hint("merge").join(exact, "key").hint("merge").join(asked.select("query_key", "query_id", F.col("row").alias("query")), "query_key")
        return known.select("query_key", "query_id", "vec_id", product.alias("score"))

    best = scratch.write(read(queue.filter(F.col("place") <= FIRST_READ * k)), "first-read")
    later = queue.filter(F.col("place") > FIRST_READ * k).join(kth(best, k, "score", "bar"), "query_key").filter(F.col("high") >= F.col("bar"))
    by_score = Window.partitionBy("query_key").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = best.unionByName(read(later)).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    found = scratch.write(ranked.select("query_id", "rank", "vec_id", "score"), "found")
    scratch.drop("exact", "asked", "queue", "first-read")
    return found
