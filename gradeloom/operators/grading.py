"""From answers to marks and scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.text import edit_credit, word_ngrams
from gradeloom.operators.asof import as_of
from gradeloom.session import materialize, ship_package

#: Marked examples, and vectors, that a task holds at a time.
EXEMPLAR_BLOCK = 4096
#: Vectors whose scores against a block are held at once.
SCORED_ROWS = 512
#: Cells of the grid that blocks are dealt to, at most: tasks that compare blocks at one time.
PARTS = 256
#: Bands up to this number are sent to every task.
BROADCAST_BANDS = 10_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def grade_exact(answers: DataFrame, key: DataFrame, on: str, answer: str, key_text: str, full_mark: float = 1.0) -> DataFrame:
    """Full marks where the answer equals its key; no mark (null) where there is no key.

    A missing answer to a question with a key gets 0. The key should hold a question once.
    """
    right = F.when(F.col(answer) == F.col(key_text), F.lit(full_mark)).when(F.col(key_text).isNotNull(), F.lit(0.0))
    return answers.join(key, on, "left").withColumn("mark", right)


def grade_edit_distance(answers: DataFrame, key: DataFrame, on: str, answer: str, key_text: str) -> DataFrame:
    """Partial credit by edit distance, for answers with slips of recognition; null without answer or key."""
    return answers.join(key, on, "left").withColumn("credit", edit_credit(F.col(answer), F.col(key_text)))


def rubric_coverage(answers: DataFrame, rubric: DataFrame, answer_key: str, answer: str, item_key: str, passage: str, n: int, min_share: float) -> DataFrame:
    """How much of each criterion's word n-grams an answer holds, from ``min_share`` (over 0) on.

    N-grams travel as 128-bit digests. Of the answers' only those that the rubric has are kept,
    once for each answer, however many criteria share them. A criterion with ``t`` n-grams of which ``m``
    are wanted is met by no answer that lacks its ``t - m + 1`` rarest ones, so answers and
    criteria meet by those alone, and are then compared in full: an n-gram that very many answers
    and criteria hold costs one row for each answer, not for each pair.
    """
    digest = ["gram1", "gram2"]
    items = materialize(word_ngrams(rubric, item_key, passage, n).distinct(), "rubric")
    grams = items.select(*digest).distinct()
    held = materialize(word_ngrams(answers, answer_key, answer, n).join(grams, digest, "left_semi").distinct(), "held")
    often = held.groupBy(*digest).agg(F.count(F.lit(1)).alias("often"))
    totals = items.groupBy(item_key).agg(F.count(F.lit(1)).alias("grams_total"))
    place = F.row_number().over(Window.partitionBy(item_key).orderBy("often", *digest))
    lacking = F.col("grams_total") - F.ceil(F.col("grams_total") * F.lit(min_share) - 1e-9) + 1
    # An n-gram in no answer has a place as well: nobody meets by it.
    ranked = items.join(often, digest, "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("place", place)
    rarest = ranked.join(totals, item_key).filter(F.col("place") <= lacking).filter("often > 0").select(item_key, *digest)
    met = held.join(rarest, digest).select(answer_key, item_key).distinct()
    found = met.join(items, item_key).join(held, [answer_key, *digest]).groupBy(answer_key, item_key).agg(F.count(F.lit(1)).alias("grams_found"))
    share = F.col("grams_found") / F.col("grams_total")
    return found.join(totals, item_key).select(answer_key, item_key, "grams_total", "grams_found", share.alias("share")).filter(F.col("share") >= min_share)


def _pack(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``key label v`` as blocks of up to ``block_rows`` rows, sorted by key, null first as in Spark's windows."""

    def packed(rows: list, schema: pa.Schema) -> pa.RecordBatch:
        keys, labels, vectors = zip(*sorted(rows, key=lambda row: (row[0] is not None, row[0])), strict=True)
        columns = [pa.array([list(x)], pa.list_(schema.field(name).type)) for name, x in (("key", keys), ("label", labels))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([np.array(vectors, np.float64).tobytes()], pa.binary())], names=["keys", "labels", "vectors"])

    waiting: dict[int, list] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "label", "v")), strict=True):
            held = waiting.setdefault(len(row[2]), [])
            held.append(row)
            if len(held) == block_rows:
                yield packed(waiting.pop(len(row[2])), schema)
    for held in waiting.values():
        yield packed(held, schema)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's ``k`` highest scores, highest first, equal ones as they stand; only those are sorted."""
    if scores.shape[1] <= k or np.isnan(scores).any():
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    above, level = scores > least, scores == least
    level &= np.cumsum(level, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)
    places = np.nonzero(above | level)[1].reshape(len(scores), k)
    return np.take_along_axis(places, np.argsort(-np.take_along_axis(scores, places, 1), axis=1, kind="stable"), 1)


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks: every vector's best ``k`` of the block of examples."""
    for batch in batches:
        for row in range(batch.num_rows):
            keys, near_keys, labels = (batch.column(c)[row].values for c in ("keys", "near_keys", "near_labels"))
            vectors, matrix = (np.frombuffer(batch.column(c)[row].as_py(), np.float64).reshape(n, -1) for c, n in (("vectors", len(keys)), ("near_vectors", len(near_keys))))
            for start in range(0, len(keys), SCORED_ROWS):
                scores = vectors[start : start + SCORED_ROWS] @ matrix.T
                best = _best(scores, k)
                at, flat = np.repeat(np.arange(len(scores)), best.shape[1]), best.ravel()
                found = [keys.take(pa.array(start + at)), near_keys.take(pa.array(flat)), labels.take(pa.array(flat)), pa.array(scores[at, flat])]
                yield pa.RecordBatch.from_arrays(found, names=["key", "near_key", "near_label", "score"])


def _grid(n_own: int, n_near: int, cells: int) -> tuple[int, int]:
    """Rows and columns, of ``cells`` at most, for which the fewest copies of blocks are made."""
    cells = max(1, min(cells, n_own * n_near))
    rows = max(1, min(n_own, cells, round(math.sqrt(cells * n_own / max(1, n_near)))))
    return rows, max(1, min(n_near, cells // rows))


def grade_by_exemplar(vectors: DataFrame, exemplars: DataFrame, k: int, key: str, vector: str, label: str) -> DataFrame:
    """The label that most of the ``k`` most similar marked examples bear.

    Similarity is the dot product; ties go to the smaller key, and among labels with as many
    votes to the smaller label. Null vectors, vectors with null components and empty ones take
    no part on either side, and vectors of different lengths never meet; a vector that meets
    no example has no row. Keys and labels may be of any type that sorts. Tasks pack both
    tables into blocks of fixed size, one row each, and meet one pair of blocks at a time;
    each pair gives every vector its best ``k``. Pairs are made by a shuffle and a merge join, so nothing
    of either table goes to the driver, however small it is.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    block_rows = EXEMPLAR_BLOCK
    key_type, label_type = exemplars.schema[key].dataType, exemplars.schema[label].dataType

    def blocks(rows: DataFrame, labels: Column, prefix: str) -> DataFrame:
        known = rows.filter(F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False)))
        sent = known.select(F.col(key).cast(key_type).alias("key"), labels.cast(label_type).alias("label"), F.col(vector).alias("v"))
        schema = T.StructType([T.StructField("keys", T.ArrayType(key_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("vectors", T.BinaryType())])
        packed = materialize(sent.mapInArrow(lambda batches: _pack(batches, block_rows), schema), "blocks")
        dim = (F.octet_length("vectors") / (8 * F.size("keys"))).cast("int")
        return packed.select("*", dim.alias("dim")).select(*[F.col(c).alias(prefix + c) for c in [*packed.columns, "dim"]])

    own, near_blocks = blocks(vectors, F.lit(None), "").drop("labels"), blocks(exemplars, F.col(label), "near_")
    # Every block meets every other one in one cell of a grid: a vector's block goes to each cell of its row, an example's to each of its column.
    rows, columns = _grid(own.count(), near_blocks.count(), PARTS)
    row, column = (F.pmod(F.xxhash64(*held), F.lit(n).cast("bigint")) for held, n in ((["keys", "vectors"], rows), (["near_keys", "near_vectors"], columns)))
    own = own.withColumn("part", F.explode(F.sequence(row * columns, row * columns + (columns - 1))))
    near_blocks = near_blocks.withColumn("near_part", F.explode(F.sequence(column, column + (rows - 1) * columns, F.lit(columns).cast("bigint"))))
    # Spark takes the copies of a table for no larger than the table, and would send them all through the driver.
    pairs = own.hint("merge").join(near_blocks, (F.col("part") == F.col("near_part")) & (F.col("dim") == F.col("near_dim")))
    schema = T.StructType([T.StructField("key", key_type), T.StructField("near_key", key_type), T.StructField("near_label", label_type), T.StructField("score", T.DoubleType())])
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "4")  # rows of megabytes
    try:
        found = materialize(pairs.mapInArrow(lambda batches: _nearest(batches, k), schema), "nearest")
    finally:
        spark.conf.set(_BATCH, before)
    near = Window.partitionBy("key").orderBy(F.col("score").desc(), "near_key")
    votes = found.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).groupBy("key", "near_label").agg(F.count(F.lit(1)).alias("votes"))
    top = Window.partitionBy("key").orderBy(F.col("votes").desc(), "near_label")
    return votes.withColumn("place", F.row_number().over(top)).filter("place = 1").select(F.col("key").alias(key), F.col("near_label").alias("predicted"), "votes")


def latest_mark(marks: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One mark for each key: the first by ``order``, which should settle every tie."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return marks.withColumn("_place", F.row_number().over(newest)).filter("_place = 1").drop("_place")


def weighted_score(marks: DataFrame, keys: list[str], mark: str, weight: Column, cap: float) -> DataFrame:
    """Weighted total of marks up to ``cap``, over the most there could be.

    A missing mark earns nothing and its question still counts; null where no weight is left.
    """
    earned = F.when(F.col(mark).isNull(), F.lit(0.0)).otherwise(F.least(F.col(mark), F.lit(cap)))
    return marks.groupBy(*keys).agg((F.sum(earned * weight) / F.nullif(F.sum(F.lit(cap) * weight), F.lit(0.0))).alias("score"))


def grade_bands(scores: DataFrame, score: str, bands: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds the ``band`` with ``low <= score < high`` for the row's ``by`` columns; null outside all bands.

    ``bands`` has ``by``, ``band``, ``low`` and ``high``; a null ``high`` is open. Bands that overlap, or
    end at or before their beginning, raise an error; gaps are allowed. Null scores and keys have no band.

    As bands don't overlap, only the last one that begins at or below the score can hold it. Up to
    ``BROADCAST_BANDS`` of them, counted first, go to every task; beyond, scores and bands meet by an
    as-of join. Neither compares all scores with all bands.
    """
    by = by or []
    known = materialize(bands.filter("low is not null").select(*by, "band", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")), "bands")
    following = F.lead("low").over(Window.partitionBy(*by).orderBy("low"))
    wrong = known.withColumn("_next", following).filter("high <= low or low = _next or high > _next or (high is null and _next is not null)")
    bad = wrong.select(*by, "band", "low", "high").head(3)
    if bad:
        raise ValueError(f"bands overlap or are empty: {[tuple(row) for row in bad]}")
    value = F.col(score).cast("double")
    inside = (value >= F.col("_band.low")) & (F.col("_band.high").isNull() | (value < F.col("_band.high")))
    if known.count() > BROADCAST_BANDS:
        keyed = scores.withColumns({"_score": value, "_key": F.lit(0)})
        placed = as_of(keyed, known.withColumns({"_band": F.struct("band", "low", "high"), "_key": F.lit(0)}), [*by, "_key"], "_score", "low", ["_band"])
    else:
        listed = known.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("low", "high", "band"))).alias("_bands"))
        if by:
            placed = scores.join(F.broadcast(listed), by, "left")
        else:
            placed = scores.withColumn("_one", F.lit(1)).join(F.broadcast(listed.withColumn("_one", F.lit(1))), "_one", "left")
        below = F.filter("_bands", lambda x: x["low"] <= value)
        placed = placed.withColumn("_band", F.try_element_at(below, F.lit(-1)))
    return placed.select(*scores.columns, F.when(inside, F.col("_band.band")).alias("band"))
