"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings, fitted in numpy from confirmed
toxic texts and from texts whose label is not looked at. The risk of the negatives is
estimated as that of the unlabelled texts less the class prior's share of the positives',
and held at zero from below: where the sample drives it lower, the step goes the other way.
The fit uses a bounded sample of confirmed rows and of texts without a label; tasks find and
count the sample's features, and the driver gets those that take part only. Scoring reads
every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import ENTRY_BYTES, Carried, arrow_batches, map_texts
from gradeloom.session import Scratch, ship_package

#: Bounds of the sample: confirmed toxic rows, and rows taken without their label.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
FEATURE_BITS = 22
PREFIXES = (4, 5, 6)
#: A feature takes part if so many sampled positives hold it, and that share of them, and if its rates
#: and the prior make a text that holds it toxic with this chance at least.
MIN_POSITIVES, MIN_SHARE, MIN_CHANCE = 8, 0.01, 0.55
STEPS, RATE, DECAY, TOLERANCE = 400, 0.05, 3e-5, 0.01
#: Bytes of words that a worker remembers, about.
KEPT_BYTES = 32 << 20
_letters = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[int]:
    """Buckets of a lower-cased word: itself, and its beginnings."""
    marked = [f"={word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(x.encode()) >> (32 - FEATURE_BITS) for x in marked]


def chunk_words(chunk: str) -> list[str]:
    """The words in one run of a text without white space."""
    return [chunk.lower()] if chunk.isalpha() else _letters(chunk.lower())


def text_words(text: str) -> set[str]:
    return {word for chunk in set(text.split()) for word in chunk_words(chunk)}


def feature_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct buckets of each sampled text, as bytes of 32-bit numbers."""
    for frame in frames:
        rows = []
        for text in frame["text"]:
            found = [x for word in text_words(text) for x in word_features(word)]
            rows.append(np.unique(np.array(found, np.int32)).tobytes())
        yield frame[["positive"]].assign(features=rows)


@dataclass
class ToxicityModel:
    """Weights of the feature buckets that take part, and the bias."""

    weights: dict[int, float]
    bias: float
    known: dict[str, tuple] = field(default_factory=dict, repr=False)
    held: int = 0

    def chunk_weights(self, chunk: str) -> tuple[tuple[int, float], ...]:
        found = [(x, self.weights[x]) for word in chunk_words(chunk) for x in word_features(word) if x in self.weights]
        return tuple(found)

    def score(self, texts: list[str]) -> np.ndarray:
        """Every distinct feature of a text counts once."""
        known, out = self.known, np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            held: dict[int, float] = {}
            for chunk in set(text.split()):
                found = known.get(chunk)
                if found is None:
                    if self.held > KEPT_BYTES:
                        known.clear()
                        self.held = 0
                    found = known[chunk] = self.chunk_weights(chunk)
                    self.held += len(chunk) + ENTRY_BYTES
                if found:
                    held.update(found)
            out[i] += sum(held.values())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def count_features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of a task's positive and unlabelled texts hold each bucket."""
    held = {kind: [np.empty(0, np.int32)] for kind in (True, False)}
    for frame in frames:
        for kind, features in zip(frame["positive"], frame["features"], strict=True):
            held[kind].append(np.frombuffer(features, np.int32))
    for kind, found in held.items():
        buckets, n = np.unique(np.concatenate(found), return_counts=True)
        yield pd.DataFrame({"bucket": buckets, "n_positive": n * kind, "n_unlabelled": n * (not kind)})


def keep_features(frames: Iterator[pd.DataFrame], chosen: np.ndarray) -> Iterator[pd.DataFrame]:
    """The places among the chosen buckets of those that a text holds."""
    for frame in frames:
        rows = [np.flatnonzero(np.isin(chosen, np.frombuffer(x, np.int32), assume_unique=True)).astype(np.int32).tobytes() for x in frame["features"]]
        yield frame[["positive"]].assign(places=rows)


def fit_numpy(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by non-negative PU learning with the logistic loss, over the whole sample (Adam).

    Texts are given by the places of the features that they hold.
    """
    weight, bias = np.zeros(n_features), np.log(prior / (1 - prior))
    moment, square = np.zeros(n_features + 1), np.zeros(n_features + 1)
    flat = [(np.concatenate([np.empty(0, np.int32), *part]), np.repeat(np.arange(len(part)), [len(x) for x in part]), len(part)) for part in (positive, unlabelled)]
    (at_p, of_p, n_p), (at_u, of_u, n_u) = flat

    def slope(at: np.ndarray, of: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(at, each[of], minlength=n_features), each.sum())

    for step in range(1, STEPS + 1):
        z_p, z_u = (bias + np.bincount(of, weight[at], minlength=n) for at, of, n in flat)
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        # Logistic losses: log(1 + exp(-z)) for a positive, log(1 + exp(z)) for a negative.
        negative_risk = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        toward = slope(at_u, of_u, s_u / n_u) - prior * slope(at_p, of_p, s_p / n_p)
        change = slope(at_p, of_p, prior * (s_p - 1) / n_p) + toward if negative_risk >= -TOLERANCE else -toward
        change[:-1] += DECAY * weight
        moment, square = 0.9 * moment + 0.1 * change, 0.999 * square + 0.001 * change**2
        move = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, float(bias)


def sampled_texts(docs: DataFrame, labels: DataFrame, pool: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """``positive text``: the first documents by hash among the confirmed ones, and among all of ``pool``.

    Of rows that share a ``doc_id`` one counts, the one whose text is first by hash.
    """
    positive = labels.filter(F.col("toxic") == 1).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    unlabelled = pool.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(max_unlabelled)
    sample = positive.select("doc_id", F.lit(True).alias("positive")).unionByName(unlabelled.select("doc_id", F.lit(False).alias("positive")))
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")  # bounded by the parameters
    return texts.groupBy("doc_id", "positive").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("positive", "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, unlabelled: DataFrame | None = None) -> ToxicityModel:
    """Fit on confirmed toxic texts of ``labels`` (``doc_id toxic``) and on texts of ``unlabelled``.

    ``unlabelled`` are the documents that may be drawn without a look at their labels; without
    it, all of ``docs``. Both samples are bounded by the two parameters. The class prior is
    the share of toxic rows among all labelled ones, every row counted; several labels of one
    document make it toxic if one does. Null ids, labels and texts take no part. Without a
    toxic row the model scores about 0.
    """
    texts = Carried(docs, ["doc_id", "text"], []).df.select("doc_id", "text")
    pool = texts if unlabelled is None else Carried(unlabelled, ["doc_id"], []).df
    known = Carried(labels, ["doc_id", "toxic"], []).df.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counted = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    if not counted["toxic"]:
        return ToxicityModel({}, -30.0)
    prior = min(0.5, max(1e-3, counted["toxic"] / counted["n"]))
    sample = sampled_texts(texts, known, pool, max_positive, max_unlabelled)
    scratch = Scratch(docs.sparkSession, "toxicity")
    with arrow_batches(docs.sparkSession):
        features = scratch.write(sample.mapInPandas(feature_frames, "positive boolean, features binary"), "features")
    sizes = {row["positive"]: row["count"] for row in features.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return ToxicityModel({}, -30.0)
    counts = features.mapInPandas(count_features, "bucket int, n_positive long, n_unlabelled long").groupBy("bucket").agg(F.sum("n_positive").alias("n_positive"), F.sum("n_unlabelled").alias("n_unlabelled"))
    chance = prior * (F.col("n_positive") / n_p) / ((F.col("n_unlabelled") + 1) / (n_u + 1))
    telling = counts.filter((F.col("n_positive") >= min(max(MIN_POSITIVES, MIN_SHARE * n_p), n_p)) & (chance >= MIN_CHANCE))
    # So many positive texts must hold each one that there are a few for each word of a text at most.
    chosen = np.array(sorted(row["bucket"] for row in telling.select("bucket").collect()), np.int32)
    kept = features.mapInPandas(lambda frames: keep_features(frames, chosen), "positive boolean, places binary").collect()
    scratch.drop("features")
    rows = {kind: [np.frombuffer(x["places"], np.int32) for x in kept if x["positive"] == kind] for kind in (True, False)}
    weight, bias = fit_numpy(rows[True], rows[False], len(chosen), prior)
    return ToxicityModel(dict(zip(chosen.tolist(), weight.tolist(), strict=True)), bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep_text: bool = False) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row.

    Only the text decides, all of it; a null or empty text scores as one without any of the
    words. Repeated rows get equal scores; an input column named like an output, in any case
    of letters, is replaced, others stay (``text`` with ``keep_text``). An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # weights of the features that take part

    def score(texts: list[str]) -> list:
        scores = held.value.score(texts)
        return [scores, (scores >= 0.5).astype(np.int32)]

    return map_texts(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], score, keep_text)
