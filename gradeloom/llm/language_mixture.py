"""Language identification by multilingual mixture inference.

Each language is a distribution over hashed character trigrams, counted over all labelled
texts. A document's trigrams are taken as draws from a mixture of languages, and of a
uniform background for what is in none of them; expectation-maximisation estimates the
proportions, for all documents of a batch at once. The set of languages is chosen by
penalised likelihood: each further language must gain more than half the logarithm of the
number of trigrams, times ``PENALTY``. Nothing else bounds the size of the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.common import BATCH_CHARS, Carried, arrow_batches, map_texts, text_slices
from gradeloom.session import ship_package

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.05
MAX_LANGUAGES = 500
#: Sets of up to so many are tried for every text, larger ones as long as the last one gained.
TRIED_SIZES = 4
EM_STEPS = 12
#: Likelihoods (trigrams x languages) that a worker holds at once, about.
BATCH_LIKELIHOODS = 8_000_000
PENALTY = 2.0
UNKNOWN = "und"


@cache
def letter_codes() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed trigram) of all texts in order, and which texts hold a letter.

    Trigrams are of lower-cased letters, with one space for whatever stands between words
    and at both ends.
    """
    lowered = [text.lower() for text in texts]
    flat = " " + " ".join(lowered) + " "
    codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) + 1 for x in lowered])
    owner = np.append(np.int32(0), owner)  # the first space
    letter = letter_codes()[codes]
    keep = letter | np.append(True, letter[:-1])
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], letter[keep]
    has_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), has_letter
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    inside = letter[1:-1] & ((owner[:-2] == owner[1:-1]) | ~letter[:-2]) & ((owner[1:-1] == owner[2:]) | ~letter[2:])
    return owner[1:-1][inside].astype(np.int64), (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[inside], has_letter


@dataclass
class LanguageModel:
    """``probability[language, bucket]``; the last row is the background."""

    languages: list[str]
    probability: np.ndarray


def count_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, group in frame.groupby("lang")["text"]:
            texts = group.tolist()
            for part in text_slices(texts):
                _, buckets, _ = trigrams(texts[part])
                counts[lang] = counts.get(lang, 0) + np.bincount(buckets, minlength=BUCKETS)
    for lang, found in counts.items():
        at = np.flatnonzero(found)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": found[at]})


def packed_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's counts as one row for each language."""
    for frame in frames:
        for lang, group in frame.groupby("lang"):
            yield pd.DataFrame({"lang": [lang], "buckets": [group["bucket"].to_numpy(np.int32).tobytes()], "counts": [group["n"].to_numpy(np.int64).tobytes()]})


def fit_languages(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows with a text and a ``lang``.

    The driver gets one number for each language and bucket at most, ``MAX_LANGUAGES`` x
    ``BUCKETS``; as many go out to every task, so more languages than that are an error.
    """
    held = Carried(labelled, ["text", "lang"], []).df
    rows = held.select("text", F.col("lang").cast("string").alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = rows.mapInPandas(count_frames, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    with arrow_batches(labelled.sparkSession):
        found = counted.mapInPandas(packed_counts, "lang string, buckets binary, counts binary").collect()
    languages = sorted({row["lang"] for row in found})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; at most {MAX_LANGUAGES} are supported")
    smoothed = np.full((len(languages) + 1, BUCKETS), SMOOTHING)
    for row in found:
        smoothed[languages.index(row["lang"]), np.frombuffer(row["buckets"], np.int32)] += np.frombuffer(row["counts"], np.int64)
    smoothed[-1] = 1
    return LanguageModel(languages, (smoothed / smoothed.sum(axis=1, keepdims=True)).astype(np.float32))


def expectation_maximisation(chance: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each document's components, and the log likelihood they give.

    A component whose share starts at 0 stays out.
    """
    total = np.add.reduceat(weight, starts)
    for _ in range(EM_STEPS):
        part = chance * np.repeat(shares, sizes, axis=0)
        part *= (weight / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        shares = np.add.reduceat(part, starts, axis=0) / total[:, None]
    mixed = (chance * np.repeat(shares, sizes, axis=0)).sum(axis=1)
    return shares, np.add.reduceat(weight * np.log(np.maximum(mixed, 1e-30)), starts)


def mixtures(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's proportions (0 outside the chosen set), its likeliest single language, and whether it holds a letter."""
    owner, buckets, has_letter = trigrams(texts)
    shares, likeliest = np.zeros((len(texts), len(model.probability)), np.float32), np.zeros(len(texts), np.int64)
    if not len(owner) or not model.languages:
        return shares, likeliest, has_letter & False
    keys, counts = np.unique(owner * BUCKETS + buckets, return_counts=True)
    docs, weight = keys // BUCKETS, counts.astype(np.float32)
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    sizes = np.diff(np.append(starts, len(docs)))
    chance = np.ascontiguousarray(model.probability.T)[keys % BUCKETS]
    total = np.add.reduceat(weight, starts)
    n, k = len(starts), chance.shape[1]
    alone = np.add.reduceat(weight[:, None] * np.log(chance), starts, axis=0)
    first = alone.argmax(axis=1)
    best_shares = np.eye(k, dtype=np.float32)[first]
    best = alone[np.arange(n), first]
    full, _ = expectation_maximisation(chance, weight, starts, sizes, np.full((n, k), 1 / k, np.float32))
    full[np.arange(n), first] = 2  # the best single one belongs to every set
    order = np.argsort(-full, axis=1, kind="stable")
    at, part, part_weight, part_starts, part_sizes = np.arange(n), chance, weight, starts, sizes  # the texts that are still tried
    for size in range(2, k + 1):
        start = np.zeros((len(at), k), np.float32)
        np.put_along_axis(start, order[at, :size], 1 / size, axis=1)
        found, likelihood = expectation_maximisation(part, part_weight, part_starts, part_sizes, start)
        gained = likelihood - PENALTY * (size - 1) * np.log(total[at] + 1) / 2
        better = gained > best[at]
        best_shares[at[better]], best[at[better]] = found[better], gained[better]
        if size >= TRIED_SIZES:
            if not better.any():
                break
            rows = np.repeat(better, part_sizes)
            at, part, part_weight, part_sizes = at[better], part[rows], part_weight[rows], part_sizes[better]
            part_starts = np.append(0, np.cumsum(part_sizes)[:-1])
    shares[docs[starts]], likeliest[docs[starts]] = best_shares, alone[:, :-1].argmax(axis=1)
    return shares, likeliest, has_letter


def identify(texts: list[str], model: LanguageModel) -> list[list]:
    """``lang_pred score other_share lang_mix`` of each text; few texts at a time if there are many languages."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    chars = min(BATCH_CHARS, BATCH_LIKELIHOODS // len(model.probability))
    shares, likeliest, known = (np.concatenate(x) for x in zip(*[mixtures(texts[part], model) for part in text_slices(texts, chars=chars)], strict=True))
    own = np.column_stack([shares[:, :-1], np.zeros(len(texts))])
    pred = np.where(known, np.where(own.max(axis=1) > 0, own.argmax(axis=1), likeliest), len(model.languages))
    return [
        names[pred].tolist(),
        np.where(known, own.max(axis=1), 0.0).clip(0, 1).astype(float),
        np.where(known, shares[:, -1], 0.0).clip(0, 1).astype(float),
        [[{"lang": names[j], "share": float(row[j])} for j in np.flatnonzero(row[:-1] > 0)] for row in shares],
    ]


MIX = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))


def identify_languages(docs: DataFrame, model: LanguageModel, keep_text: bool = False) -> DataFrame:
    """Adds ``lang_pred score other_share lang_mix``.

    ``lang_pred`` is the learned language with the largest share of the document (the first
    by name on a tie) and ``score`` that share. Where the background alone explains a text
    best it is the likeliest language, with score 0; ``und`` and 0 for a text that is null or
    has no letter. ``other_share`` is the background's share, ``lang_mix`` the chosen set. Only
    the text decides; whole texts are read. Repeated rows get equal results; an input column
    named like an output, in any case of letters, is replaced, others stay (``text`` with ``keep_text``). An empty
    table gives an empty result; with nothing learned every row is ``und``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)  # languages x buckets floats
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("other_share", T.DoubleType()), T.StructField("lang_mix", MIX)]
    return map_texts(docs, fields, lambda texts: identify(texts, held.value), keep_text)
