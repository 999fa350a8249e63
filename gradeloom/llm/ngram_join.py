"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word n-grams, hashed. All n-grams have one order, rare ones first:
an n-gram occurs no more often than a count-min sketch of all n-grams says, nor than its
rarest word does by a sketch of all words, and the smaller of the two stands for it. Two sets
that are as alike as asked for share at least l n-grams among the first
``n - ceil(t * n) + l`` of each, for any l. Every document picks its own l: a longer prefix
meets more documents, but has to share more n-grams with each of them before their sets are
compared. It takes the l whose estimated cost, from the sketches' counts, is least. Which of a
pair's two documents decides is fixed by their sizes.

Equal sets form a class and are compared as one. To find the groups that links form without
making all pairs inside large ones, documents are first compared with one pivot of those
that share an n-gram with them; then only pairs whose documents are not in one group yet are
made, all of them, so that no link between groups is lost.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import Carried, arrow_batches, release_shuffles, text_slices
from gradeloom.llm.fingerprints import mix, run_hashes
from gradeloom.session import Scratch

#: Counters of the n-grams' sketch, by how many there are, and of the words'; counts are of all rows.
LEAST_BITS, MOST_BITS, WORD_BITS = 16, 22, 20
CHUNK = 1 << 16
#: The longest prefixes share so many n-grams.
MAX_MATCHES = 4
#: Rounds in which documents are compared with pivots only.
PIVOT_ROUNDS = 1
#: An n-gram's rows of one label are many from here on.
LARGE_LABEL = 64
#: An n-gram has many rows from here on: they meet by bands of sizes, which sends them three times instead of once.
CROWDED = 4096
#: Bits of the filter that tells which texts to read again for comparison, by how many there are.
LEAST_FILTER, MOST_FILTER = 18, 27
_HASH_BITS = 54
#: Bytes of each hash that a coded set holds as they are.
LOW_BYTES = 5
#: Ranks are logarithms to base 2, times this.
RANK_SCALE = 2000
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Likeness:
    """Sets of ``words``-word n-grams are linked from ``percent`` / 100 Jaccard similarity on."""

    words: int
    percent: int

    def __post_init__(self) -> None:
        if not (1 <= self.words < len(_ODD) and 1 <= self.percent <= 100):
            raise ValueError(f"1 to {len(_ODD) - 1} words, 1 to 100 percent: {self}")

    @property
    def band_width(self) -> float:
        """Linked sets' sizes differ by so much at most, as logarithms."""
        return max(-math.log(self.percent / 100) + 1e-9, 0.01)

    def needed(self, n: Column) -> Column:
        """ceil(percent * n / 100)"""
        return F.floor((n * self.percent + 99) / 100).cast("int")

    def overlap(self, left: int | Column, right: int | Column) -> int | Column:
        """How much two sets of these sizes share at least if they are linked."""
        total = (left + right) * self.percent + (99 + self.percent)
        return F.floor(total / (100 + self.percent)).cast("int") if isinstance(total, Column) else total // (100 + self.percent)

    def linked(self, shared: np.ndarray, together: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * together


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z in lower case, and how many each text has."""
    data = [text.encode("utf-8", "surrogatepass") for text in texts]
    flat = _lower[np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, data), np.int64, len(data)) + 1
    space = _space[flat]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    # Words and gaps alternate: hash all runs and keep the words.
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, stops
    words = run_hashes(mix(flat[starts[0] :].astype(np.uint64) + _ODD[0]), cuts - starts[0])[0::2]
    ends = np.cumsum(sizes)
    return words, np.diff(np.searchsorted(starts, np.append(1, ends + 1)))


def shingles(texts: list[str], words: int, word_rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, which text each belongs to, and the least ``word_rank`` of its words (0 without)."""
    return grams_of(*word_hashes(texts), words, word_rank)


def grams_of(hashes: np.ndarray, counts: np.ndarray, words: int, word_rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``shingles``, from the hashes of the words and how many each text has."""
    owner = np.repeat(np.arange(len(counts)), counts)
    rank = word_rank[word_slot(hashes)] if word_rank is not None else np.zeros(len(hashes), np.uint16)
    n = len(hashes)
    grams, of, least = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint16)
    if n >= words:
        total = np.zeros(n - words + 1, np.uint64)
        rarest = rank[: n - words + 1].copy()
        for j in range(words):
            total += hashes[j : n - words + 1 + j] * _ODD[j]
            np.minimum(rarest, rank[j : n - words + 1 + j], out=rarest)
        whole = owner[: n - words + 1] == owner[words - 1 :]
        grams, of, least = mix(total)[whole], owner[: n - words + 1][whole], rarest[whole]
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.append(0, np.cumsum(counts))
        extra = []
        for i in short.tolist():
            own = hashes[first[i] : first[i + 1]]
            extra.append((own * _ODD[: len(own)]).sum(dtype=np.uint64) ^ np.uint64(len(own) * int(_ODD[7]) % (1 << 64)))
        grams, of = np.append(grams, mix(np.array(extra, np.uint64))), np.append(of, short)
        least = np.append(least, np.array([rank[first[i] : first[i + 1]].min() for i in short.tolist()], np.uint16))
    return grams >> np.uint64(64 - _HASH_BITS), of, least


def distinct_shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's set, sorted by hash, one after the other, and the sets' sizes; up to 1024 texts."""
    grams, of, _ = shingles(texts, words)
    keys = np.sort((of.astype(np.uint64) << np.uint64(_HASH_BITS)) | grams)
    if len(keys):
        keys = keys[np.append(True, keys[1:] != keys[:-1])]
    return keys & np.uint64((1 << _HASH_BITS) - 1), np.bincount((keys >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=len(texts))


def ranked_shingles(texts: list[str], words: int, ranks: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``distinct_shingles``, and each n-gram's place in the order of all: the smaller of the two sketches' ranks."""
    grams, of, least = shingles(texts, words, ranks[1 << bits :])
    keys = (of.astype(np.uint64) << np.uint64(_HASH_BITS)) | grams
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    grams = keys[new] & np.uint64((1 << _HASH_BITS) - 1)
    rank = np.minimum(ranks[gram_slot(grams, bits)], least[order][new])
    return grams, np.bincount((keys[new] >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=len(texts)), rank


def code_set(grams: np.ndarray) -> bytes:
    """A sorted set in six bytes for each n-gram: how many, the low five bytes of each, then the steps of the bits above.

    A step is one byte, after a 255 for every 255 that it is larger; these are 64 at most in a set.
    """
    low = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES]
    steps = np.diff((grams >> np.uint64(8 * LOW_BYTES)).astype(np.int64), prepend=0)
    larger = steps // 255
    coded = np.full(len(steps) + int(larger.sum()), 255, np.uint8)
    coded[np.cumsum(larger + 1) - 1] = steps % 255
    return len(grams).to_bytes(4, "little") + low.tobytes() + coded.tobytes()


def decode_set(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    coded = np.frombuffer(data, np.uint8)[4:]
    grams = np.zeros((n, 8), np.uint8)
    grams[:, :LOW_BYTES] = coded[: n * LOW_BYTES].reshape(n, LOW_BYTES)
    steps = coded[n * LOW_BYTES :]
    return grams.view("<u8").ravel() | (np.cumsum(steps, dtype=np.uint64)[steps != 255] << np.uint64(8 * LOW_BYTES))


def class_ids(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    starts = np.append(0, np.cumsum(sizes))[:-1]
    sums = [np.where(sizes > 0, np.add.reduceat(np.append(mix(grams ^ salt), np.uint64(0)), starts), np.uint64(0)) for salt in _ODD[4:7]]
    first = mix(sums[0] + sizes.astype(np.uint64) * _ODD[3]) ^ sums[1]
    return first.astype(np.int64), mix(sums[2] ^ (sums[0] << np.uint64(1))).astype(np.int64)


def batches(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for part in text_slices(frame["text"].tolist()):
        yield frame.iloc[part]


def gram_slot(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams & np.uint64((1 << bits) - 1)).astype(np.int64)


def word_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(np.minimum(counts, (1 << 32) - 1).astype("<u4").tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def sketch_bits(texts: DataFrame) -> int:
    """Enough counters for about every second n-gram of the corpus to have its own, up to ``MOST_BITS``."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(chars / 12).bit_length()))


def rank_table(texts: DataFrame, words: int, bits: int) -> np.ndarray:
    """How often each slot's n-grams, and then each slot's words, occur: on a fine logarithmic scale of 16 bits.

    Every text is counted. Each task counts into sketches of fixed size, and sixteen of them
    are added at a time; the driver gets the ranks only.
    """
    size = (1 << bits) + (1 << WORD_BITS)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        counts = np.zeros(size, np.uint32)
        for frame in frames:
            for part in batches(frame):
                hashes, n_words = word_hashes(part["text"].tolist())
                np.add.at(counts, gram_slot(grams_of(hashes, n_words, words)[0], bits), 1)
                np.add.at(counts, word_slot(hashes) + (1 << bits), 1)
        for at in range(0, size, CHUNK):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "chunk": [at // CHUNK], "counts": [pack_counts(counts[at : at + CHUNK])]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack_counts(x) for x in group["counts"])
        return pd.DataFrame({"part": [group["part"].iloc[0] // 16], "chunk": [group["chunk"].iloc[0]], "counts": [pack_counts(total)]})

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack_counts(x) for x in group["counts"])
        ranks = np.floor(np.log2(1.0 + total) * RANK_SCALE).astype("<u2")
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "ranks": [zlib.compress(ranks.tobytes(), 1)]})

    schema = "part int, chunk int, counts binary"
    counted = texts.mapInPandas(count, schema)
    tasks = texts.rdd.getNumPartitions()
    while tasks > 16:
        counted = counted.groupBy((F.col("part") / 16).cast("int").alias("_group"), "chunk").applyInPandas(lambda g: add(g), schema)
        tasks = -(-tasks // 16)
    ranked = counted.groupBy("chunk").applyInPandas(lambda g: rank(g), "chunk int, ranks binary")
    out = np.zeros(size, np.uint16)
    for row in ranked.collect():  # the one table, in chunks
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(bytes(row["ranks"])), "<u2")
    return out


def best_matches(rank: np.ndarray, size: int, usual: float, like: Likeness) -> int:
    """The number of shared n-grams to ask for, by estimated cost: rows met, and sets to compare.

    A partner of the same size stands for all: it shares the first of them by then.
    """
    base = size - like.overlap(size, size) + 1
    most = min(MAX_MATCHES, size - base + 1, len(rank) - base + 1)
    if most <= 1:
        return 1
    met = np.cumsum(np.maximum(np.exp2(rank[: base + most - 1] / RANK_SCALE) - usual, 0.0) + 1e-3)
    return 1 + int(np.argmin([met[base + m - 2] * (1 + size / (256 * m)) for m in range(1, most + 1)]))


def prefix_frames(frames: Iterator[pd.DataFrame], ranks: np.ndarray, bits: int, usual: float, like: Likeness) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in batches(frame):
            grams, sizes, rank = ranked_shingles(part["text"].tolist(), like.words, ranks, bits)
            n_docs = len(part)
            owner = np.repeat(np.arange(n_docs), sizes)
            starts = np.append(0, np.cumsum(sizes))
            of_class, check = class_ids(grams, sizes)
            order = np.lexsort((grams, rank, owner))
            grams, rank = grams[order], rank[order]
            tokens, need = [], np.zeros(n_docs, np.int32)
            for i in range(n_docs):
                size, at = int(sizes[i]), int(starts[i])
                base = size - (like.percent * size + 99) // 100 + 1
                longest = min(size, base + MAX_MATCHES - 1)
                tokens.append(grams[at : at + longest].astype(np.int64) if size else np.empty(0, np.int64))
                if size:
                    need[i] = best_matches(rank[at : at + longest], size, usual, like)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "size": sizes, "class_id": of_class, "check": check, "need": need, "tokens": tokens})


def set_frames(frames: Iterator[pd.DataFrame], held: np.ndarray, words: int) -> Iterator[pd.DataFrame]:
    """Sets of the texts whose key the filter holds."""
    for frame in frames:
        bit = frame["key"].to_numpy().astype(np.int64) & (8 * len(held) - 1)
        chosen = frame[(held[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        for part in batches(chosen):
            grams, sizes = distinct_shingles(part["text"].tolist(), words)
            ends = np.cumsum(sizes)
            class_key, check = class_ids(grams, sizes)
            yield pd.DataFrame({"key": part["key"].to_numpy(), "class_key": class_key, "check": check, "grams": [code_set(grams[b - n : b]) for b, n in zip(ends, sizes, strict=True)]})


def verify_frames(frames: Iterator[pd.DataFrame], like: Likeness) -> Iterator[pd.DataFrame]:
    for frame in frames:
        lefts = [decode_set(x) for x in frame["left_grams"]]
        rights = [decode_set(x) for x in frame["right_grams"]]
        sizes = np.array([[len(a), len(b)] for a, b in zip(lefts, rights, strict=True)]).reshape(-1, 2).sum(axis=1)
        shared = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(lefts, rights, strict=True)], np.int64)
        yield frame.loc[like.linked(shared, sizes - shared), ["left", "right"]]


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A filter for ``key`` with eight bits or more for each, up to a fixed size; more keys only let more rows pass."""
    bits = min(MOST_FILTER, max(LEAST_FILTER, (8 * keys.count()).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    held = np.zeros(1 << (bits - 3), np.uint8)
    for row in keys.groupBy((bit / 32768).cast("int").alias("chunk")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits")).collect():
        held[row["chunk"] * 4096 : (row["chunk"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return held


def link_pairs(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, like: Likeness, scratch: Scratch, turn: int) -> DataFrame:
    """Those of the candidate pairs (``left right``, class ids) whose sets are alike enough.

    The texts of the classes' first documents are read again; a filter keeps most others out.
    """
    spark = pairs.sparkSession
    ids = pairs.select(F.col("left").alias("class_id")).unionByName(pairs.select(F.col("right").alias("class_id"))).distinct()
    involved = scratch.write(ids.join(nodes.select("class_id", "class_key", "check", F.xxhash64("first_doc").alias("key")), "class_id"), f"compared-{turn}")
    held = spark.sparkContext.broadcast(bit_filter(involved))  # 2 ** MOST_FILTER bits at most
    words = like.words
    read = texts.filter(F.col("doc_id").isNotNull()).withColumn("key", F.xxhash64("doc_id")).select("key", "text").mapInPandas(lambda frames: set_frames(frames, held.value, words), "key long, class_key long, check long, grams binary")
    with arrow_batches(spark):
        sets = scratch.write(read.join(involved, ["key", "class_key", "check"]).select("class_id", "grams"), f"sets-{turn}")
    if not sets.groupBy("class_id").count().filter("count > 1").isEmpty():  # rows that share id and text
        sets = scratch.write(sets.dropDuplicates(["class_id"]), f"single-sets-{turn}")
    joined = pairs.join(sets.select(F.col("class_id").alias("left"), F.col("grams").alias("left_grams")), "left").join(sets.select(F.col("class_id").alias("right"), F.col("grams").alias("right_grams")), "right")
    with arrow_batches(spark, 64):  # rows of two sets
        links = scratch.write(joined.select("left", "right", "left_grams", "right_grams").mapInPandas(lambda frames: verify_frames(frames, like), "left long, right long"), f"links-{turn}")
    held.destroy()
    scratch.drop(f"compared-{turn}", f"sets-{turn}", f"single-sets-{turn}")
    return links


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``class_id label``: the smallest class id of each one's component, for classes with links.

    Large stars and small stars in turn until nothing changes: every class points to the
    smallest neighbour, first those above it, then those below. Edges live in tables; the
    driver sees only their number and check sum.
    """
    name = f"edges-{uuid.uuid4().hex}"
    edges = scratch.write(links.select(F.greatest("left", "right").alias("up"), F.least("left", "right").alias("down")).filter("up != down").distinct(), name)
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("up", "down"))).first()
        if now == state or not now[0]:
            break
        state, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("down").alias("up"), F.col("up").alias("down")))
        least = both.groupBy("up").agg(F.min("down").alias("least")).withColumn("least", F.least("up", "least"))
        large = both.filter("down > up").join(least, "up").select(F.col("down").alias("up"), F.col("least").alias("down")).filter("up != down").distinct()
        large = scratch.write(large, f"{name}-large-{turn}")
        lowest = large.groupBy("up").agg(F.min("down").alias("least"))
        small = large.join(lowest, "up").select(F.greatest("down", "least").alias("up"), F.least("down", "least").alias("down"))
        edges = scratch.write(small.unionByName(lowest.select("up", F.col("least").alias("down"))).filter("up != down").distinct(), f"{name}-small-{turn}")
        scratch.drop(f"{name}-large-{turn}", f"{name}-small-{turn - 1}" if turn > 1 else name)
    return edges.groupBy(F.col("up").alias("class_id")).agg(F.min("down").alias("label"))


def labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return shared.withColumn("label", F.col("class_id"))
    return shared.join(labels, "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))


def mixed_tokens(rows: DataFrame) -> DataFrame:
    """Tokens that rows of more than one label hold."""
    return rows.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("token")


def pivot_pairs(rows: DataFrame, like: Likeness, turn: int) -> DataFrame:
    """Each class with the pivot of its n-grams, among sets of about its size.

    First that is the one that holds the n-gram earliest in its order, and so has the fewest
    rare n-grams of its own: the middle of a group of near copies. Then it is the first by hash.
    In the first round (0) each class is a group of its own.
    """
    width = like.band_width
    columns = ["class_id", "size"] if turn == 0 else ["class_id", "size", "label"]
    banded = rows.select("token", F.floor(F.log("size") / width + turn / 2).cast("int").alias("band"), "pos", *columns)
    # Class ids are digests themselves, so of several rows at one place the first has no meaning.
    order = F.col("pos") if turn == 0 else F.xxhash64(F.lit(turn), "class_id")
    pivots = banded.groupBy("token", "band").agg(F.min(F.struct(order.alias("order"), *columns)).alias("pivot"))
    apart = F.col("class_id") != F.col("pivot.class_id") if turn == 0 else F.col("label") != F.col("pivot.label")
    met = banded.drop("pos").join(pivots, ["token", "band"]).filter(apart & (F.least("size", "pivot.size") * 100 >= F.greatest("size", "pivot.size") * like.percent))
    counted = met.groupBy(F.col("class_id").alias("left"), F.col("pivot.class_id").alias("right")).agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return counted.filter((F.col("n") >= 2) | (F.col("size") <= 8)).select("left", "right")


def _met(a: DataFrame, b: DataFrame, keys: list[str], like: Likeness, once: bool, banded: bool = False) -> DataFrame:
    """Rows of ``a`` and ``b`` that share an n-gram early enough, as ``left right need``.

    Left is the larger set. If a pair shares ``overlap`` n-grams, the first ``need`` of them
    stand no later than ``size - overlap + need - 1`` in either. Where an n-gram has many rows
    they meet by bands of sizes, since sets of one pair are no more than one band apart; fewer
    rows are not worth sending to several bands. With ``once``, ``a`` and ``b`` are the same
    rows, and of two of them the one behind looks for the one ahead.
    """
    columns = [c for c in a.columns if c not in keys]
    if banded:
        band = F.floor(F.log("size") / like.band_width).cast("int")
        a, b = a.withColumn("band", band), b.withColumn("band", F.explode(F.array(*([band, band - 1] if once else [band - 1, band, band + 1]))))
        keys = [*keys, "band"]
    # Columns get their names after the join: so the same rows are shuffled once for both sides.
    same = reduce(and_, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    joined = a.alias("a").join(b.alias("b"), same).select("a.*", *[F.col(f"b.{c}").alias(f"b_{c}") for c in columns])
    ahead = F.struct("size", "class_id") > F.struct(F.col("b_size"), F.col("b_class_id"))
    need = F.when(ahead, F.col("need")).otherwise(F.col("b_need"))
    shared = like.overlap(F.col("size"), F.col("b_size"))
    fits = (F.least("size", "b_size") * 100 >= F.greatest("size", "b_size") * like.percent) & (F.col("pos") < F.col("size") - shared + need) & (F.col("b_pos") < F.col("b_size") - shared + need)
    apart = F.col("label") != F.col("b_label") if "label" in columns else F.lit(True)
    found = joined.filter(fits & apart & (~ahead if once else F.lit(True)))
    left, right = F.when(ahead, F.col("class_id")).otherwise(F.col("b_class_id")), F.when(ahead, F.col("b_class_id")).otherwise(F.col("class_id"))
    return found.select(left.alias("left"), right.alias("right"), need.alias("need"))


def remaining_pairs(rows: DataFrame, like: Likeness, scratch: Scratch) -> DataFrame:
    """All pairs across labels that share as many early n-grams as the larger set asks for.

    Where many rows of one label hold an n-gram, labels meet first and then their rows, so
    that the rows of one label do not meet each other.
    """
    rows = rows.select("token", "label", "class_id", "size", "need", "pos")
    large = scratch.write(rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE_LABEL).select("token", "label"), "large-labels")
    light = rows.join(large, ["token", "label"], "left_anti")
    crowded = scratch.write(light.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("token"), "crowded-tokens")
    if crowded.isEmpty():
        met = _met(light, light, ["token"], like, once=True)
    else:
        many, few = light.join(crowded, "token", "left_semi"), light.join(crowded, "token", "left_anti")
        met = _met(few, few, ["token"], like, once=True).unionByName(_met(many, many, ["token"], like, once=True, banded=True))
    if not large.isEmpty():
        heavy = rows.join(large, ["token", "label"], "left_semi")
        meets = large.join(large.withColumnRenamed("label", "other"), "token").filter("label < other")
        first = heavy.join(meets, ["token", "label"]).drop("label")
        second = heavy.join(meets.select("token", F.col("label").alias("_label"), F.col("other").alias("label")), ["token", "label"]).select("token", F.col("label").alias("other"), "class_id", "size", "need", "pos", F.col("_label"))
        met = met.unionByName(_met(heavy, light.join(large.select("token"), "token", "left_semi"), ["token"], like, once=False, banded=True))
        met = met.unionByName(_met(first, second.drop("_label").distinct(), ["token", "other"], like, once=False, banded=True))
    return met.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need").select("left", "right")


def with_class_ids(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``class_id``: equal for equal sets, by 128 bits of digest, and for no others.

    It is the first 64 bits unless two sets that differ in the other 64 share them; those get
    new numbers until no two share one.
    """
    numbered, turn = prefixes.withColumn("class_id", F.col("class_key")), 0
    while True:
        sets = numbered.groupBy("class_id").agg(F.min(F.struct("class_key", "check")).alias("a"), F.max(F.struct("class_key", "check")).alias("b"))
        shared = scratch.write(sets.filter("a != b").select(F.col("class_id").alias("shared_id")), f"shared-ids-{turn}")
        if shared.isEmpty():
            return numbered
        turn += 1
        joined = numbered.join(shared, F.col("class_id") == F.col("shared_id"), "left")
        numbered = joined.withColumn("class_id", F.when(F.col("shared_id").isNull(), F.col("class_id")).otherwise(F.xxhash64(F.lit(turn), "class_key", "check"))).drop("shared_id")


def jaccard_components(docs: DataFrame, like: Likeness) -> DataFrame:
    """One row for each document: ``doc_id n_shingles component_id``.

    Words are runs without ASCII white space, with A-Z in lower case; a text with fewer words
    than an n-gram has is one n-gram of all of them. Two documents link when ``100 * shared >=
    percent * together``; ``component_id`` is the smallest ``doc_id`` that links reach. A null
    or empty text, or one of white space, has no n-grams and links with nothing, not with its
    like either. Rows that share a ``doc_id`` are judged by their own texts; a row with a null
    ``doc_id`` is returned, with a null component, and links with nothing. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    held = Carried(docs, ["doc_id", "text"], []).df
    texts = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = sketch_bits(texts)
    with arrow_batches(spark):
        table = rank_table(texts.select("text"), like.words, bits)
    usual = float(np.exp2(np.median(table[: 1 << bits]) / RANK_SCALE))
    ranks = spark.sparkContext.broadcast(table)  # 2 ** MOST_BITS + 2 ** WORD_BITS numbers of 16 bits at most
    del table
    # The id travels as text: pandas would round large numbers next to nulls.
    sent = texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = sent.mapInPandas(lambda frames: prefix_frames(frames, ranks.value, bits, usual, like), "doc_id string, size long, class_id long, check long, need int, tokens array<long>")
    found = found.withColumnRenamed("class_id", "class_key").withColumn("doc_id", F.col("doc_id").cast("long"))
    with arrow_batches(spark):
        prefixes = scratch.write(found.withColumn("row_no", F.monotonically_increasing_id()), "prefixes")
    prefixes = with_class_ids(prefixes, scratch)
    ranks.destroy()
    usable = prefixes.filter((F.col("size") > 0) & F.col("doc_id").isNotNull())
    # One row stands for a class; copies never meet by their class, however many there are.
    numbered = F.struct("doc_id", "row_no", "class_key", "check")
    nodes = usable.groupBy("class_id").agg(F.min(numbered).alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.write(nodes.select("class_id", "copies", F.col("first.doc_id").alias("first_doc"), "first.row_no", "first.class_key", "first.check"), "classes")
    members = scratch.write(prefixes.select("doc_id", F.col("size").alias("n_shingles"), "class_id"), "members")
    single = scratch.write(prefixes.join(nodes.select("row_no"), "row_no", "left_semi").select("row_no", "class_id", "size", "need", "tokens"), "single-prefixes")
    # From here on the prefixes of copies are needed no more.
    scratch.drop("prefixes")
    release_shuffles(spark)
    base = F.col("size") - like.needed(F.col("size")) + 1
    # Most n-grams stand in one row: they are shuffled with its number alone, what else belongs to a row joins those that are shared.
    rows = single.select("row_no", base.cast("int").alias("base"), F.posexplode("tokens").alias("pos", "token"))
    rows = rows.filter(F.col("pos") < F.col("base") + MAX_MATCHES - 1).select("token", "row_no", "pos")
    about = single.select("row_no", "class_id", F.col("size").cast("int").alias("size"), "need")
    common = scratch.write(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("token"), "shared-tokens")
    release_shuffles(spark)  # counting tokens shuffles as much as what comes next
    shared = rows.join(common, "token", "left_semi").join(about, "row_no").select("token", "class_id", "size", "need", "pos")
    shared = scratch.write(shared, "shared-rows")
    scratch.drop("single-prefixes", "shared-tokens")
    release_shuffles(spark)
    links, labels = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        grouped = labelled(shared, labels)
        # At first each class is a group of its own, so all shared n-grams are in several groups.
        open_ = grouped if labels is None else scratch.write(grouped.join(mixed_tokens(grouped), "token", "left_semi"), f"open-rows-{turn}")
        made = pivot_pairs(open_, like, turn) if turn < PIVOT_ROUNDS else remaining_pairs(open_, like, scratch)
        new = link_pairs(scratch.write(made, f"candidates-{turn}"), texts, nodes, like, scratch, turn)
        links = new if links is None else links.unionByName(new)
        labels = scratch.write(connected(links, scratch), f"labels-{turn}")
        scratch.drop(f"open-rows-{turn}", f"candidates-{turn}")
        release_shuffles(spark)
    scratch.drop("shared-rows")
    grouped = nodes.join(labels, "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    smallest = grouped.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    return _with_components(members, grouped, smallest, scratch)


def _with_components(members: DataFrame, grouped: DataFrame, smallest: DataFrame, scratch: Scratch) -> DataFrame:
    """Only classes whose component is not their own document's id go into the last join, which splits hot classes."""
    moved = grouped.join(smallest, "label").filter((F.col("copies") > 1) | (F.col("component_id") != F.col("first_doc"))).select("class_id", "component_id")
    joined = members.join(scratch.write(moved, "moved"), "class_id", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", "n_shingles", F.coalesce(own, F.col("doc_id")).alias("component_id"))
