"""Packing documents into sequences: shortest-pack-first over the length histogram.

Every document is tokenised and cut into pieces: full ones as long as a sequence, each
of which is a sequence of its own, and a rest. Only the histogram of the rests' lengths,
with at most ``size`` rows, goes to the driver. There the lengths are placed longest
first, each into the shortest packs, those with the most room, so many
at a time as the histogram has; what comes out is a list of patterns with counts. The
pieces then find their place in the patterns by their rank among the pieces of the same
length. Ranks are made in two steps (within small groups, then over the groups' counts),
so a length that very many pieces share is not sorted in one task.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradeloom.llm.bpe import MergeTable, encode_words, sliced
from gradeloom.llm.common import Carried, Remembered, arrow_batches, text_slices
from gradeloom.session import materialize

#: Pieces of one length that are ranked by one sort.
RANK_GROUP = 50_000
#: Bytes of parts and their ids that a worker remembers.
KEPT_BYTES = 64 << 20
#: The tokenizer's split, as this module reads it for texts up to U+024F: letters
#: (Python's letters and digits without digits and these numbers), one digit, or signs.
LATIN_NUMBERS = "\xb2\xb3\xb9\xbc\xbd\xbe"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPLIT = rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
_ascii_parts = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
_latin_parts = re.compile(rf"{CONTRACTIONS}|[^\W\d_{LATIN_NUMBERS}]+|[\d{LATIN_NUMBERS}]|(?:[^\w\t-\r \x85\xa0\u2028\u2029]|_)+").findall
_beyond_latin = re.compile("[^\0-\u024f\u2010-\u2029\u20ac]").search
_encoders: dict[str, WordEncoder] = {}


@functools.cache
def _unassigned():
    """Finds code points that Python's tables do not know: the tokenizer's tables may be newer."""
    known = np.fromiter((unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)), bool, 0x110000)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], known, [True]]).astype(np.int8)))
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist()) + "]").search


def byte_letters() -> list[str]:
    """Byte-level BPE writes byte b as the b-th letter: itself if it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class WordEncoder:
    """Token ids of a text as the tokenizers library gives them, each distinct part merged once.

    The tokenizer's own split cuts a text into parts (words of letters, digits, runs of signs)
    and drops white space; no merge crosses a part's ends, so a text's ids are those of its
    parts in order. Normalisation (NFC, lower case), the split and the merges are those of the
    vocabulary file; special tokens in a text are found as the library finds them. Texts with code
    points that Python's tables do not have go to the library whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, byte_level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or split["pattern"]["Regex"] != SPLIT or byte_level["add_prefix_space"] or model["continuing_subword_prefix"]:
            raise ValueError("only lower-casing byte-level BPE with word ends is supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.parts_of = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {x["content"]: np.array([x["id"]], np.uint32).tobytes() for x in spec["added_tokens"]}
        self.special_of = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.table = MergeTable(pairs)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        self.known = Remembered(KEPT_BYTES)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def split(self, text: str) -> list[str]:
        """The text's parts, in lower case."""
        if text.isascii():
            return _ascii_parts(text.lower())
        if _beyond_latin(text) is None:  # such a text is in NFC
            return _latin_parts(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.parts_of("".join([x.lower() for x in text]) if "\u03a3" in text else text.lower())  # no final sigma

    def _learn(self, parts: list[str]) -> None:
        data = [part.encode("utf-8", "surrogatepass") for part in parts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols, ends = self.inner[flat], np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        merged, counts = encode_words(symbols, lengths, self.table)
        self.known.learn(parts, sliced(merged.astype(np.uint32), counts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        odd = [bool(_beyond_latin(text) and _unassigned()(text)) for text in texts]
        if any(odd):
            rest = iter(self.encode([text for text, x in zip(texts, odd, strict=True) if not x]))
            return [np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes() if x else next(rest) for text, x in zip(texts, odd, strict=True)]
        # Special tokens are parts of their own, at every second place.
        cut = [self.special_of.split(text) if "<|" in text else [text] for text in texts]
        split = [self.split(x) for pieces in cut for x in pieces[::2]]
        missing = self.known.missing(set().union(*split))
        if missing:
            self._learn(missing)
        known = self.known.new
        encoded = iter([b"".join([known[part] for part in parts]) for parts in split])
        out = [next(encoded) + b"".join([self.special[x] + next(encoded) for x in pieces[1::2]]) for pieces in cut]
        self.known.settle()
        return out


def cut_pieces(frames: Iterator[pd.DataFrame], path: str, size: int, end_id: int) -> Iterator[pd.DataFrame]:
    end = np.array([end_id], np.uint32).tobytes()
    encoder = WordEncoder.of(path)
    for frame in frames:
        texts, rows = frame["text"].tolist(), []
        encoded = (ids for part in text_slices(texts) for ids in encoder.encode(texts[part]))
        for doc_id, row_key, ids in zip(frame["doc_id"], frame["row_key"], encoded, strict=True):
            ids += end
            tokens = len(ids) // 4
            for start in range(0, tokens, size):
                piece = ids[4 * start : 4 * (start + size)]
                rows.append((doc_id, row_key, start, len(piece) // 4, zlib.crc32(piece), tokens))
        yield pd.DataFrame(rows, columns=["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens"])
    encoder.known = Remembered(KEPT_BYTES)  # the worker may have other things to do next


def packing_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in the order of their places) and how many sequences follow each.

    Lengths go longest first, each piece to the shortest pack there is: a length takes the open
    patterns with the most room, as many pieces as there are sequences of them. Where not even
    those hold one, new sequences are opened.
    """
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if room == 0:
            closed.append((pattern, count))
        else:
            if room not in open_at:
                bisect.insort(rooms, room)
                open_at[room] = []
            open_at[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:  # nothing holds it: fill new sequences one after the other
                each = size // length
                if left >= each:
                    put((length,) * each, left // each, size - each * length)
                if left % each:
                    put((length,) * (left % each), 1, size - left % each * length)
                break
            room = rooms[-1]
            pattern, count = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop()
            used = min(left, count)
            if used < count:
                put(pattern, count - used, room)
            put((*pattern, length), used, room - length)
            left -= used
    return closed + [x for patterns in open_at.values() for x in patterns]


class Places:
    """Where the piece of a given length and rank lies, as sorted arrays."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows, taken, sequence = [], Counter(), 0
        for pattern, count in patterns:
            offset = 0
            for length, times in Counter(pattern).items():  # as ordered, longest first
                rows.append((length, taken[length], times, sequence, offset))
                taken[length] += times * count
                offset += times * length
            sequence += count
        rows.sort()
        self.length, self.first, self.times, self.sequence, self.offset = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [()] * 5))
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A length's rows are in order of their first rank, so one key orders all rows."""
        shift = int(self.first.max(initial=0)) + int(rank.max(initial=0)) + 1
        row = np.searchsorted(self.length * shift + self.first, length * shift + rank, side="right") - 1
        within = rank - self.first[row]
        return self.sequence[row] + within // self.times[row], self.offset[row] + within % self.times[row] * length


def ranked(pieces: DataFrame, n_pieces: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of one length."""
    groups = max(1, -(-n_pieces // RANK_GROUP))
    pieces = pieces.withColumn("rank_group", F.pmod(F.xxhash64("doc_id", "row_key", "start"), F.lit(groups)))
    counts = pieces.groupBy("length", "rank_group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("rank_group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "rank_group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    within = Window.partitionBy("length", "rank_group").orderBy("doc_id", "row_key", "start")
    local = pieces.withColumn("local_rank", F.row_number().over(within) - 1)
    return local.join(firsts, ["length", "rank_group"]).withColumn("rank", F.col("first_rank") + F.col("local_rank"))


def pack_documents(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """One row for each piece: ``doc_id start length ids_crc32 doc_tokens sequence_id offset``.

    A document is its ids (null text: none) and ``end_id``; it is cut every ``size`` ids. No
    sequence exceeds ``size``, and pieces lie in one without a gap from offset 0. Repeated
    rows are packed each for itself, and so are rows with a null ``doc_id``. Texts of any
    length are taken whole. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    # The id travels as text: pandas would round large numbers next to nulls.
    texts = Carried(docs, ["doc_id", "text"], []).df.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("text"))
    cut = texts.mapInPandas(lambda frames: cut_pieces(frames, path, size, end_id), "doc_id string, row_key long, start long, length long, ids_crc32 long, doc_tokens long")
    with arrow_batches(spark):
        pieces = materialize(cut, "pieces")
    rests = pieces.filter(F.col("length") < size)
    histogram = {row["length"]: row["count"] for row in rests.groupBy("length").count().collect()}  # size rows at most
    places = Places(packing_patterns(histogram, size))
    held = spark.sparkContext.broadcast(places)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = held.value.find(frame["length"].to_numpy(), frame["rank"].to_numpy())
            yield frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=sequence, offset=offset)

    columns = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = ranked(rests, sum(histogram.values())).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(place, columns)
    full = pieces.filter(F.col("length") == size)
    n_full = full.count()
    numbered = ranked(full, n_full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + places.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(numbered).withColumn("doc_id", F.col("doc_id").cast("long"))
