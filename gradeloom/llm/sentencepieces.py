"""SentencePiece encoding and decoding with byte fallback, as the library gives it.

The model file is read here: pieces, scores and the settings that matter. Words (a run of
spaces and what follows it) are encoded once each in vectorised merge rounds.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.bpe import MergeTable, encode_words, sliced
from gradeloom.llm.common import Remembered, map_texts, with_outputs
from gradeloom.session import ship_package

SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bytes of words and their ids that a worker remembers.
KEPT_BYTES = 128 << 20
_codecs: dict[str, PieceCodec] = {}


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceCodec:
    """Encoder and decoder of one byte-pair model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(proto_fields(file.read()))
        self.pieces: list[str] = []
        scores, types = [], []
        trainer: dict = {}
        norm: dict = {}
        for number, value in fields:
            if number == 1:
                piece = dict(proto_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(proto_fields(value))
            elif number == 3:
                norm = dict(proto_fields(value))
        plain = norm.get(1, b"identity") == b"identity" and not norm.get(2) and norm.get(3, 1) and not norm.get(4, 1) and norm.get(5, 1)
        if trainer.get(3) != 2 or not plain or not {NORMAL, UNKNOWN, CONTROL, BYTE}.issuperset(types) or types.count(BYTE) != 256:
            raise ValueError("only byte-pair models with byte fallback and no normalisation are supported")
        self._build(scores, types)

    def _build(self, scores: list[float], types: list[int]) -> None:
        ids = {p: i for i, (p, kind) in enumerate(zip(self.pieces, types, strict=True)) if kind == NORMAL}
        self.unknown = types.index(UNKNOWN)
        self.byte_ids = np.array([i for _, i in sorted((int(p[3:5], 16), i) for i, p in enumerate(self.pieces) if types[i] == BYTE)])
        #: Symbols from here on stand for characters without a piece.
        self.strange = len(self.pieces)
        chars = sorted({c for p in ids for c in p})
        self.char_symbol = {c: ids.get(c, self.strange + ord(c)) for c in chars}
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        symbol = ids | {c: s for c, s in self.char_symbol.items() if c not in ids}
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (ranks[scores[i]], i)
        self.table = MergeTable(pairs)
        self.code_points = np.array([ord(c) for c in chars], np.int64)
        self.code_symbols = np.array([self.char_symbol[c] for c in chars], np.int64)
        splits = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids)
        line = "" if "\n" in chars else "\n"
        gap = f"[ {SPACE}]"
        self.words_of = re.compile(f"{line or '(?!)'}|{gap}*[^ {SPACE}{line}]+|{gap}+" if splits else "(?s).+").findall
        surface = [b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, kind in zip(self.pieces, types, strict=True)]
        surface[self.unknown] = " ⁇ ".encode()
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_at = np.append(0, np.cumsum(self.surface_size))[:-1]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.starts_with_space = np.array([p.startswith(SPACE) for p in self.pieces])
        self.known = Remembered(KEPT_BYTES)

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        if path not in _codecs:
            _codecs[path] = cls(path)
        return _codecs[path]

    def _learn(self, words: list[str]) -> None:
        flat = "".join(words).replace(" ", SPACE)
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.code_points, codes), len(self.code_points) - 1)
        symbols = np.where(self.code_points[at] == codes, self.code_symbols[at], self.strange + codes)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, counts = encode_words(symbols, lengths, self.table)
        strange = flat >= self.strange
        if strange.any():
            codes = flat[strange] - self.strange
            sizes = np.ones(len(flat), np.int64)
            sizes[strange] = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(np.repeat(owner, sizes), minlength=len(counts))
            flat, strange = np.repeat(flat, sizes), np.repeat(strange, sizes)
            data = "".join(map(chr, codes.tolist())).encode("utf-8", "surrogatepass")
            flat[strange] = self.byte_ids[np.frombuffer(data, np.uint8)]
        self.known.learn(words, sliced(flat.astype(np.int32), counts))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words_of(" " + text) if text else [] for text in texts]
        missing = self.known.missing(set().union(*split))
        if missing:
            self._learn(missing)
        known = self.known.new
        out = [np.frombuffer(b"".join([known[word] for word in words]), np.int32) for words in split]
        self.known.settle()
        return out

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """All rows at once: the pieces' bytes are gathered from one array."""
        ids = np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int64)
        sizes = self.surface_size[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.surface_at[ids] - ends + sizes, sizes)
        data = self.surface[at].tobytes()
        stops = np.append(0, ends)[np.cumsum([0, *map(len, rows)])].tolist()
        out = []
        for row, start, stop in zip(rows, stops, stops[1:], strict=False):
            start += int(len(row) > 0 and self.starts_with_space[row[0]])  # the prefix that encoding adds
            out.append(data[start:stop].decode("utf-8", "replace"))
        return out


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` (array of int) and ``decoded`` (their text) to the documents.

    ``ids`` are the library's ids of the whole text, without begin or end ids; a null or
    empty text has none and decodes to an empty text. ``text`` itself is not returned.
    Repeated rows come out as often as they came; an input column named ``ids`` or
    ``decoded`` is replaced, others stay. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def results(texts: list[str]) -> list:
        codec = PieceCodec.of(path)
        ids = codec.encode(texts)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids]))), codec.decode(ids)]

    return map_texts(docs, fields, results)


def with_digests(encoded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return with_outputs(
        encoded,
        {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(joined.cast("binary"), 256), "decoded_sha256": F.sha2(F.encode("decoded", "UTF-8"), 256)},
    )
