"""Token ids as files: each document compressed for itself with one shared dictionary.

``write_token_files`` encodes whole texts and writes three Parquet tables into a folder, in
ascending order of ``doc_id``:

* ``dictionary``: one row, a zstandard dictionary trained on serialised ids of a bounded sample
  of documents, its sha256 and the width of an id in bytes;
* ``blocks``: consecutive documents in one binary cell, one zstandard frame for each document,
  beside it the documents' ids, the end of each frame and the number of tokens in each (the
  offset index), the dictionary's hash, and how many tokens of this part lie before;
* ``parts``: how many tokens lie before each part.

A short document is read by its block's index and one frame; the other frames are not
decompressed, and Spark skips blocks by their first and last id. Only Spark reads and writes
the folder, so it may be in any store, and a lost executor costs the tasks that it ran.

The texts are encoded and compressed where they are read. Only compressed frames are dealt by
ranges of ``doc_id``, so a range of equal ids can be split further and no text is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Carried, arrow_batches, batch_slices
from gradeloom.session import Scratch, ship_package

#: Documents that the dictionary is trained on, about, and bytes of each that are used. The result does not depend on them.
SAMPLE_DOCS, SAMPLE_BYTES = 1_000, 8_192
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: A block is closed beyond so many bytes, or at so many documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 19, 1_024
#: Frames of one part, about.
PART_BYTES = 64 << 20
#: What a worker remembers of chunks: bytes, with what an entry takes beside its own; longer chunks are not kept.
KEPT_BYTES, ENTRY_BYTES, LONG_CHUNK = 96 << 20, 190, 200
#: The split that the vocabulary file names (byte-level, with its own pattern), and Unicode's white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = "\t\n\x0b\x0c\r\x85\xa0                　"
_encoders: dict[str, ChunkEncoder] = {}


def byte_letters() -> list[str]:
    """Byte-level vocabularies write byte b as the b-th letter: itself if it can be seen, else one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = itertools.count(256)
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class _Known(dict):
    """Ids of chunks (after ``before``) as bytes; encodes those it meets for the first time."""

    def __init__(self, before: str, encode, limit: int):
        self.before, self.encode, self.limit, self.held, self.old = before, encode, limit // 2, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.encode(self.before + chunk)
        if len(chunk) <= LONG_CHUNK:
            self[chunk] = ids
            self.held += len(chunk) + len(ids) + ENTRY_BYTES
        return ids

    def settle(self) -> None:
        """Between texts: when one half is full, the older half goes."""
        if self.held > self.limit:
            self.old, self.held = dict(self), 0
            self.clear()


class ChunkEncoder:
    """Ids of a text as the tokenizers library gives them (``add_special_tokens=False``).

    A text is cut before each space that follows another character than white space. No token of the
    byte-level split passes such a place, so the parts can be encoded by themselves, and each
    different one is encoded once. Texts with a special token in them go to the library whole.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        self.library = Tokenizer.from_file(path)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.vocabulary = 1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.type = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        byte_of = {x: b for b, x in enumerate(byte_letters())}
        # Bytes that are no letters of the vocabulary belong to special tokens.
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in self.special}
        merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
        plain = spec["normalizer"] is None and split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        if not plain or merged != sorted(merged):
            raise ValueError("only byte-level BPE without normalisation, its ids in the order of its merges, is supported")
        merge = tiktoken.Encoding("chunks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def encode(chunk: str) -> bytes:
            return np.array(merge(chunk), self.type).tobytes()

        self.whole, self.spaced = _Known("", encode, KEPT_BYTES // 8), _Known(" ", encode, KEPT_BYTES)
        blank = f" {BLANKS}"
        self.chunks_of = regex.compile(f" ?[^{blank}]+|[{blank}]+(?![^{blank}])|[{blank}]").findall
        self.before_space = [f"{x} " for x in blank]

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str) -> bytes:
        """Little-endian ids of two bytes, or four for a vocabulary of more than 65,536."""
        if any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        if any(x in text for x in self.before_space):
            ids = b"".join(map(self.whole.__getitem__, self.chunks_of(text)))
        else:
            first, *others = text.split(" ")
            ids = self.whole[first] + b"".join(map(self.spaced.__getitem__, others))
        self.whole.settle()
        self.spaced.settle()
        return ids


def _rows_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for own in batch_slices(batch, column):
            yield own, own.column(column).to_pylist()


def train_dictionary(docs: DataFrame, path: str, end_id: int, n_docs: int) -> bytes:
    """A zstandard dictionary for serialised ids; empty where the sample is too small to train one.

    The sample has ``SAMPLE_DOCS`` documents, about, chosen by a hash of their places, so that
    repeated rows count as often as they come; at most twice as many, and ``SAMPLE_BYTES`` of each.
    """
    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    chosen = docs.filter(F.pmod(F.xxhash64("row_no"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(path)
        end = np.array([end_id], encoder.type).tobytes()
        for _, texts in _rows_of(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([(encoder.encode(x) + end)[:SAMPLE_BYTES] for x in texts], pa.binary())], names=["ids"])

    sample = [bytes(row["ids"]) for row in chosen.mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, sample)) // 8), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = None
    if dictionary:
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False, write_checksum=False)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


BLOCK_SCHEMA = "part int, block int, dictionary_sha256 string, id_bytes int, first_doc long, last_doc long, start long, n_tokens long, doc_ids array<long>, ends array<long>, tokens array<long>, frames binary"


def _pack(frames: Iterator[pa.RecordBatch], digest: str, id_bytes: int, block_docs: int) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive frames; ``start`` counts this part's tokens."""
    from pyspark import TaskContext

    part, block, start = TaskContext.get().partitionId(), 0, 0
    ids: list[int | None] = []
    tokens: list[int] = []
    held: list[bytes] = []
    size = 0
    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()), ("id_bytes", pa.int32()), *[(x, pa.int64()) for x in ("first_doc", "last_doc", "start", "n_tokens")], *[(x, pa.list_(pa.int64())) for x in ("doc_ids", "ends", "tokens")], ("frames", pa.binary())])

    def closed() -> pa.RecordBatch:
        ends = np.cumsum([len(x) for x in held], dtype=np.int64)
        first = next((x for x in ids if x is not None), None)  # null ids come first, and can't be asked for
        row = [part, block, digest, id_bytes, first, ids[-1], start, sum(tokens), ids, ends.tolist(), tokens, b"".join(held)]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    for batch in frames:
        for doc_id, n, frame in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "n_tokens", "frame")), strict=True):
            ids.append(doc_id)
            tokens.append(n)
            held.append(frame)
            size += len(frame)
            if size > BLOCK_BYTES or len(ids) == block_docs:
                yield closed()
                block, start = block + 1, start + sum(tokens)
                ids, tokens, held, size = [], [], [], 0
    if ids:
        yield closed()


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, block_docs: int = BLOCK_DOCS) -> None:
    """Encode whole texts (null: empty), end each with ``end_id`` and write them to ``folder``.

    ``path`` is the vocabulary file. Documents come in ascending ``doc_id``, null ids first;
    rows with one id in the order of a hash of their text, each as a document of its own.
    A block has at most ``block_docs`` of them. Other columns are ignored. An empty table gives files without a block.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "token-frames")
    texts = Carried(docs, ["doc_id", "text"], []).df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumns({"text_hash": F.xxhash64("text"), "row_no": F.monotonically_increasing_id()})
    with arrow_batches(spark):
        dictionary = train_dictionary(keyed, path, end_id, docs.count())
        digest = hashlib.sha256(dictionary).hexdigest()

        def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, pressed = ChunkEncoder.of(path), _compressor(dictionary).compress
            end = np.array([end_id], encoder.type).tobytes()
            for own, texts in _rows_of(batches, "text"):
                rows = [encoder.encode(x) + end for x in texts]
                counts = [len(x) // encoder.type.itemsize for x in rows]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("text_hash"), own.column("row_no"), pa.array(counts, pa.int64()), pa.array([pressed(x) for x in rows], pa.binary())], names=["doc_id", "text_hash", "row_no", "n_tokens", "frame"])

        framed = scratch.write(keyed.mapInArrow(compress, "doc_id long, text_hash long, row_no long, n_tokens long, frame binary"), "frames")
    encoder = ChunkEncoder.of(path)
    id_bytes = encoder.type.itemsize
    size = framed.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("row_no")]
    dealt = framed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    dealt.mapInArrow(lambda frames: _pack(frames, digest, id_bytes, block_docs), BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    scratch.drop("frames")
    # One row for each part.
    own = spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    own.select("part", F.coalesce(before, F.lit(0)).alias("tokens_before")).coalesce(1).write.parquet(f"{folder}/parts")
    kept = [(digest, id_bytes, base64.b64encode(dictionary).decode())]
    spark.createDataFrame(kept, "dictionary_sha256 string, id_bytes int, data string").withColumn("data", F.unbase64("data")).coalesce(1).write.parquet(f"{folder}/dictionary")


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    """Blocks with their true start, and the dictionary."""
    ship_package(spark)
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["data"])
    if hashlib.sha256(dictionary).hexdigest() != row["dictionary_sha256"]:
        raise ValueError("the dictionary is not the one that the files were written with")
    # Parts are Spark tasks of one write: a few numbers for each of them.
    blocks = spark.read.parquet(f"{folder}/blocks").join(F.broadcast(spark.read.parquet(f"{folder}/parts")), "part")
    return blocks.withColumn("start", F.col("start") + F.col("tokens_before")), dictionary


def _frames(batches: Iterator[pa.RecordBatch], dictionary: bytes, wanted: set[int] | None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start, ids) of each document, or of those that are wanted."""
    digest, unpack = hashlib.sha256(dictionary).hexdigest(), _decompressor(dictionary).decompress
    for batch in batches:
        for i in range(batch.num_rows):
            own, id_bytes, start, doc_ids, ends, tokens, frames = (batch.column(x)[i] for x in ("dictionary_sha256", "id_bytes", "start", "doc_ids", "ends", "tokens", "frames"))
            if own.as_py() != digest:
                raise ValueError(f"a block was written with dictionary {own.as_py()}, not {digest}")
            data, kind, at, first = memoryview(frames.as_buffer()), np.dtype(f"<u{id_bytes.as_py()}"), start.as_py(), 0
            for doc_id, end, n in zip(doc_ids.as_py(), ends.as_py(), tokens.as_py(), strict=True):
                if wanted is None or doc_id in wanted:
                    yield doc_id, at, np.frombuffer(unpack(data[first:end]), kind)
                first, at = end, at + n


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id start ids`` of all documents, or of the given ids only: their blocks and frames alone are read.

    ``start`` is the number of tokens of all documents before. An id that is not there gives no row.
    """
    blocks, dictionary = _read(spark, folder)
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        given = F.array(*[F.lit(x).cast("long") for x in sorted(wanted)])
        inside = F.exists(given, lambda x: (F.col("first_doc") <= x) & (F.col("last_doc") >= x)) if wanted else F.lit(False)
        # The second condition is for the scan, which skips by least and greatest values.
        blocks = blocks.filter(inside).filter((F.col("last_doc") >= min(wanted, default=0)) & (F.col("first_doc") <= max(wanted, default=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, start, ids in _frames(batches, dictionary, wanted):
            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([start], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids array<int>")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id start n_tokens ids_crc32`` of every document, from its own ids as they are read back.

    ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers.
    """
    blocks, dictionary = _read(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, start, ids in _frames(batches, dictionary, None):
                yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))

        found = rows()
        while part := list(itertools.islice(found, 4_096)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
