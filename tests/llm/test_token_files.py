"""Token files: ids against the library, round trips, single documents."""

import random
import zlib

import numpy as np
import pytest

from gradeloom.llm import token_files as files
from gradeloom.llm.queries import op13_token_files
from gradeloom.llm.vocabularies import vocabulary
from tests.oracle import SMALL

PATH = vocabulary("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_of_odd_texts_equal_the_library(library):
    rng = random.Random(1)
    letters = [*"ab'st .,1²½éß\x00\x1c\x1d\x1f\x85\xa0\n\n\r\t ᠎ ​ 　﻿  中😀ǅʼ", "<|endoftext|>", "'s", "'ll", "  ", "\n \n"]
    encoder = files.ChunkEncoder.of(PATH)
    texts = ["".join(rng.choices(letters, k=rng.randrange(25))) for _ in range(4_000)] + ["a" * 3_000, " " * 99, "x" + " " * 99]
    assert [np.frombuffer(encoder.encode(x), encoder.type).tolist() + [0] for x in texts] == [ids_of(library, x) for x in texts]


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    encoder = files.ChunkEncoder.of(PATH)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)} {chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}z" for c in points]
    found = library.encode_batch(texts, add_special_tokens=False)
    assert not [hex(c) for c, x, y in zip(points, texts, found, strict=True) if np.frombuffer(encoder.encode(x), encoder.type).tolist() != y.ids]


def test_chunks_are_remembered_up_to_a_bound():
    known = files._Known(" ", lambda x: x.encode(), 4 * (files.ENTRY_BYTES + 8))
    for i in range(50):
        assert known[f"w{i}"] == f" w{i}".encode() and known["common"] == b" common"
        known.settle()
        assert len(known) + len(known.old) <= 8
    long = "y" * (files.LONG_CHUNK + 1)
    assert known[long] and long not in known


def expected(library, rows):
    """By id, null first; (doc_id, start, n_tokens, crc32)."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = ids_of(library, text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_the_library_on_the_whole_table(spark, library):
    rows = [tuple(x) for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_token_files(spark, SMALL).collect())) == expected(library, rows)


def test_blocks_single_documents_and_nulls(spark, library, tmp_path):
    rows = [(i * 3, f"document {i} " * (i % 9) + "\n\n é") for i in range(60)] + [(None, "no id"), (200, None), (201, ""), (202, "long " * 60_000)]
    spark.createDataFrame([(*x, "y") for x in rows], f"{SCHEMA}, Frames string").repartition(4).write.parquet(f"{tmp_path}/in")
    files.write_token_files(spark.read.parquet(f"{tmp_path}/in"), PATH, f"{tmp_path}/out", block_docs=5)
    back = files.read_checksums(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, back.collect()), key=lambda x: x[1]) == expected(library, rows)
    texts = dict(rows)
    some = files.read_documents(spark, f"{tmp_path}/out", [9, 201, 202, 77])
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: ids_of(library, texts[i]) for i in (9, 201, 202)}
    assert files.read_documents(spark, f"{tmp_path}/out").count() == len(rows)
    assert files.read_documents(spark, f"{tmp_path}/out", []).count() == 0
    blocks = spark.read.parquet(f"{tmp_path}/out/blocks")
    assert blocks.count() >= 12 and blocks.select("dictionary_sha256").distinct().count() == 1


def test_rows_that_share_an_id(spark, library, tmp_path):
    rows = [(5, "same")] * 40 + [(5, None), (4, "x"), (6, "y z")]
    files.write_token_files(spark.createDataFrame(rows, SCHEMA), PATH, f"{tmp_path}/out")
    back = sorted(map(tuple, files.read_checksums(spark, f"{tmp_path}/out").collect()), key=lambda x: x[1])
    assert len(back) == 43 and [x[1] for x in back] == np.cumsum([0, *(x[2] for x in back[:-1])]).tolist()
    whole = expected(library, rows)
    assert sorted((x[0], x[2], x[3]) for x in back) == sorted((x[0], x[2], x[3]) for x in whole)


def test_empty_table_and_a_wrong_dictionary(spark, tmp_path):
    files.write_token_files(spark.createDataFrame([], SCHEMA), PATH, f"{tmp_path}/none")
    assert files.read_checksums(spark, f"{tmp_path}/none").count() == 0
    files.write_token_files(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), PATH, f"{tmp_path}/two")
    spark.createDataFrame([("0" * 64, 2, bytearray(b"x"))], "dictionary_sha256 string, id_bytes int, data binary").write.parquet(f"{tmp_path}/two/dictionary", mode="overwrite")
    with pytest.raises(ValueError, match="dictionary"):
        files.read_checksums(spark, f"{tmp_path}/two")
