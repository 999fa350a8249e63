"""Encoders against the libraries; packing against its own rules."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.llm import sentencepieces
from gradeloom.llm.bpe import MergeTable, encode_words, merge_one_by_one
from gradeloom.llm.packing import Places, WordEncoder, pack_documents, packing_patterns
from gradeloom.llm.sentencepieces import PieceCodec, encode_and_decode, with_digests
from gradeloom.llm.vocabularies import vocabulary

PIECES, WORDS = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "\n\n\t\r", "é中文😀ﬁ½", "▁ ▁▁x", "a" * 300, " " * 77 + "x" + " " * 33, "ab" * 200, "<s></s><0x0A><unk>", "for(i=0; i<n;\r\n\t ++i)", "\x00\x01", "don't IT'S 12.5!!? ²½ ΑΣ İx É.", "a<|endoftext|>b <|x", ".,.,'s a. b,"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab ▁\n\t\réé中😀the ing.;{}"), max_size=60))
def test_pieces_equal_the_library(text):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = PieceCodec.of(PIECES).encode([text])
    assert ids[0].tolist() == lib.encode(text)
    assert PieceCodec.of(PIECES).decode(ids) == [lib.decode(lib.encode(text))]


def test_odd_texts_equal_the_libraries(library):
    from tokenizers import Tokenizer

    ids = PieceCodec.of(PIECES).encode(ODD)
    assert [x.tolist() for x in ids] == library.encode(ODD)
    assert PieceCodec.of(PIECES).decode(ids) == library.decode(library.encode(ODD))
    own = WordEncoder.of(WORDS).encode(ODD)
    tokenizer = Tokenizer.from_file(WORDS)
    assert [np.frombuffer(x, np.uint32).tolist() for x in own] == [tokenizer.encode(x, add_special_tokens=False).ids for x in ODD]


def test_words_are_remembered_up_to_a_bound(monkeypatch, library):
    monkeypatch.setattr(sentencepieces, "KEPT_BYTES", 700)
    codec = PieceCodec(PIECES)
    for text in ("one two three", "four five six", "one two seven"):
        assert codec.encode([text])[0].tolist() == library.encode(text)
        assert len(codec.known.new) + len(codec.known.old) <= 6


def test_latin_parts_equal_the_tokenizers_pattern():
    """The quick patterns for texts up to U+024F, with every such character next to letters, digits and signs."""
    encoder = WordEncoder.of(WORDS)
    for char in [*map(chr, range(0x250)), *"\u2010\u2019\u2028\u2029\u20ac"]:
        text = f"ab{char}cd {char}{char}1{char}2 -{char}- a'll{char}'s _{char}_"
        text = text.lower() if char != "\u03a3" else text
        assert encoder.split(text) == encoder.parts_of(text), ascii(char)


def test_rounds_equal_single_merges():
    rng = random.Random(5)
    for _ in range(200):
        symbols, pairs, new = list(range(4)), {}, 4
        while new < 14:
            pair = (rng.choice(symbols), rng.choice(symbols))
            if pair not in pairs:
                pairs[pair] = (rng.randint(0, 12), new)  # ranks in any order, with ties
                symbols.append(new)
                new += 1
        words = [[rng.randint(0, 3) for _ in range(rng.randint(0, 14))] for _ in range(20)]
        flat, counts = encode_words(np.array([x for w in words for x in w], np.int64), np.array([len(w) for w in words]), MergeTable(pairs))
        got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
        assert got == [merge_one_by_one(list(w), pairs) for w in words]


def test_encode_operator_edges(spark, library):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "x"), (None, "", "x"), (3, "word " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = with_digests(encode_and_decode(df, PIECES))
    assert out.columns == ["doc_id", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 5 and got[2]["n_tokens"] == 0 == got[None]["n_tokens"]
    for i, text in ((1, rows[0][1]), (3, rows[4][1]), (2, "")):
        ids = library.encode(text)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_and_decode(df.limit(0), PIECES).count() == 0


def test_patterns_fill_and_place_every_piece():
    rng = random.Random(2)
    histogram = Counter(rng.choice([1, 2, 3, 20, 33, 60, rng.randint(1, 70)]) for _ in range(5000))
    patterns = packing_patterns(histogram, 100)
    used = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 100 and list(pattern) == sorted(pattern, reverse=True)
        used.update({length: n * count for length, n in Counter(pattern).items()})
    assert used == histogram
    total = sum(length * n for length, n in histogram.items())
    assert sum(n for _, n in patterns) <= 1.03 * total / 100 + 1
    places, rows = Places(patterns), []
    for length, n in histogram.items():
        rows += zip(*(x.tolist() for x in places.find(np.full(n, length), np.arange(n))), [length] * n, strict=True)
    at = {}
    for sequence, offset, length in sorted(rows):
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "x"), (4, "word other " * 40), (5, "a b c d e f g h i j k l m n o"), (6, "same length here"), (7, "also three words")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, length string")
    got = pack_documents(df, WORDS, size=16).collect()
    docs = Counter()
    for r in got:
        assert 0 < r["length"] <= 16
        ids = tokenizer.encode(dict(texts)[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and len(ids) == r["doc_tokens"]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        docs[r["doc_id"]] += r["length"]
    for i in {i for i, _ in texts}:
        assert docs[i] == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for j, t in texts if j == i)
    at = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
    assert max(at.values()) <= 16
    assert sorted(at) == list(range(len(at)))
    assert pack_documents(df.limit(0), WORDS).count() == 0


def test_every_control_and_space_equals_the_library():
    """Python's white space and the tokenizer's differ in U+001C to U+001F."""
    from tokenizers import Tokenizer

    signs = [*map(chr, range(0xA1)), *"\u1680\u180e\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"]
    texts = [form.format(x) for x in signs for form in ("a{0}b", "{0}", " {0} a{0}{0} 1", "\x1c{0}é \x1f")]
    tokenizer = Tokenizer.from_file(WORDS)
    own = WordEncoder(WORDS).encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in own] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_every_code_point_between_letters_has_the_librarys_ids():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(WORDS), WordEncoder.of(WORDS)
    points = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}B {chr(c)}{chr(c)}1" for c in points]
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    own = [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(texts)]
    assert not [hex(c) for c, x, y in zip(points, own, found, strict=True) if x != y.ids]
    mixed = ["plain text", "a\u0558B", "Écu 中 text"]
    assert [np.frombuffer(x, np.uint32).tolist() for x in encoder.encode(mixed)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in mixed]


@pytest.mark.parametrize("name", ["sf0.001"])
def test_ids_of_the_whole_table_equal_the_libraries(spark, library, name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    texts = [row["text"] for row in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("text").collect()]
    assert [x.tolist() for x in PieceCodec.of(PIECES).encode(texts)] == library.encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in WordEncoder.of(WORDS).encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
