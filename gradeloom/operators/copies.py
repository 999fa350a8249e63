"""Copies among answers in C: what two students' programs share beyond what everybody's do.

A program becomes a stream of tokens in which all names are one token, all numbers one and all
literals one, so renaming changes nothing. Every ``k`` tokens in a row are hashed, and of each
``window`` hashes in a row the least is kept (winnowing): two programs that share ``k + window - 1``
tokens in a row share a fingerprint, wherever the stretch stands, so functions may change places.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.text import C_FRACTION, C_KEYWORDS, C_PARTS, C_TOKENS, without_comments
from gradeloom.session import materialize, ship_package

#: String and character literals come before all other tokens.
LITERAL = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
#: Bits of a fingerprint that come from the hash's hexadecimal digits.
DIGITS = 15
#: What a token can be once names, numbers and literals are equal; a literal is a quotation mark.
KINDS = [b"v", b"0", *(x.encode() for x in [*C_KEYWORDS, *string.punctuation.replace("_", "")])]
_NAME, _NUMBER, _BLANK = 0, 1, 255
#: The kind of a token that begins with a byte, unless it is a keyword.
_BYTES = np.full(256, _BLANK, np.uint8)
_BYTES[list((string.ascii_letters + "_").encode())], _BYTES[list(string.digits.encode())] = _NAME, _NUMBER
_BYTES[[x[0] for x in KINDS[2 + len(C_KEYWORDS) :]]] = range(2 + len(C_KEYWORDS), len(KINDS))
#: Keywords, of eight letters at most, as numbers in order, and their kinds.
_KEYWORDS, _KEYWORD_KINDS = map(np.array, zip(*sorted((np.uint64(int.from_bytes(x.encode(), "little")), np.uint8(2 + i)) for i, x in enumerate(C_KEYWORDS)), strict=True))
_PARTS, _LITERAL, _FRACTION, _POINT = (re.compile(x.encode()) for x in (C_PARTS, LITERAL, C_FRACTION, r"[0-9]\.[0-9]"))
#: Bytes of text whose tokens a task holds at a time, but for a single longer text.
AT_ONCE = 1 << 22


def c_token_stream(text: Column) -> Column:
    """Tokens without comments; names are ``v``, numbers ``0``, literals ``"``; keywords and signs stay.

    ``fingerprints`` reads the same tokens in batches, many times faster and with literals of any length.
    """
    tokens = F.regexp_extract_all(without_comments(text), F.lit(f"{LITERAL}|{C_TOKENS}"), F.lit(0))

    def plain(token: Column) -> Column:
        first = F.substring(token, 1, 1)
        literal = (F.length(token) > 1) & first.isin('"', "'")
        name = (first.between("a", "z") | first.between("A", "Z") | (first == "_")) & ~token.isin(C_KEYWORDS)
        return F.when(literal, F.lit('"')).when(name, F.lit("v")).when(first.between("0", "9"), F.lit("0")).otherwise(token)

    return F.transform(tokens, plain)


def _kinds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, as places in ``KINDS``, and where each text's begin (and the last one's end)."""
    clean = []
    for text in texts:
        if b"//" in text or b"/*" in text:
            text = b"".join([b" " if x.startswith((b"//", b"/*")) else x for x in _PARTS.findall(text)])
        if b'"' in text or b"'" in text:
            text = _LITERAL.sub(b'"', text)
        clean.append(_FRACTION.sub(b"0", text) if _POINT.search(text) else text)
    # A blank keeps neighbours apart, and eight at the end let every name be read as eight bytes.
    held = np.frombuffer(b" ".join([b"", *clean]) + b" " * 9, np.uint8)
    kind = _BYTES[held]
    name, digit = kind == _NAME, kind == _NUMBER
    word = name | digit
    begins = np.zeros(len(held), bool)
    begins[1:] = (kind[1:] != _BLANK) & ~(word[1:] & word[:-1])
    # Where digits begin a word, a name begins with its first letter.
    runs, letters = np.flatnonzero(digit[1:] & ~digit[:-1]) + 1, np.flatnonzero(name[1:] & digit[:-1]) + 1
    begins[letters] = begins[runs[np.searchsorted(runs, letters) - 1]]
    at = np.flatnonzero(begins)
    found = kind[at]
    names = np.flatnonzero(found == _NAME)
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    length = ends[np.searchsorted(ends, at[names], side="right")] - at[names]
    names, length = names[length <= 8], length[length <= 8]
    eight = np.zeros(len(names), np.uint64)
    for i in range(8):
        eight |= np.where(i < length, held[at[names] + i], 0).astype(np.uint64) << np.uint64(8 * i)
    place = np.minimum(np.searchsorted(_KEYWORDS, eight), len(_KEYWORDS) - 1)
    is_keyword = _KEYWORDS[place] == eight
    found[names[is_keyword]] = _KEYWORD_KINDS[place[is_keyword]]
    return found, np.searchsorted(at, np.cumsum([0, *(len(x) + 1 for x in clean)]))


def _hashes(kinds: np.ndarray, begins: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the leading digits of the MD5 of every ``k`` tokens' kinds, written with spaces between; equal runs are hashed once."""
    grams, size, width = kinds.astype(np.int64), len(KINDS), 1
    while width < k and width < len(kinds):
        if size > 2**31:
            listed = pa.array(grams).dictionary_encode()
            grams, size = listed.indices.to_numpy().astype(np.int64), len(listed.dictionary)
        step = min(width, k - width)
        grams, size, width = grams[:-step] * size + grams[step:], size * size, width + step
    # Runs that reach into the next text are none.
    counts = np.maximum(np.diff(begins) - (k - 1), 0)
    ends = np.cumsum(counts)
    at = np.arange(counts.sum()) + np.repeat(begins[:-1] - (ends - counts), counts)
    listed = pa.array(grams[at]).dictionary_encode()
    places = listed.indices.to_numpy()
    example = np.zeros(len(listed.dictionary), np.int64)
    example[places] = at
    written = (b" ".join([KINDS[x] for x in kinds[i : i + k]]) for i in example)
    values = np.array([int(hashlib.md5(x).hexdigest()[:DIGITS], 16) for x in written], np.int64)
    return np.split(values[places], ends[:-1])


def _winnowed(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """The last column's texts become their sets of fingerprints."""

    def least(hashes: np.ndarray) -> np.ndarray:
        # The least of ``width`` neighbours; an answer with fewer hashes than a window has their least one.
        width, whole = 1, min(window, len(hashes))
        while width < whole:
            step = min(width, whole - width)
            hashes, width = np.minimum(hashes[:-step], hashes[step:]), width + step
        return np.unique(hashes)

    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
        part = (np.cumsum(sizes) - sizes) // AT_ONCE
        sets = []
        for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(part)) + 1):
            kinds, begins = _kinds([texts[int(i)].as_py() or b"" for i in rows])
            sets += map(least, _hashes(kinds, begins, k) if len(rows) else [])
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], listed], names=[*batch.schema.names[:-1], "prints"])


def fingerprints(answers: DataFrame, key: str, text: str, k: int, window: int, within: list[str]) -> DataFrame:
    """``within key prints``: the set of each answer's fingerprints, sorted; empty for fewer than ``k`` tokens.

    The set of the least hashes of all windows is what winnowing keeps; an answer with fewer hashes
    than a window has their least one. Answers are read where they are, in Arrow batches and as bytes:
    no letter beyond ASCII is part of a token.
    """
    ship_package(answers.sparkSession)
    sent = answers.select(*within, key, F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField("prints", T.ArrayType(T.LongType()))])
    return sent.mapInArrow(lambda batches: _winnowed(batches, k, window), schema)


def copy_classes(answers: DataFrame, key: str, text: str, k: int = 10, window: int = 6, common: int = 10, within: list[str] | None = None) -> DataFrame:
    """``within key class_id n_prints n_common``: one row for each answer.

    Answers with the same fingerprints (more than none) are one class, named by its smallest
    key; an answer without any is a class by itself. A fingerprint is common if more than
    ``common`` classes of the same ``within`` hold it: so many don't copy from each other, they share
    given code, or all of one source; ``n_common`` tells which answers hold much of it.
    """
    within = within or []
    members, rare = _classes(answers, key, text, k, window, common, within)
    counted = rare.groupBy("class_key").agg(F.count(F.lit(1)).alias("n_rare"))
    named = members.join(counted, "class_key", "left")
    n_prints = F.col("n_prints").cast("bigint")
    # What is not rare is common; answers without a group have nothing in common.
    n_common = F.when(_all_known(within), n_prints - F.coalesce("n_rare", F.lit(0))).otherwise(F.lit(0))
    return named.select(*within, key, F.coalesce("class_id", key).alias("class_id"), n_prints.alias("n_prints"), n_common.alias("n_common"))


def copy_pairs(
    answers: DataFrame, key: str, text: str, k: int = 10, window: int = 6, common: int = 10, min_shared: int = 4, min_share: float = 0.5, within: list[str] | None = None
) -> DataFrame:
    """``within class_a class_b prints_a prints_b shared share``: classes that share fingerprints which are not common.

    ``prints_a`` and ``prints_b`` count what is not common, ``share`` is ``shared`` over the smaller of
    them; pairs with ``min_shared`` and ``min_share`` at least come out. Classes are those of
    ``copy_classes``, so many exact copies are one row, not all their pairs. A fingerprint that is
    not common stands in ``common`` classes at most and gives so many pairs for each of them: work
    grows with the number of fingerprints, and no step compares all answers. Null ``within`` and
    texts take no part.
    """
    within = within or []
    _, rare = _classes(answers, key, text, k, window, common, within)
    sizes = rare.groupBy("class_key").agg(F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    # As many classes as ``common`` at most in a list.
    held = rare.groupBy(*within, "print").agg(F.array_sort(F.collect_list(F.struct("class_id", "class_key"))).alias("classes")).filter(F.size("classes") > 1)
    first = held.select(*within, "classes", F.posexplode("classes").alias("at", "a"))
    pairs = first.select(*within, "a", F.explode(F.slice("classes", F.col("at") + 2, F.size("classes"))).alias("b"))
    shared = pairs.groupBy(*within, F.col("a.class_key").alias("key_a"), F.col("b.class_key").alias("key_b")).agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)
    for side in "ab":
        own = sizes.select(F.col("class_key").alias(f"key_{side}"), F.col("class_id").alias(f"class_{side}"), F.col("n").alias(f"prints_{side}"))
        shared = shared.join(own, f"key_{side}")
    share = F.col("shared") / F.least("prints_a", "prints_b")
    return shared.select(*within, "class_a", "class_b", "prints_a", "prints_b", "shared", share.alias("share")).filter(F.col("share") >= min_share)


def _listed(batches: Iterator[pa.RecordBatch], common: int, n_within: int) -> Iterator[pa.RecordBatch]:
    """The last column's sets become rows ``print n_held``, one for each set; but one in all, with their number, if more than ``common`` of those read at a time hold a fingerprint."""
    for batch in batches:
        sets = batch.column(batch.num_columns - 1)
        sizes = sets.value_lengths().to_numpy().astype(np.int64)
        part = (np.cumsum(sizes) - sizes) * 8 // AT_ONCE
        begins = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sets)]
        seen: dict[str, int] = {}
        groups = np.array([seen.setdefault(repr(x), len(seen)) for x in zip(*(x.to_pylist() for x in batch.columns[:n_within]), strict=True)], np.int64)
        for first, end in zip(begins, begins[1:], strict=False):
            prints, rows = sets.slice(first, end - first).flatten().to_numpy(), np.repeat(np.arange(first, end), sizes[first:end])
            places = pa.array(prints).dictionary_encode().indices.to_numpy()
            if n_within:
                places = pa.array(places * np.int64(len(seen)) + groups[rows]).dictionary_encode().indices.to_numpy()
            counts = np.bincount(places)
            example = np.zeros(len(counts), np.int64)
            example[places] = np.arange(len(places))
            many = counts > common
            kept = ~many[places]
            kept[example] = True
            n_held = np.where(many, counts, 1)[places[kept]]
            at = pa.array(rows[kept])
            yield pa.RecordBatch.from_arrays([*(x.take(at) for x in batch.columns[:-1]), pa.array(prints[kept]), pa.array(n_held)], names=[*batch.schema.names[:-1], "print", "n_held"])


def _all_known(columns: list[str]) -> Column:
    return reduce(and_, (F.col(x).isNotNull() for x in columns), F.lit(True))


def _classes(answers: DataFrame, key: str, text: str, k: int, window: int, common: int, within: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members with their class, and ``within class_key class_id print``: what is not common of each class's fingerprints."""
    made = fingerprints(answers, key, text, k, window, within)
    # 128 bits of the group and all fingerprints; answers without any have no class.
    whole = F.sha2(F.concat_ws(",", F.to_json(F.struct(*within)) if within else F.lit(""), F.array_join(F.col("prints").cast("array<string>"), ",")).cast("binary"), 256)
    keyed = made.withColumns({"n_prints": F.size("prints"), "class_key": F.when(F.size("prints") > 0, F.substring(whole, 1, 32))})
    members = materialize(keyed, "fingerprints")
    # All answers of a class have the same fingerprints.
    leaders = members.filter(F.col("class_key").isNotNull()).groupBy(*within, "class_key").agg(F.min(key).alias("class_id"), F.first("prints").alias("prints"))
    sent = leaders.filter(_all_known(within)).select(*within, "class_key", "class_id", "prints")
    schema = T.StructType([*sent.schema.fields[:-1], T.StructField("print", T.LongType()), T.StructField("n_held", T.LongType())])
    listed = sent.mapInArrow(lambda batches: _listed(batches, common, len(within)), schema)
    # What is common where it is listed comes as one row, so no task reads a row for each class that holds it.
    held = listed.withColumn("n_held", F.sum("n_held").over(Window.partitionBy(*within, "print")))
    rare = held.filter(F.col("n_held") <= common).drop("n_held")
    return members.select(*within, key, "n_prints", "class_key").join(leaders.select("class_key", "class_id"), "class_key", "left"), rare
