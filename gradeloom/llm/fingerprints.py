"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and long paragraphs after words that their own
hash picks, so that an edit changes only the digests around it. A sketch is a small table
of cells; a digest adds itself to one cell in each of three parts. The cells of two texts
are subtracted, and what differs is peeled off: a cell with one digest left gives it away,
which frees others. If the peeling sticks, the pair is sketched again in four times the
cells, until the table has room for all digests of both; a pair that sticks even then is
compared digest by digest. The digests recovered say how many the two texts share.

A text's fingerprint is the smallest sketch of it alone, tried in steps of a quarter, from
which all its digests can be peeled. So it depends on the text only, and two fingerprints are
enough for any pair: their digests are peeled off, sketched in tables of one size, subtracted
and peeled, as those of two texts are (``fingerprint_likeness``).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import BATCH_CHARS, Carried, arrow_batches
from gradeloom.session import Scratch

PARTS = 3
#: Cells in each part of a pair's first sketch; a retry has GROWTH times as many.
FIRST_CELLS, GROWTH = 4, 4
#: Bits of a digest. A cell of a fingerprint has a count of one byte and the digests' sum.
KEY_BITS = 32
CELL_BYTES = 1 + KEY_BITS // 8
#: One word in so many ends a piece of a long paragraph.
WORDS_PER_PIECE = 12
#: The first words of a text are pieces of their own, so that short texts have several.
OWN_WORDS = 16
#: A piece has so many words at most; a longer word than LONG_WORD is cut at one character in so many.
LONGEST_PIECE, LONG_WORD, CHARS_PER_PART = 48, 48, 16
#: Documents dealt to one task, about.
TASK_DOCS = 20_000
#: Beyond so many times the digests of both texts a table is not made larger.
MOST_ROOM = 8
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SALTS = np.cumsum(np.full(PARTS, _B, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), _A, np.uint64)), dtype=np.uint64)


def run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values, in order."""
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, sizes)
    return mix(np.add.reduceat(values * powers(int(sizes.max()))[place], starts) + sizes.astype(np.uint64) * _C)


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of all texts, in one array, and how many each text has.

    A word carries the white space that follows it, so a text's digests cover all of it. The
    nth copy of a piece in a text has a digest of its own.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    mixed = mix(codes.astype(np.uint64) + _A)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    begins = first | (~space & np.append(True, space[:-1]))
    starts = np.flatnonzero(begins)
    sizes_of = np.diff(np.append(starts, len(codes)))
    if sizes_of.max() > LONG_WORD:  # cut where the two characters before say so
        pair = mix(mixed[:-2] * _B + mixed[1:-1])
        picked = np.append([False, False], (pair >> np.uint64(40)) % np.uint64(CHARS_PER_PART) == 0)
        begins |= picked & np.repeat(sizes_of > LONG_WORD, sizes_of)
        starts = np.flatnonzero(begins)
    words = run_hashes(mixed, starts)
    line_end = np.logical_or.reduceat(codes == 10, starts)
    text_starts = np.flatnonzero(first[starts])
    in_text = np.arange(len(words)) - np.repeat(text_starts, np.diff(np.append(text_starts, len(words))))
    ends = line_end | ((words >> np.uint64(40)) % np.uint64(WORDS_PER_PIECE) == 0) | (in_text < OWN_WORDS)
    fresh = first[starts] | np.append(True, ends[:-1])
    piece_starts = np.flatnonzero(fresh)
    place = np.arange(len(words)) - np.repeat(piece_starts, np.diff(np.append(piece_starts, len(words))))
    piece_starts = np.flatnonzero(fresh | (place % LONGEST_PIECE == 0))
    pieces = run_hashes(words, piece_starts)
    owner = np.repeat(np.arange(len(texts)), sizes)[starts[piece_starts]]
    order = np.lexsort((pieces, owner))
    pieces, owner = pieces[order], owner[order]
    new = np.append(True, (pieces[1:] != pieces[:-1]) | (owner[1:] != owner[:-1]))
    copy = np.arange(len(pieces)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keys = mix(pieces + copy.astype(np.uint64) * _A) >> np.uint64(64 - KEY_BITS)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
    return keys[new], np.bincount(owner[new], minlength=len(texts))


def table_starts(cells: np.ndarray) -> np.ndarray:
    """Where each owner's cells begin in the flat table of all owners; ``cells`` are those of one part, by owner."""
    return PARTS * (np.cumsum(cells) - cells)


def cells_of(keys: np.ndarray, owner: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Where each key goes in the flat table: one place in each part."""
    own, start = cells[owner], table_starts(cells)[owner]
    return np.stack([(mix(keys + salt) % own.astype(np.uint64)).astype(np.int64) + p * own + start for p, salt in enumerate(_SALTS)])


def add_keys(table: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, owner: np.ndarray, sign: np.ndarray, cells: np.ndarray) -> None:
    counts, sums, checks = table
    factor = sign.astype(np.uint64)  # -1 wraps, as sums do
    for at in cells_of(keys, owner, cells):
        np.add.at(counts, at, sign)
        np.add.at(sums, at, keys * factor)
        np.add.at(checks, at, mix(keys + _C) * factor)


def empty_table(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = PARTS * int(cells.sum())
    return np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)


def peel(table: tuple[np.ndarray, np.ndarray, np.ndarray], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Take digests off the difference of sketches: on the left, on the right only, and whether all came off."""
    counts, sums, checks = table
    owners = len(cells)
    owner_of = np.repeat(np.arange(owners), PARTS * cells)
    left, right = np.zeros(owners, np.int64), np.zeros(owners, np.int64)
    at = np.flatnonzero(np.abs(counts) == 1)
    while len(at):
        sign = counts[at]
        keys = sums[at] * sign.astype(np.uint64)
        pure = (np.abs(sign) == 1) & (mix(keys + _C) == checks[at] * sign.astype(np.uint64))
        keys, sign, owner = keys[pure], sign[pure], owner_of[at[pure]]
        if not len(keys):
            break
        order = np.lexsort((keys, owner))
        keys, sign, owner = keys[order], sign[order], owner[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))
        keys, sign, owner = keys[new], sign[new], owner[new]
        left += np.bincount(owner[sign > 0], minlength=owners)
        right += np.bincount(owner[sign < 0], minlength=owners)
        add_keys(table, keys, owner, -sign, cells)
        at = np.unique(cells_of(keys, owner, cells))
        at = at[np.abs(counts[at]) == 1]
    clean = np.logical_and.reduceat((counts == 0) & (sums == 0) & (checks == 0), table_starts(cells))
    return left, right, clean


class SketchSet:
    """Digests of many texts, with the cells that any of them needs."""

    def __init__(self, texts: list[str]):
        self._hold(*digests(texts))

    def _hold(self, keys: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.sizes = keys, sizes
        self.at = np.append(0, np.cumsum(sizes))

    @classmethod
    def of_digests(cls, sets: list[np.ndarray]) -> SketchSet:
        """As of texts that have these digests."""
        held = cls([])
        held._hold(np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64))
        return held

    def gathered(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[texts]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[texts] - ends + sizes, sizes)
        return self.keys[places], np.repeat(np.arange(len(texts)), sizes)

    def packed(self) -> list[bytes]:
        """The digests of each text, a few bytes each."""
        keys = self.keys.astype("<u4")
        return [keys[start:end].tobytes() for start, end in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    def fingerprints(self) -> list[str]:
        return [base64.b64encode(x).decode() for x in self.peelable()]

    def peelable(self) -> list[bytes]:
        """The smallest sketch of each text that gives all its digests back: counts and sums of its cells."""
        found = [b""] * len(self.sizes)
        cells = self.sizes * 9 // 20 + 1
        open_ = np.arange(len(self.sizes))
        while len(open_):
            own = cells[open_]
            keys, owner = self.gathered(open_)
            table = empty_table(own)
            add_keys(table, keys, owner, np.ones(len(keys), np.int64), own)
            starts = table_starts(own)
            fits = np.maximum.reduceat(table[0], starts) < 256
            counts, sums = table[0].astype(np.uint8), table[1].astype("<u4")
            done = peel(table, own)[2] & fits
            for i in np.flatnonzero(done).tolist():
                at = slice(starts[i], starts[i] + PARTS * own[i])
                found[open_[i]] = counts[at].tobytes() + sums[at].tobytes()
            open_ = open_[~done]
            cells[open_] += cells[open_] // 4 + 1
        return found

    def differences(self, lefts: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many digests only the left and only the right text of each pair has."""
        size_l, size_r = self.sizes[lefts], self.sizes[rights]
        only_l, only_r = np.zeros(len(lefts), np.int64), np.zeros(len(lefts), np.int64)
        open_, cells = np.arange(len(lefts)), FIRST_CELLS
        while len(open_):
            full = PARTS * cells > MOST_ROOM * (size_l[open_] + size_r[open_]) + 64
            for at in open_[full].tolist():
                left, right = self.keys[self.at[lefts[at]] : self.at[lefts[at] + 1]], self.keys[self.at[rights[at]] : self.at[rights[at] + 1]]
                shared = len(np.intersect1d(left, right, assume_unique=True))
                only_l[at], only_r[at] = len(left) - shared, len(right) - shared
            open_ = open_[~full]
            # A difference in sizes that is larger than the table can't come off it.
            fits = np.abs(size_l[open_] - size_r[open_]) <= PARTS * cells
            now = open_[fits]
            if len(now):
                each = np.full(len(now), cells)
                table = empty_table(each)
                for texts, sign in ((lefts[now], 1), (rights[now], -1)):
                    keys, owner = self.gathered(texts)
                    add_keys(table, keys, owner, np.full(len(keys), sign, np.int64), each)
                left, right, clean = peel(table, each)
                only_l[now[clean]], only_r[now[clean]] = left[clean], right[clean]
                open_ = np.concatenate([open_[~fits], now[~clean]])
            cells *= GROWTH
        return only_l, only_r

    def likeness(self, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
        """Digests that each pair shares, over all that it has; 1 for two empty texts."""
        size_l, size_r = self.sizes[lefts], self.sizes[rights]
        only_l, only_r = self.differences(lefts, rights)
        return (size_l - only_l) / np.maximum(size_l + only_r, 1) + ((size_l + size_r) == 0)


def fingerprint_digests(fingerprint: str) -> np.ndarray:
    """All digests of a text, peeled off its fingerprint."""
    data = base64.b64decode(fingerprint)
    size, rest = divmod(len(data), CELL_BYTES)
    if rest or not size or size % PARTS:
        raise ValueError("not a fingerprint of this module")
    counts = np.frombuffer(data, np.uint8, size).copy()
    sums = np.frombuffer(data, "<u4", size, size).astype(np.uint32)
    cells = np.array([size // PARTS])
    found = [np.empty(0, np.uint32)]
    at = np.flatnonzero(counts == 1)
    while len(at):
        keys = np.unique(sums[at])
        found.append(keys)
        if sum(map(len, found)) > size:
            break  # more digests than cells never peel: the cells are not those of a text
        for places in cells_of(keys.astype(np.uint64), np.zeros(len(keys), np.int64), cells):
            np.subtract.at(counts, places, np.uint8(1))
            np.subtract.at(sums, places, keys)
        at = np.flatnonzero(counts == 1)
    if counts.any() or sums.any():
        raise ValueError("not a fingerprint of this module")
    return np.sort(np.concatenate(found)).astype(np.uint64)


def fingerprint_difference(left: str, right: str) -> tuple[int, int]:
    """How many digests only the left and only the right text has, from their fingerprints alone."""
    only_left, only_right = SketchSet.of_digests([fingerprint_digests(left), fingerprint_digests(right)]).differences(np.array([0]), np.array([1]))
    return int(only_left[0]), int(only_right[0])


def fingerprint_likeness(left: str, right: str) -> float:
    """Digests that two texts share, over all that they have, from their fingerprints alone."""
    return float(SketchSet.of_digests([fingerprint_digests(left), fingerprint_digests(right)]).likeness(np.array([0]), np.array([1]))[0])


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprint_rows(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    edited = [edited_text(a, b) for a, b in zip(texts, following, strict=True)]
    n = len(texts)
    # The next text is mostly the next row's; only others are digested besides.
    beyond = [i for i in range(n) if i + 1 == n or following[i] is not texts[i + 1]]
    sketches = SketchSet([*texts, *edited, *(following[i] for i in beyond)])
    next_at = np.arange(1, n + 1)
    next_at[beyond] = 2 * n + np.arange(len(beyond))
    own, changed = np.arange(n), np.arange(n, 2 * n)
    packed = sketches.packed()
    return pd.DataFrame(
        {
            "doc_id": ids,
            "n_chars": [len(x) for x in texts],
            "edited_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest() for x in edited],
            "own_digests": packed[:n],
            "edited_digests": packed[n : 2 * n],
            "near_edited": sketches.likeness(own, changed),
            "near_next": sketches.likeness(own, next_at),
        }
    )


def sketch_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order; each but the last is compared with the one after it.

    The first row's text, and the whole last row, are given back as well (``place`` first and
    last): the last one's next is the first of the partition that follows.
    """
    from pyspark import TaskContext

    held: tuple | None = None
    part = TaskContext.get().partitionId()

    def edge(place: str, row: tuple) -> pd.DataFrame:
        missing = dict.fromkeys(SKETCHED, [None])
        return pd.DataFrame(missing | {"doc_id": [row[0]], "n_chars": [len(row[1])], "part": [part], "place": [place], "text": [row[1]]})

    def inner(rows: list[tuple], following: list[str]) -> pd.DataFrame:
        return fingerprint_rows([x for x, _ in rows], [x for _, x in rows], following).assign(part=part, place="inner", text=None)

    for frame in frames:
        rows, following, chars = [], [], 0
        for row in zip(frame["doc_id"], frame["text"], strict=True):
            if held is None:
                yield edge("first", row)
            else:
                rows.append(held)
                following.append(row[1])
                chars += len(held[1])
                if chars > BATCH_CHARS:
                    yield inner(rows, following)
                    rows, following, chars = [], [], 0
            held = row
        if rows:
            yield inner(rows, following)
    if held is not None:
        yield edge("last", held)


def join_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield fingerprint_rows(frame["doc_id"].tolist(), frame["text"].tolist(), frame["following"].tolist())


def print_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The fingerprints, from the digests."""
    for frame in frames:
        for start in range(0, len(frame), PRINTED_ROWS):
            rows = frame.iloc[start : start + PRINTED_ROWS]
            sets = [np.frombuffer(x, "<u4").astype(np.uint64) for x in [*rows["own_digests"], *rows["edited_digests"]]]
            prints = SketchSet.of_digests(sets).fingerprints()
            yield rows.assign(fingerprint=prints[: len(rows)], edited_fingerprint=prints[len(rows) :])[PRINTED]


SKETCH_SCHEMA = "doc_id string, n_chars long, edited_sha256 binary, own_digests binary, edited_digests binary, near_edited double, near_next double"
SKETCHED = [field.split()[0] for field in SKETCH_SCHEMA.split(", ")]
PRINT_SCHEMA = "doc_id string, n_chars long, edited_sha256 binary, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
PRINTED = [field.split()[0] for field in PRINT_SCHEMA.split(", ")]
#: Rows whose fingerprints are made at once.
PRINTED_ROWS = 500


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: its sketch, that of its edited text, and how alike they are.

    Returns ``doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited
    near_next``. The next document is the next by ``doc_id`` (by a hash of the text, then by
    place in the table among equal ids; null ids before all others), the first after the last
    one, and itself in a table of one. A null text is an empty one; two empty texts have
    likeness 1. Other columns are ignored. An empty table gives an empty result. Both likenesses
    are those that ``fingerprint_likeness`` gives for the published strings.

    Documents are dealt by ranges of this order, so the text is shuffled once, and rows that
    share an id may lie in several ranges. A range's last document needs the next range's
    first: those two texts of each range are kept, and joined by the ranges' numbers. Only digests
    are written in between; the fingerprints are made from them in the caller's job.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    held = Carried(docs, ["doc_id", "text"], []).df
    texts = held.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash"), F.col("row_no")]
    keyed = texts.withColumns({"text_hash": F.xxhash64("text"), "row_no": F.monotonically_increasing_id()})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // TASK_DOCS))
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # The id travels as text: pandas would round large numbers next to nulls.
    sent = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    with arrow_batches(spark):
        made = scratch.write(sent.mapInPandas(sketch_frames, f"{SKETCH_SCHEMA}, part int, place string, text string"), "ranges")
    # One row for each range: which one follows, and the first after the last.
    parts = made.filter("place = 'first'").select("part")
    ahead = Window.orderBy("part")
    order_of = parts.select("part", F.coalesce(F.lead("part").over(ahead), F.first("part").over(ahead)).alias("next_part"))
    firsts = made.filter("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = made.filter("place = 'last'").select("part", "doc_id", "text").join(order_of, "part").join(firsts, "next_part")
    edges = lasts.select("doc_id", "text", "following").mapInPandas(join_frames, SKETCH_SCHEMA)
    found = made.filter("place = 'inner'").select(*SKETCHED).unionByName(edges)
    shown = {"doc_id": F.col("doc_id").cast("long"), "edited_sha256": F.lower(F.hex("edited_sha256"))}
    return found.mapInPandas(print_frames, PRINT_SCHEMA).select(*[shown.get(c, F.col(c)).alias(c) for c in PRINTED])
