"""Periodic runs of words: stretches that repeat one piece of text at least four times.

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(6, 4 * q)`` words that no neighbouring word extends with period ``q``.

Runs are found by block convolution at dyadic scales. At scale ``b`` (1, 2, 4, ...) the words
are cut into blocks of ``b``, and a run with a period from ``b`` to ``2 b - 1`` holds several
whole blocks, each of which comes back at the distance of the period. The sums of squared
differences between a block and the windows at all those distances are one convolution, made
exactly with number-theoretic transforms; where a sum is zero the block occurs. Neighbouring
blocks that come back at one distance are a seed, which is extended word by word.

Two exact conditions keep the work near linear. A block whose words do not all come back
within ``2 b`` words can't occur, so it is not transformed. And a seed, or a block with its
windows, inside a run of a smaller period repeats that run (a period of its own would be a
multiple), so it is left out: constant text costs no more than any other.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradeloom.llm.common import map_texts
from gradeloom.session import ship_package

#: A run has this many periods, and this many words, at least.
PERIODS, WORDS = 4, 6
#: Primes with many powers of two below them, and a generator of each.
PRIMES = ((2013265921, 31), (469762049, 3), (998244353, 3))
#: Below this block length sums of squares are added up directly.
DIRECT = 16
#: Numbers that one transform holds, but for longer single blocks.
TRANSFORM = 1 << 19
RUN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())]))


def _powers(root: int, n: int, prime: int) -> np.ndarray:
    """1, root, root^2, ... by doubling."""
    out, step = np.ones(1, np.uint64), root
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(prime)])
        step = step * step % prime
    return out[:n]


def transform(rows: np.ndarray, prime: int, generator: int, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; the length is a power of two.

    Decimation in frequency with its halves kept apart (Stockham), so no reordering is needed.
    """
    count, n = rows.shape
    p = np.uint64(prime)
    root = pow(generator, (prime - 1) // n, prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    x = rows.astype(np.uint64).reshape(count, n, 1)
    half = n
    while half > 1:
        half //= 2
        left, right = x[:, :half], x[:, half:]
        turn = _powers(root, half, prime)[None, :, None]
        x = np.stack([(left + right) % p, (left + p - right) % p * turn % p], axis=2).reshape(count, half, -1)
        root = root * root % prime
    out = x.reshape(count, n)
    return out * np.uint64(pow(n, prime - 2, prime)) % p if inverse else out


def mismatch_sums(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether each block (row of ``b`` numbers) differs from its window (``2 b`` numbers) at offsets 0 to b - 1.

    Zero in the result means that block and window are equal there. The sum of squared
    differences is exact: by so many primes that their product is larger than any sum.
    """
    count, size = blocks.shape
    if size < DIRECT:
        seen = np.lib.stride_tricks.sliding_window_view(windows, size, axis=1)[:, :size]
        return ((seen - blocks[:, None, :]) ** 2).sum(axis=2)
    largest = int(max(blocks.max(initial=0), windows.max(initial=0)))
    bound, used, product = size * largest * largest + 1, [], 1
    for prime in PRIMES:
        used.append(prime)
        product *= prime[0]
        if product > bound:
            break
    differs = np.zeros((count, size), bool)
    for prime, generator in used:
        p = np.uint64(prime)
        own, seen = blocks.astype(np.uint64) % p, windows.astype(np.uint64) % p
        turned = np.zeros((count, 2 * size), np.uint64)
        turned[:, 0], turned[:, size + 1 :] = own[:, 0], own[:, :0:-1]  # block backwards, so that products line up
        both = transform(transform(turned, prime, generator) * transform(seen, prime, generator) % p, prime, generator, inverse=True)[:, :size]
        squares = np.concatenate([np.zeros((count, 1), np.uint64), np.cumsum(seen * seen % p, axis=1)], axis=1)
        inside = (squares[:, size : 2 * size] - squares[:, :size]) % p
        total = ((own * own % p).sum(axis=1) % p)[:, None] + inside
        differs |= (total + (p - both) * np.uint64(2)) % p != 0
    return differs


class Runs:
    """The runs found so far, of periods below the present scale."""

    def __init__(self):
        self.found: list[tuple[int, int, int]] = []  # start, end, period
        self.starts = self.furthest = np.empty(0, np.int64)

    def add(self, runs: list[tuple[int, int, int]]) -> None:
        if runs:
            self.found.extend(runs)
            order = np.array(sorted(self.found), np.int64)
            self.starts, self.furthest = order[:, 0], np.maximum.accumulate(order[:, 1])

    def contain(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether one of them contains each stretch."""
        if not len(self.starts):
            return np.zeros(len(starts), bool)
        at = np.searchsorted(self.starts, starts, side="right")
        return (at > 0) & (self.furthest[np.maximum(at - 1, 0)] >= ends)


def _next_distance(ids: np.ndarray) -> np.ndarray:
    """How far on the same word comes next; 2^62 where it does not."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    out = np.full(len(ids), 1 << 62, np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _occurrences(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) of the blocks at these numbers that come back at ``size`` to ``2 size - 1`` words."""
    padded = np.concatenate([ids, np.arange(len(ids) + 1, len(ids) + 1 + 4 * size)]) if len(at) and (int(at[-1]) + 4) * size > len(ids) else ids
    found_at, found_by = [], []
    step = max(1, TRANSFORM // (size * (size if size < DIRECT else 2)))
    for first in range(0, len(at), step):
        part = at[first : first + step]
        places = part[:, None] * size + np.arange(3 * size)
        seen = padded[places]
        # Numbers of their own for the words of these blocks, so that sums stay small.
        small = np.unique(seen, return_inverse=True)[1].reshape(seen.shape).astype(np.int64)
        which, offset = np.nonzero(mismatch_sums(small[:, :size], small[:, size:]) == 0)
        found_at.append(part[which])
        found_by.append(offset + size)
    return np.concatenate([np.empty(0, np.int64), *found_at]), np.concatenate([np.empty(0, np.int64), *found_by])


def _extended(ids: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch that has the period, from words ``start`` to ``end`` (after the last) as far as it goes."""
    step = max(period, 16)
    while start > 0:
        first = max(0, start - step)
        bad = np.flatnonzero(ids[first:start] != ids[first + period : start + period])
        if len(bad):
            start = first + int(bad[-1]) + 1
            break
        start = first
    while end < len(ids):
        last = min(len(ids), end + step)
        bad = np.flatnonzero(ids[end:last] != ids[end - period : last - period])
        if len(bad):
            end += int(bad[0])
            break
        end = last
    return start, end


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of numbers, by start, then period."""
    n, size, runs = len(ids), 1, Runs()
    if n < WORDS:
        return []
    ahead = _next_distance(ids)
    while PERIODS * size <= n:
        blocks = n // size
        if size == 1:
            worst = ahead
        else:  # the blocks of the scale before, two by two
            worst = np.maximum(worst[: 2 * blocks : 2], worst[1 : 2 * blocks : 2])
        at = np.flatnonzero(worst < 2 * size)
        if len(at):
            at = at[~runs.contain(at * size, at * size + 3 * size)]
        if len(at):
            block, period = _occurrences(ids, at, size)
            order = np.lexsort((block, period))
            block, period = block[order], period[order]
            new = np.append(True, (np.diff(period) != 0) | (np.diff(block) != 1))[: len(block)]
            firsts = np.flatnonzero(new)
            counts = np.diff(np.append(firsts, len(block)))
            # So many whole blocks, with their next occurrences, lie in a run of this period at least.
            enough = counts >= np.maximum(1, (3 * period[firsts] + 1) // size - 1)
            firsts, counts = firsts[enough], counts[enough]
            starts, by = block[firsts] * size, period[firsts]
            ends = starts + counts * size + by
            own = ~runs.contain(starts, ends)
            found = set()
            for start, end, q in zip(starts[own].tolist(), ends[own].tolist(), by[own].tolist(), strict=True):
                start, end = _extended(ids, start, end, q)
                if end - start >= max(WORDS, PERIODS * q) and not runs.contain(np.array([start]), np.array([end]))[0]:
                    found.add((start, end, q))
            runs.add(sorted(found))
        size *= 2
    return sorted(runs.found, key=lambda x: (x[0], x[2]))


def runs_of_texts(texts: list[str]) -> list[pa.Array]:
    """The runs of each text, and its words without what repeats, for a list of texts at once.

    The words of all texts are one sequence in which equal words of different texts have
    different numbers, so no run passes from one text to the next.
    """
    words = [text.encode("utf-8", "surrogatepass").split() for text in texts]  # bytes: at the contract's white space only
    ids = np.empty(sum(map(len, words)), np.int64)
    bounds, used = [0], 0
    for own in words:
        known: dict[bytes, int] = {}
        ids[bounds[-1] : bounds[-1] + len(own)] = [known.setdefault(x, len(known)) for x in own]
        ids[bounds[-1] : bounds[-1] + len(own)] += used
        used += len(known)
        bounds.append(bounds[-1] + len(own))
    found = find_runs(ids)
    drop = np.zeros(len(ids) + 1, np.int64)
    for start, end, period in found:
        drop[start + period] += 1
        drop[end] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    each, i = [], 0
    for first, last in zip(bounds, bounds[1:], strict=False):
        own = []
        while i < len(found) and found[i][0] < last:
            start, end, period = found[i]
            own.append({"start": start - first, "length": end - start, "period": period})
            i += 1
        each.append(own)
    short = []
    for own, first, runs in zip(words, bounds, each, strict=False):
        if runs:
            own = [x for x, k in zip(own, islice(kept, first, first + len(own)), strict=True) if k]
        short.append(b" ".join(own).decode("utf-8", "surrogatepass"))
    return [each, short]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Adds ``runs`` (array of start, length, period, by start, then period) and ``collapsed`` to the documents.

    ``start`` is a word's number from 0; words are what lies between ASCII white space.
    ``collapsed`` has the words, joined by one space, without those that a run contains after
    its first period. A null or empty text has no run and collapses to an empty text. ``text``
    itself is not returned; repeated rows come out as often as they came, other columns stay,
    and one named ``runs`` or ``collapsed`` is replaced. An empty table gives an empty result.
    Texts are taken whole, of any length; a task holds one text, or a few short ones, at a time.
    """
    ship_package(docs.sparkSession)
    return map_texts(docs, [T.StructField("runs", RUN_TYPE), T.StructField("collapsed", T.StringType())], runs_of_texts)
