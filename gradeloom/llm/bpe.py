"""Byte-pair encoding of many words at once, in vectorised merge rounds.

All words' symbols lie in one flat numpy array. A round finds each word's best pair by a
segmented minimum of pair ranks, merges all its leftmost non-overlapping occurrences in
every word, closes the gaps, and sets aside words in which no pair is left. That gives what merging one pair at a time gives unless a
merge makes a pair that is as good as
the one just merged, or better; words in which that happens are merged one pair at a time.
"""

from __future__ import annotations

import heapq

import numpy as np

NO_PAIR = np.int64(1) << 40
_SYMBOLS = np.int64(1) << 31


class MergeTable:
    """(left, right) -> rank and merged symbol, as an open-addressing hash table in numpy."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        bits = max(8, (16 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_PAIR, np.int64)
        self.merged = np.zeros(1 << bits, np.int64)
        for (left, right), (rank, merged) in pairs.items():
            slot = int(self._slot(np.array([left * int(_SYMBOLS) + right], np.int64))[0])
            while self.keys[slot] != -1:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.ranks[slot], self.merged[slot] = left * int(_SYMBOLS) + right, rank, merged

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (keys.astype(np.uint64) >> np.uint64(29))
        return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left * _SYMBOLS + right
        slots = self._slot(keys)
        ranks, merged = np.full(len(keys), NO_PAIR, np.int64), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slots[open_]]
            hit = held == keys[open_]
            at = open_[hit]
            ranks[at], merged[at] = self.ranks[slots[at]], self.merged[slots[at]]
            open_ = open_[~hit & (held != -1)]
            slots[open_] = (slots[open_] + 1) & self.mask
        return ranks, merged


def merge_one_by_one(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Best rank first, then leftmost; for the words that a round can't merge at once."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    heap = [(pairs[p][0], i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    alive = [True] * len(symbols)
    while heap:
        _, i, (left, right) = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(symbols) or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], alive[j], after[i] = pairs[left, right][1], False, after[j]
        if after[i] < len(symbols):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(symbols) and (p := (symbols[a], symbols[b])) in pairs:
                heapq.heappush(heap, (pairs[p][0], a, p))
    return [x for x, kept in zip(symbols, alive, strict=True) if kept]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat symbols of consecutive words, merged; the words' new lengths; the words left to be merged one by one."""
    n_words = len(lengths)
    symbols = symbols.astype(np.int64)
    word = np.repeat(np.arange(n_words), lengths)
    ranks, merged = table.find(symbols[:-1], symbols[1:])
    ranks, merged = np.append(ranks, NO_PAIR), np.append(merged, 0)
    ranks[:-1][word[:-1] != word[1:]] = NO_PAIR
    done_words, done_symbols, one_by_one = [], [], []
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(word)))
        best = np.minimum.reduceat(ranks, starts)
        finished = np.repeat(best == NO_PAIR, sizes)
        if finished.any():
            done_words.append(word[finished])
            done_symbols.append(symbols[finished])
            live = ~finished
            symbols, word, ranks, merged = symbols[live], word[live], ranks[live], merged[live]
            open_ = best != NO_PAIR
            sizes, best = sizes[open_], best[open_]
            if not len(symbols):
                break
        here = np.flatnonzero(ranks == np.repeat(best, sizes))
        # Of neighbouring occurrences every other one, from the left.
        run = np.append(True, np.diff(here) != 1)
        place = np.arange(len(here)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        here = here[place % 2 == 0]
        old = ranks[here]
        # Where the symbol to the right is merged as well, a merge first meets it as it was.
        close = np.flatnonzero((np.diff(here) == 2) & (word[here[:-1]] == word[here[1:]]))
        hasty = np.zeros(len(here), bool)
        hasty[close] = table.find(merged[here[close]], symbols[here[close] + 2])[0] <= old[close]
        symbols[here] = merged[here]
        keep = np.ones(len(symbols), bool)
        keep[here + 1] = False
        new = here - np.arange(len(here))  # each earlier merge has closed one gap
        symbols, word, ranks, merged = symbols[keep], word[keep], ranks[keep], merged[keep]
        right = new[new + 1 < len(symbols)]
        left = new[new > 0] - 1
        for at in (left, right):
            ranks[at], merged[at] = table.find(symbols[at], symbols[at + 1])
            ranks[at[word[at] != word[at + 1]]] = NO_PAIR
        ranks[-1] = NO_PAIR
        hasty |= (ranks[new] <= old) | ((new > 0) & (ranks[np.maximum(new - 1, 0)] <= old))
        if hasty.any():
            again = np.unique(word[new[hasty]])
            one_by_one.append(again)
            live = ~np.isin(word, again)
            symbols, word, ranks, merged = symbols[live], word[live], ranks[live], merged[live]
    return _gathered(done_words, done_symbols, one_by_one, n_words)


def _gathered(done_words: list, done_symbols: list, one_by_one: list, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.concatenate([np.empty(0, np.int64), *done_words])
    symbols = np.concatenate([np.empty(0, np.int64), *done_symbols])
    order = np.argsort(words, kind="stable")
    return symbols[order], np.bincount(words, minlength=n_words), np.concatenate([np.empty(0, np.int64), *one_by_one])


def encode_words(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """The words' merged symbols, one word after the other, and how many each has."""
    merged, counts, again = merge_rounds(symbols, lengths, table)
    if not len(again):
        return merged, counts
    words = np.split(merged, np.cumsum(counts)[:-1])
    ends = np.cumsum(lengths)
    for i in again.tolist():
        words[i] = np.array(merge_one_by_one(symbols[ends[i] - lengths[i] : ends[i]].tolist(), table.pairs), np.int64)
        counts[i] = len(words[i])
    return np.concatenate(words), counts


def sliced(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each word's part of the array as bytes."""
    data, size = flat.tobytes(), flat.itemsize
    ends = (np.cumsum(counts) * size).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
