"""Repair of the structure of conversations: the cheapest edits that give proper turns.

After repair the first letters of the roles follow ``(s?(ua)+)?``: an optional system turn,
then user and assistant in turn. Edits of a row are Keep (0), Rerole to user or assistant (1)
and Delete (2, required for blank and repeated rows); Insert puts an empty user or assistant
turn anywhere (5). A truncated row that is not deleted adds 5. Of all cheapest edits those
whose letters (the audit, for example ``KKDIK``) come first in ASCII order are taken.

Each row is one of a few symbols (role and fault), and a conversation is a short text of them.
The pattern has four states, so whatever a stretch of rows can do is a matrix of four by four
cheapest costs, and the matrix of two stretches one after the other is their min-plus product.
Common stretches are found by Re-Pair: the most frequent pair of neighbouring symbols becomes
a symbol of its own, again and again, over all conversations of a batch; what is left is then
paired up. Each rule has one matrix, made once from those of its two parts, bottom up, and a
rope for the audits: where the two parts meet, so that an audit is written only when asked for.

Ties need no audit written out. An audit of a stretch has one letter for each of its rows
beside the inserts, which come before their row, and it leads from a state to one state only.
So no audit is the beginning of another one for the same rows, and the order of two is that of
their first parts: a matrix carries the rank of each audit among those from the same state.

Conversations are ordered and cut by ranges, so a very long one is cut into segments that
many tasks work on; each segment sends on a matrix, and these are multiplied in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACES, Carried, arrow_batches
from gradeloom.session import Scratch, ship_package

#: Rows, and code points of text, of one segment of a conversation, about.
SEGMENT_ROWS, SEGMENT_CHARS = 4_096, 1_000_000
#: Rows that one task orders and cuts, about.
TASK_ROWS = 200_000
#: Re-Pair rules of a batch; what is left of a text is paired up without counting.
RULES = 240
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
ROLES = "sua"  # any other letter is in none of the patterns
OK, CUT, BLANK, REPEATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: Audit letters that end a conversation in each state, and whether it may end then.
LAST_INSERTS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _after(state: int, letter: str) -> int | None:
    """The state after a turn whose role begins with this letter; None where it can't follow."""
    if letter == "s":
        return SYSTEM if state == START else None
    if letter == "a":
        return ASSISTANT if state == USER else None
    return USER if letter == "u" and state != USER else None


def _expected(state: int) -> str:
    return "assistant" if state == USER else "user"


def _row_audits(role: int, fault: int) -> list[list[tuple[int, str] | None]]:
    """For one row: the cheapest (cost, audit) from state to state, inserts before the row."""
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, inserts = start, 0, ""
        for _ in range(3):
            ways = [(DELETE, "D", state)]
            if fault in (OK, CUT):
                more = TRUNCATED if fault == CUT else 0
                kept = _after(state, ROLES[role]) if role < 3 else None
                if kept is not None:
                    ways.append((KEEP + more, "K", kept))
                ways.append((REROLE + more, "R", _after(state, _expected(state)[0])))
            for price, letter, end in ways:
                found = (cost + price, inserts + letter)
                if out[start][end] is None or found < out[start][end]:
                    out[start][end] = found
            state, cost, inserts = _after(state, _expected(state)[0]), cost + INSERT, inserts + "I"
    return out


SYMBOLS = 16  # role + 4 * fault
_AUDITS = [_row_audits(symbol % 4, symbol // 4) for symbol in range(SYMBOLS)]


def _base() -> tuple[np.ndarray, np.ndarray]:
    costs = np.array([[[x[0] if x else NEVER for x in row] for row in audits] for audits in _AUDITS], np.int64)
    ranks = np.array([[[sorted(y[1] if y else "~" for y in row).index(x[1] if x else "~") for x in row] for row in audits] for audits in _AUDITS], np.int8)
    return costs, ranks


class Grammar:
    """Rules of two symbols each, their matrices, and the audits that were asked for."""

    def __init__(self):
        self.costs, self.ranks = _base()
        self.middle = np.zeros((SYMBOLS, 4, 4), np.int8)
        self.left = self.right = np.full(SYMBOLS, -1, np.int64)
        self.numbers: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int, int], str] = {(s, p, q): x[1] for s, rows in enumerate(_AUDITS) for p, row in enumerate(rows) for q, x in enumerate(row) if x}

    def add(self, left: np.ndarray, right: np.ndarray) -> int:
        """Rules for these pairs; their matrices are the min-plus products. Returns the first one's symbol."""
        first = len(self.left)
        total = self.costs[left][:, :, :, None] + self.costs[right][:, None, :, :]  # rule, from, middle, to
        key = total * 4 + self.ranks[left][:, :, :, None]
        middle = key.argmin(axis=2)
        cost = np.minimum(np.take_along_axis(total, middle[:, :, None, :], 2)[:, :, 0], NEVER)
        own = np.take_along_axis(self.ranks[left], middle, 2).astype(np.int64)
        to = np.arange(4)[None, None, :]
        rank = own * 4 + self.ranks[right][np.arange(len(left))[:, None, None], middle, to]
        rank[cost == NEVER] = 99
        self.costs = np.concatenate([self.costs, cost])
        self.middle = np.concatenate([self.middle, middle.astype(np.int8)])
        self.ranks = np.concatenate([self.ranks, rank.argsort(axis=2, kind="stable").argsort(axis=2, kind="stable").astype(np.int8)])
        self.left, self.right = np.concatenate([self.left, left]), np.concatenate([self.right, right])
        return first

    def audit(self, symbol: int, start: int, end: int) -> str:
        """The audit of this entry, written out along its rope."""
        todo, key = [(symbol, start, end)], (symbol, start, end)
        while todo:
            s, p, q = todo[-1]
            if (s, p, q) in self.known:
                todo.pop()
                continue
            m = int(self.middle[s, p, q])
            parts = (int(self.left[s]), p, m), (int(self.right[s]), m, q)
            missing = [x for x in parts if x not in self.known]
            if missing:
                todo += missing
            else:
                self.known[s, p, q] = self.known[parts[0]] + self.known[parts[1]]
                todo.pop()
        return self.known[key]

    def reduce(self, texts: list[bytes], rules: int = RULES) -> np.ndarray:
        """One symbol for each text (bytes are symbols, no text is empty)."""
        flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        for _ in range(rules):  # Re-Pair
            inside = owner[:-1] == owner[1:]
            many = len(self.left)
            pairs = flat[:-1][inside] * many + flat[1:][inside]
            if not len(pairs):
                break
            counts = np.bincount(pairs)
            best = int(counts.argmax())
            if counts[best] < 2:
                break
            a, b = divmod(best, many)
            here = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b) & inside)
            if a == b:  # every other one of overlapping pairs, from the left
                run = np.append(True, (np.diff(here) != 1))
                place = np.arange(len(here)) - np.flatnonzero(run)[np.cumsum(run) - 1]
                here = here[place % 2 == 0]
            new = self.add(np.array([a]), np.array([b]))
            flat[here] = new
            keep = np.ones(len(flat), bool)
            keep[here + 1] = False
            flat, owner = flat[keep], owner[keep]
        while len(flat) > len(texts):  # the first with the second, the third with the fourth, ...
            firsts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            place = np.arange(len(flat)) - np.repeat(firsts, np.diff(np.append(firsts, len(flat))))
            here = np.flatnonzero((place[:-1] % 2 == 0) & (owner[:-1] == owner[1:]))
            many = len(self.left)
            pairs, which = np.unique(flat[here] * many + flat[here + 1], return_inverse=True)
            flat[here] = self.add(pairs // many, pairs % many) + which
            keep = np.ones(len(flat), bool)
            keep[here + 1] = False
            flat, owner = flat[keep], owner[keep]
        return flat


SEGMENT_SCHEMA = "conv_id long, part int, seg int, kinds binary, seen array<struct<at:int,h1:bigint,h2:bigint>>, roles array<string>, texts array<string>"
_SEEN = pa.list_(pa.struct([("at", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]))
_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("kinds", pa.binary()), ("seen", _SEEN), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _segments(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in order to segments: consecutive rows of one conversation."""
    from pyspark import TaskContext

    part, seg, chars, waiting = TaskContext.get().partitionId(), 0, 0, 0
    own: list[tuple] = []
    out: list[tuple] = []

    def closed() -> tuple:
        seen = [{"at": i, "h1": x[3], "h2": x[4]} for i, x in enumerate(own) if x[2] // 4 != BLANK]
        return own[0][0], part, seg, bytes(x[2] for x in own), seen, [x[1] for x in own], [x[5] for x in own]

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "kind", "h1", "h2", "text")), strict=True):
            if own and (own[0][0] != row[0] or len(own) == segment_rows or chars > SEGMENT_CHARS):
                out.append(closed())
                waiting += chars
                own, seg, chars = [], seg + 1, 0
                if len(out) == 512 or waiting > SEGMENT_CHARS:
                    yield _batch(out, _SEGMENT)
                    out, waiting = [], 0
            own.append(row)
            chars += len(row[5])
    if own:
        out.append(closed())
    if out:
        yield _batch(out, _SEGMENT)


MATRIX_SCHEMA = "conv_id long, part int, seg int, kinds binary, costs array<long>, ranks array<long>, audits array<string>"
_MATRIX = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("kinds", pa.binary()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])


def _matrices(batches: Iterator[pa.RecordBatch], rules: int) -> Iterator[pa.RecordBatch]:
    """Each segment's matrix, by one grammar for the segments of a batch."""
    for batch in batches:
        kinds = []
        for own, again in zip(batch.column("kinds").to_pylist(), batch.column("again").to_pylist(), strict=True):
            if again:
                own = bytearray(own)
                for i in again:
                    own[i] = own[i] % 4 + 4 * REPEATED
            kinds.append(bytes(own))
        # A row that must go is one symbol, whatever its role and fault.
        plain = [x.translate(_MUST_GO) for x in kinds]
        texts = list(dict.fromkeys(plain))
        grammar = Grammar()
        symbols = dict(zip(texts, grammar.reduce(texts, rules).tolist(), strict=True))
        written = {}
        for text, symbol in symbols.items():
            costs, ranks = grammar.costs[symbol], grammar.ranks[symbol]
            audits = [grammar.audit(symbol, p, q) if costs[p, q] < NEVER else None for p in range(4) for q in range(4)]
            written[text] = costs.ravel().tolist(), ranks.ravel().tolist(), audits
        ids, parts, segs = (batch.column(x).to_pylist() for x in ("conv_id", "part", "seg"))
        if ids:
            yield _batch([(a, b, c, kind, *written[text]) for a, b, c, kind, text in zip(ids, parts, segs, kinds, plain, strict=True)], _MATRIX)


_MUST_GO = bytes(x if x // 4 < BLANK else 4 * BLANK for x in range(SYMBOLS)) + bytes(256 - SYMBOLS)


class _Conversation:
    """What is known of the conversation that passes: first its matrices, then its texts, each in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.gaps, self.faults, self.illegal, self.last = conv_id, 0, [0, 0, 0, 0], 0, None
        self.costs, self.ranks = [0, NEVER, NEVER, NEVER], [0, 1, 1, 1]
        self.steps: list[list[tuple[int, str] | None]] = []
        self.path: list[tuple[int, str]] | None = None
        self.digest, self.lines, self.done = hashlib.sha256(), 0, 0

    def matrix(self, kinds: bytes, costs: list[int], ranks: list[int], audits: list[str | None]) -> None:
        for kind in kinds:
            self.faults[kind // 4] += 1
            role = kind % 4
            self.illegal += self.last is not None and (self.last, role) not in _LEGAL
            self.last = role
        step: list[tuple[int, str] | None] = [None] * 4
        found = []
        for q in range(4):
            cost, rank, p = min((self.costs[p] + costs[4 * p + q], self.ranks[p], p) for p in range(4))
            if cost < NEVER:
                step[q] = p, audits[4 * p + q]
                found.append((cost, (rank, ranks[4 * p + q]), q))
        order = sorted(x[1] for x in found)
        self.costs, self.ranks = [NEVER] * 4, [9] * 4
        for cost, key, q in found:
            self.costs[q], self.ranks[q] = cost, order.index(key)
        self.steps.append(step)

    def settle(self) -> None:
        """All matrices are there: the cheapest way back from the end."""
        self.cost, _, q = min((self.costs[q] + INSERT * len(x), self.ranks[q], q) for q, x in LAST_INSERTS.items())
        self.path, tail = [], LAST_INSERTS[q]
        for step in reversed(self.steps):
            p, audit = step[q]
            self.path.append((p, audit + tail))
            q, tail = p, ""
        self.path.reverse()
        self.steps = []

    def turns(self, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the next segment's repaired turns."""
        state, audit = self.path[self.done]
        self.done += 1
        rows = zip(roles, texts, strict=True)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit != "D":
                role = role if edit == "K" else _expected(state)
                state = _after(state, role[0])
                yield edit, role, text

    def row(self) -> tuple:
        return (self.conv_id, self.gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT], self.illegal, self.cost, "".join(x[1] for x in self.path), self.digest.hexdigest())


_LEGAL = {(ROLES.index(a), ROLES.index(b)) for a, b in ("su", "ua", "au")}
REPORT_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT = pa.schema([("conv_id", pa.int64()), *[(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
TURN_SCHEMA = "conv_id long, place long, edit string, role string, text string"
_TURN = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _repaired(batches: Iterator[pa.RecordBatch], as_turns: bool) -> Iterator[pa.RecordBatch]:
    """Rows by conversation: its gaps, its matrices in order, its texts in order; one segment's text is held at a time."""
    schema, now, out, chars = _TURN if as_turns else _REPORT, None, [], 0
    names = ("conv_id", "kind", "gaps", "kinds", "costs", "ranks", "audits", "roles", "texts")

    def ended() -> None:
        if now.path is None:
            now.settle()
        if not as_turns:
            out.append(now.row())

    for batch in batches:
        for i in range(batch.num_rows):
            conv_id, kind, gaps, kinds, costs, ranks, audits, roles, texts = (batch.column(x)[i].as_py() for x in names)
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    ended()
                now = _Conversation(conv_id)
            if kind == 0:
                now.gaps = max(now.gaps, gaps)
            elif kind == 1:
                now.matrix(kinds, costs, ranks, audits)
            else:
                if now.path is None:
                    now.settle()
                for edit, role, text in now.turns(roles, texts):
                    if as_turns:
                        out.append((conv_id, now.lines, edit, role, text))
                        chars += len(text)
                    else:
                        now.digest.update(f"{chr(10) if now.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                    now.lines += 1
            if len(out) >= 2_000 or chars > SEGMENT_CHARS:
                yield _batch(out, schema)
                out, chars = [], 0
    if now is not None:
        ended()
    if out:
        yield _batch(out, schema)


def _pass(turns: DataFrame, conversations: DataFrame | None, as_turns: bool, segment_rows: int, rules: int) -> DataFrame:
    spark = turns.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "conversations")
    given = Carried(turns, ["conv_id", "turn", "role", "text"], []).df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    ends = F.rtrim("text", F.lit(SPACES))
    fault = F.when(ends == "", BLANK).when(F.substring(ends, -1, 1).isin(".", "!", "?"), OK).otherwise(CUT)
    letter = F.substring("role", 1, 1)
    role = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    key = [F.col("conv_id"), F.col("role"), F.col("text")]
    rows = given.withColumns({"kind": role + 4 * fault, "h1": F.xxhash64(*key), "h2": F.xxhash64(F.lit("second"), *key)})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("h1")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // TASK_ROWS))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "role", "kind", "h1", "h2", "text")
    with arrow_batches(spark):
        segments = scratch.write(dealt.mapInArrow(partial(_segments, segment_rows=segment_rows), SEGMENT_SCHEMA), "segments")
    # Rows whose role and text came earlier in the conversation, among those that come more than once.
    seen = segments.select("part", "seg", F.inline("seen"))
    place = F.struct("part", "seg", "at")
    firsts = seen.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    again = seen.join(firsts, ["h1", "h2"]).filter(place > F.col("first")).groupBy("part", "seg").agg(F.collect_list("at").alias("again"))
    light = segments.select("conv_id", "part", "seg", "kinds").join(again, ["part", "seg"], "left").select("conv_id", "part", "seg", "kinds", "again")
    matrices = light.mapInArrow(partial(_matrices, rules=rules), MATRIX_SCHEMA)
    by_turn = given.select("conv_id", "turn").distinct().groupBy("conv_id")
    heads = by_turn.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    if conversations is not None:
        ids = Carried(conversations, ["conv_id"], []).df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        heads = heads.unionByName(ids.withColumn("gaps", F.lit(0).cast("long")))
    all_rows = (
        matrices.withColumn("kind", F.lit(1))
        .unionByName(segments.select("conv_id", "part", "seg", "roles", "texts").withColumn("kind", F.lit(2)), allowMissingColumns=True)
        .unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    )
    streamed = all_rows.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", F.col("part").asc_nulls_first(), F.col("seg").asc_nulls_first())
    return streamed.mapInArrow(partial(_repaired, as_turns=as_turns), TURN_SCHEMA if as_turns else REPORT_SCHEMA)


def repair_conversations(turns: DataFrame, conversations: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS, rules: int = RULES) -> DataFrame:
    """One row for each ``conv_id``: its faults, the cheapest edits and a digest of the repaired turns.

    ``turns`` has ``conv_id turn role text``; a null role or text is one space. Rows are taken by
    ``turn`` (nulls first), those with one turn by role, then by text (its first 64 code points,
    then a hash). A row's first fault counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (role and
    text came earlier in the conversation), ``truncated`` (what it ends with is not one of ``.!?``).
    ``gaps`` are missing numbers between the least and the greatest turn, nulls aside, ``illegal``
    neighbours whose roles do not begin with su, ua or au. ``cost`` and ``audit`` are those of the
    module's text; ``repaired_sha256`` is of the repaired ``role:text``, joined by line feeds.

    ``segment_rows`` and ``rules`` (Re-Pair rules of a batch) change the work, not the result.

    Ids of ``conversations`` (a table with ``conv_id``) without a row have zeros, an empty audit
    and the digest of nothing. A null ``conv_id`` is an id of its own. Other columns are ignored; an
    empty table gives an empty result. The digest of one conversation is made in one task, as
    its turns pass in order; a segment's turns, and the audits that lead to each state, are held.
    """
    return _pass(turns, conversations, False, segment_rows, rules)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """The turns after repair: ``conv_id place edit role text``; ``place`` counts from 0 in each conversation.

    ``edit`` is K for a kept turn, R for one with a new role, I for an inserted one with an empty text.
    """
    return _pass(turns, None, True, SEGMENT_ROWS, RULES)
