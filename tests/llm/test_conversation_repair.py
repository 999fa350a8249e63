"""Repair against a search over edits with a heap, and the query against a loop over conversations."""

import hashlib
import heapq
import random
import zlib

import pytest

from gradeloom.llm import conversation_repair as repair
from gradeloom.llm.queries import damaged_turns, op12_conversation_repair
from tests.oracle import SMALL

BLANKS = " \t\n\x0b\x0c\r"


def faults_of(rows):
    """First fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def follows(state, letter):
    if letter == "s":
        return 1 if state == 0 else None
    if letter == "a":
        return 3 if state == 2 else None
    return 2 if letter == "u" and state != 2 else None


def search(rows, faults):
    """(cost, audit, repaired lines): cheapest first, then in ASCII order."""
    heap = [(0, "", 0, 0, ())]
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        if len(audit) > 2 * len(rows) + 4:
            continue
        turn = "assistant" if state == 2 else "user"
        ways = [(5, "I", 0, f"{turn}:", follows(state, turn[0]))]
        if i < len(rows):
            role, text = rows[i]
            ways.append((2, "D", 1, None, state))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                if role and follows(state, role[0]) is not None:
                    ways.append((more, "K", 1, f"{role}:{text}", follows(state, role[0])))
                ways.append((1 + more, "R", 1, f"{turn}:{text}", follows(state, turn[0])))
        for price, letter, step, line, end in ways:
            heapq.heappush(heap, (cost + price, audit + letter, i + step, end, lines if line is None else (*lines, line)))


def report(rows):
    """The whole row but for the id, of (turn, role, text) in order."""
    turns = [t for t, _, _ in rows if t is not None]
    said = [(r, x) for _, r, x in rows]
    faults = faults_of(said)
    illegal = sum(f"{a[:1]}{b[:1]}" not in ("su", "ua", "au") for (a, _), (b, _) in zip(said, said[1:], strict=False))
    cost, audit, lines = search(said, faults)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(table):
    """The query's rows, of (conv_id, turn, role, text) rows."""
    out = {}
    space = lambda x: " " if x is None else x
    for conv_id, turn, role, text in table:
        rows = out.setdefault(conv_id, [])
        kind = zlib.crc32(f"{space(conv_id)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        role, text = space(role), space(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    return sorted(((c, *report(sorted(rows, key=order))) for c, rows in out.items()), key=lambda x: (x[0] is not None, x[0] or 0))


def answer(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is not None, x[0] or 0))


def test_query_equals_brute_force(spark):
    table = [tuple(row) for row in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answer(op12_conversation_repair(spark, SMALL)) == brute(table)


def made_up(seed, conversations=120):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Yes.", "No!", "cut", "", " \t\x0b", None, "é.", "why?  \n", "Yes", " "])
            rows.append((rng.choice([c, c, c, None]) if c == 7 else c, rng.choice([turn, turn, None, 3]), role, text))
    return rows + rows[::40]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows, rules", [(4_096, 240), (2, 240), (3, 0)])
def test_made_up_conversations_in_segments(spark, rows, rules):
    table = made_up(rows)
    turns = spark.createDataFrame([(*x, 5, "x") for x in table], f"{SCHEMA}, kind int, CONVERSATION string").repartition(3)
    found = repair.repair_conversations(damaged_turns(turns), turns.select("conv_id", "kind"), rows, rules)
    assert answer(found) == brute(table)


def test_all_dropped_and_empty_table(spark, tmp_path):
    dropped = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows = [(c, t, "user", "Hi.") for c, t in dropped]
    nothing = hashlib.sha256(b"").hexdigest()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert answer(op12_conversation_repair(spark, str(tmp_path))) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c, _ in dropped]
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns_are_what_the_digest_is_of(spark):
    turns = damaged_turns(spark.read.parquet(f"{SMALL}/conversations.parquet"))
    digests = {row["conv_id"]: row["repaired_sha256"] for row in repair.repair_conversations(turns).collect()}
    lines = {}
    for row in sorted(repair.repaired_turns(turns).collect(), key=lambda x: (x["conv_id"], x["place"])):
        lines.setdefault(row["conv_id"], []).append(f"{row['role']}:{row['text']}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: d for c, d in digests.items() if c in lines}


def test_a_grammar_shares_rules_among_texts():
    grammar = repair.Grammar()
    texts = [bytes([1, 2] * 512), bytes([1, 2] * 256), bytes([1, 2] * 300 + [1])]
    symbols = grammar.reduce(texts).tolist()
    assert len(grammar.left) - repair.SYMBOLS < 30
    assert [int(grammar.costs[s][0, repair.ASSISTANT]) for s in symbols[:2]] == [0, 0]
    assert grammar.audit(symbols[0], repair.START, repair.ASSISTANT) == "K" * 1024
