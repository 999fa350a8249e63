"""Copy detection on C programs: renamed, reordered, given code, and against a loop in Python."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.text import C_KEYWORDS
from gradeloom.operators import copies

SORT = """
int partition(int *a, int lo, int hi) { int p = a[hi]; int i = lo - 1; for (int j = lo; j < hi; j++) { if (a[j] < p) { i++; swap(a + i, a + j); } } swap(a + i + 1, a + hi); return i + 1; }
void quick(int *a, int lo, int hi) { if (lo < hi) { int m = partition(a, lo, hi); quick(a, lo, m - 1); quick(a, m + 1, hi); } }
"""
SEARCH = """
int find(const int *a, int n, int x) { int lo = 0, hi = n; while (lo < hi) { int mid = lo + (hi - lo) / 2; if (a[mid] < x) lo = mid + 1; else hi = mid; } return lo < n && a[lo] == x ? lo : -1; }
"""
OTHER = 'struct node { struct node *next; char *name; }; struct node *push(struct node *head, char *name) { struct node *n = malloc(sizeof *n); n->next = head; n->name = name; puts("ok"); return n; }'


def renamed(source):
    names = {"partition": "teile", "quick": "sortiere", "find": "suche", "lo": "links", "hi": "rechts", "mid": "mitte", "p": "angel", "a": "feld", "i": "unten", "j": "lauf", "x": "wert", "n": "anzahl", "m": "grenze"}
    changed = re.sub(r"[A-Za-z_]\w*", lambda m: names.get(m[0], m[0]), source)
    return re.sub(r"\b1\b", "0x1"[2:], "/* mine */ " + changed.replace("{", "{ // note\n"))


def answers(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def test_token_stream_makes_names_literals_and_numbers_equal(spark):
    df = answers(spark, [(1, 'for (int i = 0; s[i] != \'\\0\'; i++) printf("a // b", x_1, 2.5); // end')])
    got = df.select(copies.c_token_stream(F.col("text"))).first()[0]
    assert got == [*"for ( int v = 0 ; v [ v ] ! =".split(), '"', *"; v + + ) v (".split(), '"', *", v , 0 ) ;".split()]


def test_renamed_and_reordered_programs_are_found(spark):
    rows = [(1, SORT + SEARCH), (2, renamed(SEARCH) + renamed(SORT)), (3, OTHER), (4, None), (5, "")]
    got = copies.copy_pairs(answers(spark, rows), "id", "text", k=8, window=4).collect()
    assert [(r["class_a"], r["class_b"]) for r in got] == [(1, 2)]
    assert got[0]["share"] > 0.8


def test_given_code_makes_no_pairs_but_is_counted(spark):
    own = [f"int f{i}(void) {{ return {' + '.join(['x'] * (3 + i))} {'*' * (i % 3)} y[{i}] {'/ z ' * i}; }}" for i in range(8)]
    rows = [(i, SORT + own[i]) for i in range(8)]
    assert copies.copy_pairs(answers(spark, rows), "id", "text", k=8, window=4, common=5, min_share=0.3).filter("class_a = 0 and class_b = 7").count() == 0
    classes = copies.copy_classes(answers(spark, rows), "id", "text", k=8, window=4, common=5).collect()
    assert all(r["n_common"] > r["n_prints"] / 2 for r in classes if r["id"] in (0, 7))
    assert copies.copy_pairs(answers(spark, rows), "id", "text", k=8, window=4, common=8, min_share=0.3).filter("class_a = 0 and class_b = 7").count() == 1


def test_many_exact_copies_are_one_class(spark):
    rows = [(i, renamed(SORT) if i % 2 else SORT) for i in range(60)] + [(99, SORT + SEARCH), (100, "int x;"), (None, None)]
    df = answers(spark, rows)
    classes = {r["id"]: r["class_id"] for r in copies.copy_classes(df, "id", "text", k=8, window=4).collect()}
    assert {classes[i] for i in range(60)} == {0} and classes[99] == 99 and classes[100] == 100 and classes[None] is None
    assert [(r["class_a"], r["class_b"]) for r in copies.copy_pairs(df, "id", "text", k=8, window=4).collect()] == [(0, 99)]


def test_within_keeps_assessments_apart(spark):
    rows = [(1, "a", SORT), (2, "a", SORT + SEARCH), (3, "b", SORT + OTHER), (4, None, SORT + OTHER), (5, "b", SORT)]
    df = spark.createDataFrame(rows, "id long, task string, text string")
    got = copies.copy_pairs(df, "id", "text", k=8, window=4, within=["task"]).collect()
    assert sorted((r["task"], r["class_a"], r["class_b"]) for r in got) == [("a", 1, 2), ("b", 3, 5)]


def winnowed(text, k, window):
    parts = re.findall(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|[^"\'/]+|["\'/]', text)
    text = "".join(" " if x.startswith(("//", "/*")) else x for x in parts)
    tokens = re.findall(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[!-/:-@\[-^`{-~]', text)
    kind = lambda x: '"' if len(x) > 1 and x[0] in "\"'" else "v" if (x[0].isalpha() or x[0] == "_") and x not in C_KEYWORDS else "0" if x[0].isdigit() else x
    stream = [kind(x) for x in tokens]
    hashes = [int(hashlib.md5(" ".join(stream[i : i + k]).encode()).hexdigest()[:15], 16) for i in range(len(stream) - k + 1)]
    return sorted({min(hashes[i : i + window]) for i in range(max(1, len(hashes) - window + 1))}) if hashes else []


@pytest.mark.parametrize("k, window", [(1, 1), (3, 2), (10, 6), (7, 5)])
def test_fingerprints_equal_a_loop(spark, k, window):
    rng = random.Random(k)
    pieces = ["int ", "x", " = ", "1.5", ";", '"a b"', "// c\n", "/* d */", "while", "(", ")", "{", "}", " y1 ", "'", '"', "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(60))) for _ in range(40)] + [SORT]
    df = answers(spark, list(enumerate(texts)))
    got = {r["id"]: r["prints"] for r in copies.fingerprints(df, "id", "text", k, window, []).collect()}
    assert got == {i: winnowed(x, k, window) for i, x in enumerate(texts)}


def test_a_literal_longer_than_a_stack_is_one_token(spark):
    code = "int f(int n) { return n * (n - 1) / 2 + g(n); }"
    rows = [(1, f'{code} s = "{"x" * 300_000}"; {code}'), (2, f'{code} s = "y"; {code}'), (3, f"/* {'*' * 300_000} */ {code}"), (4, code)]
    got = {r["id"]: r["prints"] for r in copies.fingerprints(answers(spark, rows), "id", "text", 8, 4, []).collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(got[1]) > len(got[4]) > 0


def batch_of(texts):
    return pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])


def test_a_run_of_tokens_is_hashed_once_for_many_texts(monkeypatch):
    """Work on hashes grows with unlike runs and not with texts."""
    hashed = []
    real = hashlib.md5
    monkeypatch.setattr(copies.hashlib, "md5", lambda x: hashed.append(x) or real(x))
    once = next(copies._winnowed(iter([batch_of([SORT.encode()])]), 8, 4)).to_pylist()
    n = len(hashed)
    many = next(copies._winnowed(iter([batch_of([renamed(SORT).encode() if i % 2 else SORT.encode() for i in range(500)])]), 8, 4)).to_pylist()
    assert len(hashed) == 2 * n == 2 * len(set(hashed)) and {tuple(r["prints"]) for r in many} == {tuple(once[0]["prints"])}


@pytest.mark.parametrize("at_once", [1, 40, 1 << 22])
def test_tokens_in_batches_equal_the_loop(monkeypatch, at_once):
    monkeypatch.setattr(copies, "AT_ONCE", at_once)
    rng = random.Random(at_once)
    pieces = ["int ", "x", " = ", "1.5", ".2", "1.2.3.4", "10for", "x1.5", "0x1F", "continue", "continued", '"a b"', "// c\n", "/* d */", "/*", "*/", "/", "*", "\\", "\n", "while", "(", "}", "_", "'", '"', "é", "中", "\0", "a"]
    for k, window in [(1, 1), (2, 9), (5, 3), (11, 6), (40, 2)]:
        texts = ["".join(rng.choices(pieces, k=rng.randrange(90))) for _ in range(60)] + ["", "x"]
        got = next(copies._winnowed(iter([batch_of([x.encode() for x in texts] + [None])]), k, window)).to_pylist()
        assert [r["prints"] for r in got] == [*(winnowed(x, k, window) for x in texts), []]
    assert next(copies._winnowed(iter([batch_of([])]), 3, 2)).num_rows == 0
    assert next(copies._winnowed(iter([batch_of([b"\xff\xfe int \x80x = 1.5;", b"int x = 1;"])]), 3, 2)).to_pylist()[0]["prints"] == winnowed("int x = 1;", 3, 2)


def test_the_column_of_tokens_is_what_batches_read(spark):
    texts = ['for (int i = 0; s[i] != \'\\0\'; i++) printf("a // b", x_1, 2.5); // end', SORT, renamed(SEARCH), OTHER, "1.2.3 10for x1.5 3e5 .5 continue_ 'a' it's"]
    stream = [r[0] for r in answers(spark, list(enumerate(texts))).orderBy("id").select(copies.c_token_stream(F.col("text"))).collect()]
    kinds, begins = copies._kinds([x.encode() for x in texts])
    assert stream == [[copies.KINDS[x].decode() for x in kinds[a:b]] for a, b in zip(begins, begins[1:], strict=False)]


def test_classes_of_answers_with_long_and_broken_literals(spark):
    """Literals of any length, and with a carriage return after a backslash as in the SQL, are one token."""
    tail = "int f(int n) { while (n > 1) { n = n / 2 + g(n - 1) * 3; } return n; }"
    long, broken, short = f'char *s = "{"x y " * 50_000}"; {tail}', f'char *t = "a\\\rb"; {tail}', f'char *u = "z"; {tail}'
    got = {r["id"]: tuple(r)[1:] for r in copies.copy_classes(answers(spark, [(4, long), (3, broken), (5, short), (6, tail)]), "id", "text", k=8, window=4).collect()}
    assert got[4] == got[3] == got[5] == (3, len(winnowed(short, 8, 4)), 0) and got[6][0] == 6


def sets_of(rows):
    return pa.record_batch([pa.array([x for x, _ in rows]), pa.array([f"key {i}" for i in range(len(rows))]), pa.array([x for _, x in rows], pa.list_(pa.int64()))], names=["task", "class_key", "prints"])


@pytest.mark.parametrize("at_once", [1, 100, 1 << 22])
def test_a_fingerprint_of_very_many_classes_is_one_row(monkeypatch, at_once):
    """Rows that meet by a common fingerprint grow with the batches and not with the classes."""
    monkeypatch.setattr(copies, "AT_ONCE", at_once)
    rows = [("ab"[i % 3 == 0], [7, 1_000 + i // 4, 2_000 + i]) for i in range(300)]
    got = [r for b in copies._listed(iter([sets_of(rows[:200]).slice(0, 150), sets_of(rows).slice(150), sets_of([])]), 3, 1) for r in b.to_pylist()]
    counts = {}
    for r in got:
        counts[r["task"], r["print"]] = counts.get((r["task"], r["print"]), 0) + r["n_held"]
    assert counts == {(t, x): sum(t == u and x in held for u, held in rows) for t, own in rows for x in own}
    assert sorted((r["class_key"], r["print"]) for r in got if r["print"] >= 1_000) == sorted((f"key {i}", x) for i, (_, own) in enumerate(rows) for x in own[1:])
    if at_once > 100:
        assert sum(r["print"] == 7 for r in got) == 4


def test_classes_need_no_join_by_fingerprint(spark):
    df = answers(spark, [(i, SORT + f"{'x + ' * i} 1;") for i in range(30)])
    plan = copies.copy_classes(df, "id", "text", k=8, window=4, common=5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not [x for x in plan.splitlines() if "Join" in x and "print#" in x]


@pytest.mark.parametrize("rows_at_once", [1, 4, 10_000])
def test_what_is_common_equals_a_loop(spark, rows_at_once):
    """Fingerprints of as many classes as ``common`` and of one more, in batches of few answers, by group and without."""
    rng = random.Random(5)
    parts = [f"a{' + b' * i} {'*' * (i % 4)} c[{i}]{' / d' * (i % 5)}; while (x) {{ y{'(' * (i % 7)} }}" for i in range(14)]
    rows = [(i, rng.choice("ppq") if i % 9 else None, rng.choice([0, 1, None]), " ".join(rng.sample(parts, rng.randrange(5)))) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, task string, part int, text string").repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, numbers = spark.conf.get(name), set()
    spark.conf.set(name, str(rows_at_once))
    try:
        for within in ([], ["task"], ["task", "part"]):
            got = {r["id"]: (r["class_id"], r["n_prints"], r["n_common"]) for r in copies.copy_classes(df, "id", "text", 6, 3, 4, within).collect()}
            own = {i: ((task, part)[: len(within)], tuple(winnowed(text, 6, 3))) for i, task, part, text in rows}
            classes, held = {}, {}
            for i in sorted(own, reverse=True):
                classes[own[i]] = i
            for group, prints in classes:
                for x in prints:
                    held[group, x] = held.get((group, x), 0) + 1
            expected = {i: (classes[c] if c[1] else i, len(c[1]), 0 if None in c[0] else sum(held[c[0], x] > 4 for x in c[1])) for i, c in own.items()}
            assert got == expected
            numbers |= set(held.values())
        assert {4, 5} <= numbers
    finally:
        spark.conf.set(name, before)
