"""Hand-worked cases that the given tables do not hold."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.functions.text import edit_credit, normalize_answer
from gradeloom.operators import answers, feedback, grading, reports
from gradeloom.sources import pages, sinks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize(
    ("source", "kept"),
    [
        ("int x; // note", "int x;"),
        ("int/* a\n b */x;", "int x;"),
        ('puts("http://a /* b */");', 'puts("http://a /* b */");'),
        ("char c = '\"'; // \" end", "char c = '\"';"),
        ('puts("a\\"//b"); /* c **/ y', 'puts("a\\"//b"); y'),
        ("", ""),
        ("/* open", "/* open"),
    ],
)
def test_comments_go_and_literals_stay(spark, source, kept):
    df = spark.createDataFrame([(source,)], "t string")
    assert df.select(normalize_answer(F.col("t"), fold_case=False)).first()[0] == kept


def test_null_answer_stays_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(normalize_answer(F.col("t"))).first()[0] is None


def test_token_counts(spark):
    df = spark.createDataFrame([("for (int i=0; i<10; i++) año_1 += 2.5;",), ("",)], "t string")
    got = answers.c_token_counts(df, "t").collect()[0]
    assert (got["keywords"], got["numbers"]) == (2, 3)
    assert got["identifiers"] == 7  # for int i i i a o_1


def test_edit_credit(spark):
    df = spark.createDataFrame([("año", "ano"), ("", ""), ("abc", "xyz"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(edit_credit(F.col("a"), F.col("b"))).collect()] == [pytest.approx(2 / 3), 1.0, 0.0, None]


def test_missing_last_page_and_unknown_answer(spark):
    got = spark.createDataFrame([(1, 1), (1, 1), (1, 3)], "s int, p int")
    expected = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "s int, n int")
    assert rows(answers.missing_pages(got, expected, ["s"], "p", "n"), "s", "p") == [(1, 2), (1, 4), (2, 1)]


def test_assembly_orders_pages_and_skips_null(spark):
    got = spark.createDataFrame([(1, 2, "b"), (1, 10, "c"), (1, 1, "a"), (2, 1, None)], "s int, p int, t string")
    assert rows(answers.assemble_answers(got, ["s"], "p", "t"), "s", "text", "n_pages") == [(1, "a\nb\nc", 3), (2, "", 0)]


def test_review_queue_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("x", 3, 0.1), ("x", 1, 0.1), ("x", 2, 0.0), ("y", 9, 0.9)], "sec string, k int, c double")
    assert rows(answers.review_queue(df, 2, "sec", "c", "k"), "sec", "k") == [("x", 1), ("x", 2), ("y", 9)]


def test_duplicate_mark_and_cap(spark):
    marks = spark.createDataFrame([(1, 1, 50.0, 1), (1, 1, 10.0, 2), (1, 2, 60.0, 1)], "s int, q int, m double, t int")
    latest = grading.latest_mark(marks, ["s", "q"], [F.col("t").desc()])
    assert rows(latest, "q", "m") == [(1, 10.0), (2, 60.0)]
    scored = grading.weighted_score(latest, ["s"], "m", F.lit(1.0), 40.0)
    assert scored.first()["score"] == pytest.approx(50 / 80)


def test_bands_have_open_ends(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    got = [r["band"] for r in grading.grade_bands(df, "x", spark.createDataFrame([("low", 0.0, 0.5), ("high", 0.5, 1.0)], "band string, low double, high double")).collect()]
    assert got == ["low", "high", None, None]


def test_exemplars_in_blocks_equal_one_block(spark, monkeypatch):
    points = [(i, [float(i % 7), float(i % 5), 1.0], i % 3) for i in range(60)]
    df = spark.createDataFrame(points, "id long, v array<double>, lab int")
    whole = rows(grading.grade_by_exemplar(df.filter("id < 10"), df.filter("id >= 10"), 5, "id", "v", "lab"), "id", "predicted", "votes")
    monkeypatch.setattr(grading, "EXEMPLAR_BLOCK", 11)
    assert rows(grading.grade_by_exemplar(df.filter("id < 10"), df.filter("id >= 10"), 5, "id", "v", "lab"), "id", "predicted", "votes") == whole
    none = grading.grade_by_exemplar(df, df.limit(0), 5, "id", "v", "lab")
    assert none.count() == 0


def test_exemplars_stay_in_tasks(spark, monkeypatch):
    """No table is collected to the driver, and null keys and labels and large keys are kept."""
    points = [(None if i == 20 else 2**60 + i, [float(i % 7), float(i % 5), 1.0], None if i % 3 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "n int, id long, v array<double>, lab int")

    def no_collect(self, *args):
        raise AssertionError("collected")

    monkeypatch.setattr(type(df), "toPandas", no_collect)
    monkeypatch.setattr(grading, "EXEMPLAR_BLOCK", 11)
    got = rows(grading.grade_by_exemplar(df.filter("n < 10"), df.filter("n >= 10"), 5, "id", "v", "lab"), "id", "predicted", "votes")
    expected = []
    for key, v, _ in points[:10]:
        near = sorted(points[10:], key=lambda p: (-sum(a * b for a, b in zip(v, p[1], strict=True)), p[0] is not None, p[0]))[:5]
        votes = [(-sum(p[2] == label for p in near), label is not None, label or 0, label) for label in {p[2] for p in near}]
        best = min(votes)
        expected.append((key, best[3], -best[0]))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


def test_rubric_shares(spark):
    docs = spark.createDataFrame([(1, "One two THREE four; one two three four"), (2, "nothing"), (3, None)], "d int, t string")
    items = spark.createDataFrame([(7, "one two three four five")], "i int, p string")
    got = grading.rubric_coverage(docs, items, "d", "t", "i", "p", n=3, min_share=0.5).collect()
    assert [(r["d"], r["grams_total"], r["grams_found"]) for r in got] == [(1, 3, 2)]


def test_item_without_variance_has_no_discrimination(spark):
    marks = spark.createDataFrame([(1, 1, 2.0), (2, 1, 2.0), (1, 2, 1.0), (2, 2, 3.0)], "p int, i int, m double")
    got = {r["i"]: r for r in reports.item_analysis(marks, "p", "i", "m").collect()}
    assert got[1]["discrimination"] is None and got[1]["difficulty"] == 2.0 and got[2]["discrimination"] is None


def test_agreement_by_chance_and_whole(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (None, 1)], "a int, b int")
    got = reports.agreement(df, F.col("a"), F.col("b")).first()
    assert (got["n11"], got["agreement"], got["kappa"]) == (2, 1.0, None)
    empty = reports.agreement(df.limit(0), F.col("a"), F.col("b")).first()
    assert empty["agreement"] is None


def test_distribution_forms_agree(spark):
    df = spark.range(101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    exact, rough = (reports.score_distribution(df, "g", "x", e).first() for e in (True, False))
    assert (exact["q1"], exact["median"], exact["q3"]) == (25.0, 50.0, 75.0) == (rough["q1"], rough["median"], rough["q3"])


def test_attempts(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 9.0)], "s int, t int, x double")
    assert rows(reports.attempt_delta(df, "s", "x", ["t"]), "attempt", "change", "best") == [(1, None, 5.0), (2, -2.0, 5.0), (3, 6.0, 9.0)]


def test_common_faults_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 4), (1, 4), (1, 3)], "q int, c int")
    assert rows(feedback.common_faults(df, "q", "c", F.lit(True), 2), "c", "n_missed") == [(3, 1), (4, 2)]


def test_page_images_and_one_bad_page(spark, tmp_path):
    for folder, name, data in (("a", "17_2_1.png", b"xx"), ("b", "18_1_1.png", b"bad"), ("b", "note.txt", b"t")):
        (tmp_path / f"assessment={folder}").mkdir(exist_ok=True)
        (tmp_path / f"assessment={folder}" / name).write_bytes(data)
    images = pages.with_page_keys(pages.scan_page_images(spark, str(tmp_path), "*.png"))
    assert rows(images, "assessment", "submission", "question", "page_no", "length") == [("a", "17", 2, 1, 2), ("b", "18", 1, 1, 3)]

    def recognise(batch):
        if any(bytes(x) == b"bad" for x in batch["content"]):
            raise ValueError("unreadable")
        return pd.DataFrame({"submission": batch["submission"], "text": "read"})

    def failed(batch):
        return pd.DataFrame({"submission": batch["submission"], "text": [None]})

    got = pages.transcribe_pages(images.select("submission", "content").coalesce(1), recognise, "submission string, text string", failed)
    assert rows(got, "submission", "text") == [("17", "read"), ("18", None)]


def test_regrading_keeps_other_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, g string")
    sinks.write_grades(df, str(tmp_path / "g"), "g")
    sinks.write_grades(spark.createDataFrame([(3, "b")], "x int, g string"), str(tmp_path / "g"), "g")
    assert rows(spark.read.parquet(str(tmp_path / "g")), "x", "g") == [(1, "a"), (3, "b")]


def test_feedback_object(spark):
    df = spark.createDataFrame([(1, "see")], "s int, feedback string")
    assert sinks.feedback_json(df, "s").first()["value"] == '{"s":1,"feedback":"see"}'


def test_missing_mark_earns_nothing(spark):
    marks = spark.createDataFrame([(1, None), (1, 10.0), (2, None)], "s int, m double")
    assert rows(grading.weighted_score(marks, ["s"], "m", F.lit(1.0), 40.0), "s", "score") == [(1, 0.125), (2, 0.0)]


def test_answers_without_a_key_have_no_mark(spark):
    given = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "q int, t string")
    key = spark.createDataFrame([(1, "a"), (2, "x"), (4, "y")], "q int, k string")
    assert rows(grading.grade_exact(given, key, "q", "t", "k"), "q", "mark") == [(1, 1.0), (2, 0.0), (3, None), (4, 0.0)]
    assert rows(grading.grade_edit_distance(given, key, "q", "t", "k"), "q", "credit") == [(1, 1.0), (2, 0.0), (3, None), (4, None)]


def test_exemplars_without_a_vector_take_no_part(spark):
    points = [("a", [1.0, 0.0], "x"), ("b", None, "y"), ("c", [1.0, None], "y"), ("d", [], "y"), ("e", [1.0, 0.0, 5.0], "y"), ("f", [0.5, 0.0], "z")]
    df = spark.createDataFrame(points, "id string, v array<double>, lab string")
    got = rows(grading.grade_by_exemplar(df, df.filter("id <> 'f'"), 1, "id", "v", "lab"), "id", "predicted", "votes")
    assert got == [("a", "x", 1), ("e", "y", 1), ("f", "x", 1)]


def test_cutoffs_without_scores(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (2.0, 1), (None, 1), (3.0, None)], "x double, h int")
    assert rows(reports.cutoff_sweep(df, "x", "h"), "cutoff", "flagged", "precision") == [(1.0, 3, pytest.approx(2 / 3)), (2.0, 2, 0.5)]
    assert reports.cutoff_sweep(df.limit(0), "x", "h").count() == 0


def test_places_with_ties_and_nulls_equal_windows(spark):
    from pyspark.sql import Window

    data = [(s, x, i) for i, (s, x) in enumerate([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), (None, 3.0), (None, 3.0), ("b", 5.0), *[("c", float(i % 9)) for i in range(50)]])]
    df = spark.createDataFrame(data, "s string, x double, k int")
    best, settled = Window.partitionBy("s").orderBy(F.col("x").desc()), Window.partitionBy("s").orderBy(F.col("x").desc(), "k")
    expected = df.select("s", "x", "k", F.rank().over(best).alias("place"), F.dense_rank().over(best).alias("dense_place"), F.percent_rank().over(best).alias("percent_place"), F.ntile(4).over(settled).alias("quarter"))
    assert sorted(map(repr, map(tuple, reports.rank_students(df, "s", "x", "k").collect()))) == sorted(map(repr, map(tuple, expected.collect())))


def test_quartiles_of_missing_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), (None, 7.0), ("c", None)], "g string, x double")
    got = {r["g"]: (r["n"], r["q1"], r["median"], r["q3"]) for r in reports.score_distribution(df, "g", "x").collect()}
    assert got == {"a": (3, 1.5, 2.0, 3.0), None: (1, 7.0, 7.0, 7.0), "c": (0, None, None, None)}


def test_numbers_and_points(spark):
    df = spark.createDataFrame([("x1.5 1.2.3 10for a10 3e5 .5",)], "t string")
    got = answers.c_token_counts(df, "t").first()
    # x1 . 5 | 1.2 . 3 | 10 for | a10 | 3 e5 | . 5
    assert (got["identifiers"], got["keywords"], got["numbers"], got["punctuation"]) == (4, 1, 6, 3)


def test_messages_of_the_rubric(spark):
    marks = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0), (3, 1, 9.0)], "s int, c int, m double")
    rubric = spark.createDataFrame([(1, "use braces"), (2, "free memory")], "c int, message string")
    got = feedback.feedback_text(feedback.with_messages(marks, rubric, ["c"], "message"), ["s"], "c", F.col("m") < 5, F.col("message"))
    assert rows(got, "s", "feedback", "n_missed") == [(1, "use braces; free memory", 2), (2, "", 1)]


def test_scratch_tables_are_deleted(spark, tmp_path):
    from gradeloom.session import Scratch

    scratch = Scratch(spark, "t")
    kept, gone = scratch.write(spark.range(3), "kept"), scratch.write(spark.range(4), "gone")
    assert gone.count() == 4
    scratch.drop("gone")
    assert kept.count() == 3 and gone.inputFiles()
    with pytest.raises(Exception, match=r"(?i)not.exist|not found"):
        spark.read.parquet(f"{scratch.folder}/gone").count()


def test_a_cluster_names_its_shared_folder():
    from gradeloom import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
