"""Streams of pages: restarts, batches that run twice, pages sent again, late rows."""

from datetime import datetime, timedelta

from gradeloom.operators.answers import assemble_answers
from gradeloom.streaming import arrivals

SCHEMA = "answer long, page int, text string, arrived_at timestamp"
START = datetime(2024, 5, 1)


def page(spark, rows, folder):
    given = [(a, p, t, START + timedelta(hours=h)) for a, p, t, h in rows]
    spark.createDataFrame(given, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stored(store):
    return sorted((r["answer"], r["text"], r["n_pages"]) for r in store.answers().collect())


def test_three_steps_and_restarts_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path)
    steps = [[(1, 2, "b", 0), (2, 1, "x", 0)], [(1, 1, "a", 1), (3, 1, None, 1)], [(2, 2, "y", 2), (1, 3, "c", 2)]]
    for step in steps:
        page(spark, step, f"{folder}/in")
        store = arrivals.AnswerStore(spark, folder, ["answer"], "page", "text", buckets=4)
        arrivals.keep_answers(arrivals.read_arrivals(spark, f"{folder}/in", SCHEMA), store, f"{folder}/checkpoint").awaitTermination()
    batch = assemble_answers(spark.read.schema(SCHEMA).parquet(f"{folder}/in"), ["answer"], "page", "text")
    assert stored(store) == sorted((r["answer"], r["text"], r["n_pages"]) for r in batch.collect())
    # Started again without new pages, nothing changes.
    arrivals.keep_answers(arrivals.read_arrivals(spark, f"{folder}/in", SCHEMA), store, f"{folder}/checkpoint").awaitTermination()
    assert stored(store) == [(1, "a\nb\nc", 3), (2, "x\ny", 2), (3, "", 0)]


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    store = arrivals.AnswerStore(spark, str(tmp_path), ["answer"], "page", "text", buckets=4)
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "x")], "answer long, page int, text string")
    second = spark.createDataFrame([(1, 2, "b")], "answer long, page int, text string")
    store.write_batch(first, 0)
    store.write_batch(second, 1)
    once = stored(store)
    store.write_batch(second, 1)
    assert stored(store) == once == [(1, "a\nb", 2), (2, "x", 1)]
    store.write_batch(first.limit(0), 2)
    assert stored(store) == once


def test_a_page_that_comes_in_a_later_batch_replaces_the_earlier_one(spark, tmp_path):
    store = arrivals.AnswerStore(spark, str(tmp_path), ["answer"], "page", "text", buckets=2)
    schema = "answer long, page int, text string"
    store.write_batch(spark.createDataFrame([(1, 1, "blurred"), (1, 2, "b")], schema), 0)
    store.write_batch(spark.createDataFrame([(1, 1, "a")], schema), 1)
    assert stored(store) == [(1, "a\nb", 2)]


def test_pages_sent_again_within_the_delay_are_dropped(spark, tmp_path):
    folder = str(tmp_path)
    for rows in ([(1, 1, "a", 0), (1, 1, "a again", 0)], [(1, 1, "a third time", 1), (1, 2, "b", 1)]):
        page(spark, rows[:1], f"{folder}/in")
        page(spark, rows[1:], f"{folder}/in")
        store = arrivals.AnswerStore(spark, folder, ["answer"], "page", "text", buckets=2)
        stream = arrivals.distinct_pages(arrivals.read_arrivals(spark, f"{folder}/in", SCHEMA, 1), ["answer"], "page", "arrived_at", "1 day")
        arrivals.keep_answers(stream, store, f"{folder}/checkpoint").awaitTermination()
    found = stored(store)
    assert [x[2] for x in found] == [2] and found[0][1].endswith("\nb") and "third" not in found[0][1]


def test_counts_take_late_rows_until_the_watermark(spark, tmp_path):
    folder = str(tmp_path)
    steps = [[(1, 1, "a", 0), (1, 2, "a", 1)], [(2, 1, "b", 30)], [(1, 3, "late", 26), (1, 4, "too late", 2)]]
    for step in steps:
        page(spark, step, f"{folder}/in")
        counts = arrivals.arrivals_by_window(arrivals.read_arrivals(spark, f"{folder}/in", SCHEMA), ["answer"], "arrived_at", "10 hours", "6 hours")
        arrivals.keep_counts(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    got = sorted(((r["window_start"] - START).total_seconds() / 3600, r["answer"], r["n"]) for r in arrivals.latest_counts(spark, f"{folder}/counts", ["answer"]).collect())
    assert got == [(0, 1, 2), (24, 1, 1), (30, 2, 1)]
