"""The registered queries of the assessment jobs, with their SQL.

The tables hold no handwriting and no marks, so each query runs its job on a table of the
same shape: an order stands for a submission, an order line for a mark, a conversation for
an answer's pages, a document for an answer, a part for a question bank item.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.text import C_KEYWORDS, C_PARTS, C_TOKENS
from gradeloom.operators import answers, copies, deadlines, feedback, grading, reports
from gradeloom.session import shared_dir, ship_package
from gradeloom.sources import pages, sinks
from gradeloom.sources.tables import table
from gradeloom.streaming import arrivals

NEWEST = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
BANDS = [("A", 300000.0, 1e12), ("B", 200000.0, 300000.0), ("C", 100000.0, 200000.0), ("D", 0.0, 100000.0)]


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = [F.col(c).desc() for c in NEWEST]
    return grading.latest_mark(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], newest)


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.weighted_score(latest_lines(spark, sf_dir), ["l_orderkey"], "l_quantity", 1 + F.col("l_linenumber"), 40.0)


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's nation and region: a submission with its section and subject."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def p00_flagship_score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = order_scores(spark, sf_dir).join(placed_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return reports.score_rollup(scores, ["r_name", "n_name"], "score")


def p01_scan_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page files are written from ``pages`` first, one folder for each host's last label."""
    source = table(spark, sf_dir, "pages").select(F.coalesce("html", F.lit("")).alias("value"), F.regexp_extract("url", r"://[^/?#]*\.([a-z]+)", 1).alias("assessment"))
    directory = _scratch(spark, "page-files")
    source.write.partitionBy("assessment").text(directory)
    files = pages.scan_page_images(spark, directory, "part-*")
    return files.groupBy("assessment").agg(F.sum("length").alias("n_bytes"), F.sum(F.octet_length("content")).alias("n_read"))


def p01b_page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation stands for a page file; files of other names have no keys."""
    name = F.when(F.col("turn") % 4 == 3, F.lit("cover.png")).otherwise(F.concat_ws("_", F.col("conv_id"), F.col("turn") % 3, F.concat(F.col("turn"), F.lit(".png"))))
    files = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("file:/scans/batch_1/"), name).alias("path"))
    return pages.with_page_keys(files).drop("path")


def p02_write_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are graded and written; then one partition is graded again."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    directory = _scratch(spark, "grades")
    sinks.write_grades(orders, directory, "o_orderpriority")
    again = orders.filter(F.col("o_orderpriority") == "1-URGENT").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    sinks.write_grades(again, directory, "o_orderpriority")
    back = spark.read.parquet(directory)
    return back.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


def p03_export_feedback_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = feedback.feedback_text(latest_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", F.col("l_quantity") < 25, _message())
    directory = _scratch(spark, "feedback")
    sinks.export_feedback_json(listed, directory)
    return spark.read.schema("l_orderkey bigint, feedback string, n_missed bigint").json(directory)


def p03b_feedback_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = feedback.feedback_text(latest_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", F.col("l_quantity") < 25, _message())
    return sinks.feedback_json(listed, "l_orderkey")


def _recognise(batch: pd.DataFrame) -> pd.DataFrame:
    """Stands for a recogniser: it reads the bytes' length."""
    size = batch["content"].map(len)
    return pd.DataFrame({"page_id": batch["page_id"], "text": size.astype(str), "confidence": 1 / (1 + size / 1000)})


def p04_transcribe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    images = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    return pages.transcribe_pages(images, _recognise, "page_id long, text string, confidence double")


def _recognise_or_fail(batch: pd.DataFrame) -> pd.DataFrame:
    """As ``_recognise``; it can't read a page whose number ends in 7."""
    bad = batch["page_id"][batch["page_id"] % 10 == 7]
    if len(bad):
        raise ValueError(f"page {bad.iloc[0]} is unreadable")
    return _recognise(batch)


def p04b_quarantined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts and failures as one table."""
    ship_package(spark)
    images = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])
    read, failed = pages.transcribe_with_quarantine(images, _recognise_or_fail, schema, "page_id")
    return read.withColumn("reason", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def p05_missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    expected = turns.groupBy("conv_id").agg(F.max("turn").alias("expected"))
    got = turns.filter(~((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1)))
    return answers.missing_pages(got, expected, ["conv_id"], "turn", "expected")


def p06_assemble_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = answers.assemble_answers(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text")
    return whole.select("conv_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "n_pages")


def p07_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return answers.review_queue(docs, 5, "source", "n_chars", "doc_id").select("source", "doc_id", "n_chars", F.col("place").cast("bigint").alias("place"))


def p08_normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = answers.normalize_answers(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", fold_case=False)
    return docs.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.length("text").cast("bigint").alias("n_chars"))


def p09_c_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.c_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


def _key(parts: DataFrame) -> DataFrame:
    return parts.groupBy("p_type").agg(F.min("p_name").alias("key_text"))


def p10_grade_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return grading.grade_exact(parts, _key(parts), "p_type", "p_name", "key_text").select("p_partkey", "p_type", "mark")


def p11_grade_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
    return grading.grade_edit_distance(parts, _key(parts), "p_type", "p_name", "key_text").select("p_partkey", "p_type", "credit")


def p12_rubric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return grading.rubric_coverage(docs, items, "doc_id", "text", "item_id", "passage", n=8, min_share=0.5)


def p13_grade_by_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return grading.grade_by_exemplar(vectors.filter("vec_id % 5 = 0"), vectors.filter("vec_id % 5 <> 0"), 5, "vec_id", "embedding", "label")


def p14_latest_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def p15_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_scores(spark, sf_dir)


def p16_grade_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "band string, low double, high double")
    return grading.grade_bands(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands)


def p16b_bands_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority has bands of its own: five of 80,000 with a gap before the last, which is open."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    step = F.explode(F.sequence(F.lit(0), F.lit(4)))
    steps = orders.select("o_orderpriority").distinct().select("o_orderpriority", step.alias("step"))
    low = F.col("step") * 80000.0 + F.length("o_orderpriority") * 1000.0
    high = F.when(F.col("step") < 4, low + F.when(F.col("step") == 3, 60000.0).otherwise(80000.0))
    bands = steps.select("o_orderpriority", F.concat(F.lit("band "), F.col("step").cast("string")).alias("band"), low.alias("low"), high.alias("high"))
    return grading.grade_bands(orders, "o_totalprice", bands, ["o_orderpriority"])


def p17_score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_rollup(placed_orders(spark, sf_dir), ["r_name", "n_name"], "o_totalprice")


def p18_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_distribution(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


def p18b_score_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_bins(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 25000.0)


def p18c_score_distribution_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_distribution(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", exact=False)


def p19_rank_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = placed_orders(spark, sf_dir).select("o_orderkey", "c_nationkey", "o_totalprice")
    return reports.rank_students(orders, "c_nationkey", "o_totalprice", "o_orderkey")


def p20_item_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.item_analysis(latest_lines(spark, sf_dir), "l_orderkey", "l_partkey", "l_quantity")


def p21_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return reports.agreement(pairs, (F.col("n_chars") >= 500).cast("int"), F.col("quality"))


def p22_cutoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return reports.cutoff_sweep(pairs, "n_chars", "quality")


def p23_ungraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ungraded(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


def p24_attempt_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return reports.attempt_delta(orders, "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def _message():
    return F.concat(F.lit("question "), F.col("l_linenumber").cast("string"), F.lit(": see part "), F.col("l_partkey").cast("string"))


def p25_feedback_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_text(latest_lines(spark, sf_dir), ["l_orderkey"], "l_linenumber", F.col("l_quantity") < 25, _message())


def p25b_feedback_from_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part's name is the rubric's message; parts of one brand have none."""
    rubric = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("revise "), F.col("p_name")).alias("message"))
    marked = feedback.with_messages(latest_lines(spark, sf_dir), rubric, ["l_partkey"], "message")
    return feedback.feedback_text(marked, ["l_orderkey"], "l_linenumber", F.col("l_quantity") < 25, F.col("message"))


def p26_common_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.common_faults(latest_lines(spark, sf_dir), "l_linenumber", "l_partkey", F.col("l_quantity") < 25, 5)


COPY_RULES = {"k": 10, "window": 6, "common": 10}


def p27_copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return copies.copy_pairs(docs, "doc_id", "text", **COPY_RULES, min_shared=4, min_share=0.5)


def p27b_copy_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return copies.copy_classes(docs, "doc_id", "text", **COPY_RULES)


def p28_streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages arrive in three steps; between them the stream ends and starts again from its checkpoint."""
    folder = _scratch(spark, "arrivals")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    # Pages of one answer arrive in different steps.
    for step in range(3):
        turns.filter(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == step).write.mode("append").parquet(f"{folder}/in")
        store = arrivals.AnswerStore(spark, folder, ["conv_id"], "turn", "text", buckets=8)
        arrivals.keep_answers(arrivals.read_arrivals(spark, f"{folder}/in", turns.schema), store, f"{folder}/checkpoint").awaitTermination()
    return store.answers().select("conv_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "n_pages")


def p28b_streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive day by day in three steps, and are counted by six hours and kind."""
    folder = _scratch(spark, "counts")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("arrived_at"), "event_type")
    part = F.when(F.dayofmonth("arrived_at") <= 10, 0).when(F.dayofmonth("arrived_at") <= 20, 1).otherwise(2)
    for step in range(3):
        events.filter(part == step).write.mode("append").parquet(f"{folder}/in")
        stream = arrivals.read_arrivals(spark, f"{folder}/in", events.schema)
        counts = arrivals.arrivals_by_window(stream, ["event_type"], "arrived_at", "2 days", "6 hours")
        arrivals.keep_counts(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    found = arrivals.latest_counts(spark, f"{folder}/counts", ["event_type"])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def p29_late_penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an attempt by its customer at the assessment of its priority.

    The deadline announced with the first order of a month is twelve days later. Every seventh order
    is an extension for its customer from five days before it to five days after, or for ever.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    announced = orders.groupBy("o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.min("o_orderdate").alias("effective_from"))
    due = announced.select("o_orderpriority", "effective_from", F.expr("effective_from + interval 12 days").alias("deadline"))
    until = F.when(F.col("o_orderkey") % 14 != 0, F.expr("o_orderdate + interval 5 days"))
    extended = orders.filter(F.col("o_orderkey") % 7 == 0).select(
        "o_orderpriority", "o_custkey", F.expr("o_orderdate - interval 5 days").alias("valid_from"), until.alias("valid_to"), (1 + F.col("o_orderkey") % 4).cast("int").alias("days")
    )
    placed = deadlines.effective_deadlines(orders, due, extended, "o_orderpriority", "o_custkey", "o_orderdate")
    return deadlines.late_penalties(placed, "o_totalprice", "o_orderdate", 0.1, 0.5)


QUERIES = {name: job for name, job in list(globals().items()) if name[:1] == "p" and name[1:3].isdigit()}

_LATEST = """latest AS (
    SELECT * FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) = 1)"""
_SCORES = """scores AS (
    SELECT l_orderkey, sum(CASE WHEN l_quantity IS NULL THEN 0 ELSE least(l_quantity, 40.0) END * (1 + l_linenumber)) / nullif(sum(40.0 * (1 + l_linenumber)), 0) AS score
    FROM latest GROUP BY l_orderkey)"""
_PLACED = """placed AS (
    SELECT o_orderkey, o_totalprice, c_nationkey, n_name, r_name FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_FEEDBACK = f"""
    WITH {_LATEST}
    SELECT l_orderkey, string_agg('question ' || l_linenumber || ': see part ' || l_partkey, '; ' ORDER BY l_linenumber) AS feedback,
           count(*) AS n_missed
    FROM latest WHERE l_quantity < 25 GROUP BY l_orderkey"""
_KEYED = """keys AS (SELECT p_type, min(p_name) AS key_text FROM part GROUP BY p_type),
    keyed AS (SELECT p_partkey, p_type, p_name, key_text FROM part LEFT JOIN keys USING (p_type))"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _grams(source: str, key: str) -> str:
    words = f"SELECT {key}, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM {source}"
    starts = f"SELECT {key}, words, unnest(range(1, len(words) - 6)) AS i FROM ({words}) WHERE len(words) >= 8"
    return f"SELECT DISTINCT {key}, array_to_string(words[i:i+7], ' ') AS gram FROM ({starts})"


_PRINTS = f"""cut AS (
        SELECT doc_id, array_to_string([CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN ' ' ELSE x END
                                        FOR x IN regexp_extract_all(text, {_quoted(C_PARTS)})], '') AS kept FROM documents
    ), tokens AS (
        SELECT doc_id, [CASE WHEN length(x) > 1 AND x[1] IN ('"', chr(39)) THEN '"'
                             WHEN regexp_matches(x, '^[A-Za-z_]') AND x NOT IN ({", ".join(map(_quoted, C_KEYWORDS))}) THEN 'v'
                             WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE x END
                        FOR x IN regexp_extract_all(coalesce(kept, ''), {_quoted(f"{copies.LITERAL}|{C_TOKENS}")})] AS t FROM cut
    ), hashed AS (
        SELECT doc_id, [CAST('0x' || substr(md5(array_to_string(t[i:i + 9], ' ')), 1, 15) AS BIGINT) FOR i IN range(1, greatest(len(t) - 8, 1))] AS h FROM tokens
    ), prints AS (
        SELECT doc_id, CASE WHEN len(h) = 0 THEN CAST([] AS BIGINT[])
                            ELSE list_sort(list_distinct([list_min(h[i:i + 5]) FOR i IN range(1, greatest(len(h) - 5, 1) + 1)])) END AS p FROM hashed
    ), leaders AS (SELECT p, min(doc_id) AS class_id FROM prints WHERE len(p) > 0 GROUP BY p),
    held AS (SELECT class_id, unnest(p) AS print FROM leaders),
    often AS (SELECT print, count(*) > 10 AS is_common FROM held GROUP BY print)"""

SQL = {
    "p00_flagship_score_report": f"""
        WITH {_LATEST}, {_SCORES}, {_PLACED}
        SELECT r_name, n_name, count(*) AS n, avg(score) AS mean_score,
               CAST(grouping(r_name) AS INTEGER) AS all_r_name, CAST(grouping(n_name) AS INTEGER) AS all_n_name
        FROM scores JOIN placed ON l_orderkey = o_orderkey GROUP BY ROLLUP (r_name, n_name)""",
    "p01_scan_page_images": """
        SELECT assessment, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum(n) AS BIGINT) AS n_read FROM (
            SELECT regexp_extract(url, '://[^/?#]*\\.([a-z]+)', 1) AS assessment, octet_length(encode(coalesce(html, ''))) + 1 AS n FROM pages)
        GROUP BY assessment""",
    "p01b_page_keys": """
        SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN CAST(conv_id AS VARCHAR) END AS submission,
               CASE WHEN turn % 4 <> 3 THEN CAST(turn % 3 AS INTEGER) END AS question, CASE WHEN turn % 4 <> 3 THEN CAST(turn AS INTEGER) END AS page_no
        FROM conversations""",
    "p02_write_grades": """
        SELECT o_orderpriority, count(*) AS n, sum(o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS total
        FROM orders GROUP BY o_orderpriority""",
    "p03_export_feedback_json": _FEEDBACK,
    "p03b_feedback_json": f"""
        SELECT l_orderkey, '{{"l_orderkey":' || l_orderkey || ',"feedback":' || to_json(feedback) || ',"n_missed":' || n_missed || '}}' AS value FROM ({_FEEDBACK})""",
    "p04_transcribe_pages": """
        SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS text,
               1 / (1 + CAST(octet_length(encode(coalesce(html, ''))) AS DOUBLE) / 1000) AS confidence FROM pages""",
    "p04b_quarantined_pages": """
        SELECT page_id, CASE WHEN page_id % 10 <> 7 THEN CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) END AS text,
               CASE WHEN page_id % 10 <> 7 THEN 1 / (1 + CAST(octet_length(encode(coalesce(html, ''))) AS DOUBLE) / 1000) END AS confidence,
               CASE WHEN page_id % 10 = 7 THEN 'ValueError: page ' || page_id || ' is unreadable' END AS reason FROM pages""",
    "p05_missing_pages": """
        WITH wanted AS (SELECT conv_id, unnest(range(1, max(turn) + 1)) AS turn FROM conversations GROUP BY conv_id),
             got AS (SELECT conv_id, turn FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1))
        SELECT conv_id, turn FROM wanted ANTI JOIN got USING (conv_id, turn)""",
    "p06_assemble_answers": """
        SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text), '')) AS text_md5, count(text) AS n_pages
        FROM conversations GROUP BY conv_id""",
    "p07_review_queue": """
        SELECT source, doc_id, n_chars, place FROM (
            SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS place FROM documents)
        WHERE place <= 5""",
    "p08_normalize_answer": f"""
        WITH cut AS (
            SELECT doc_id, array_to_string([CASE WHEN starts_with(x, '//') OR starts_with(x, '/*') THEN ' ' ELSE x END
                                            FOR x IN regexp_extract_all(text, {_quoted(C_PARTS)})], '') AS kept FROM documents
        ), short AS (SELECT doc_id, trim(regexp_replace(kept, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM cut)
        SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM short""",
    "p09_c_token_counts": f"""
        WITH cut AS (SELECT doc_id, regexp_extract_all(text, {_quoted(C_TOKENS)}) AS tokens FROM documents)
        SELECT doc_id, CAST(len([x FOR x IN tokens IF regexp_matches(x, '^[A-Za-z_]')]) AS BIGINT) AS identifiers,
               CAST(len([x FOR x IN tokens IF x IN ({", ".join(map(_quoted, C_KEYWORDS))})]) AS BIGINT) AS keywords,
               CAST(len([x FOR x IN tokens IF regexp_matches(x, '^[0-9]')]) AS BIGINT) AS numbers,
               CAST(len([x FOR x IN tokens IF regexp_matches(x, '^[^A-Za-z0-9_]')]) AS BIGINT) AS punctuation
        FROM cut""",
    "p10_grade_exact": f"WITH {_KEYED} SELECT p_partkey, p_type, CASE WHEN p_name = key_text THEN 1.0::DOUBLE WHEN key_text IS NOT NULL THEN 0.0::DOUBLE END AS mark FROM keyed",
    "p11_grade_edit_distance": f"""
        WITH {_KEYED}
        SELECT p_partkey, p_type, CASE WHEN p_name IS NOT NULL AND key_text IS NOT NULL THEN
               greatest(0.0::DOUBLE, 1 - levenshtein(p_name, key_text)::DOUBLE / greatest(length(p_name), length(key_text), 1)) END AS credit
        FROM keyed""",
    "p12_rubric_coverage": f"""
        WITH items AS ({_grams("benchmark", "item_id")}), found AS ({_grams("documents", "doc_id")}),
             totals AS (SELECT item_id, count(*) AS grams_total FROM items GROUP BY item_id)
        SELECT doc_id, item_id, grams_total, count(*) AS grams_found, count(*)::DOUBLE / grams_total AS share
        FROM found JOIN items USING (gram) JOIN totals USING (item_id)
        GROUP BY doc_id, item_id, grams_total HAVING count(*)::DOUBLE / grams_total >= 0.5""",
    "p13_grade_by_exemplar": """
        WITH near AS (
            SELECT q.vec_id, e.label, row_number() OVER (PARTITION BY q.vec_id
                       ORDER BY list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) DESC, e.vec_id) AS place
            FROM embeddings q JOIN embeddings e ON q.vec_id % 5 = 0 AND e.vec_id % 5 <> 0
        ), votes AS (SELECT vec_id, label, count(*) AS votes FROM near WHERE place <= 5 GROUP BY vec_id, label)
        SELECT vec_id, label AS predicted, votes FROM votes
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY votes DESC, label) = 1""",
    "p14_latest_mark": f"WITH {_LATEST} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM latest",
    "p15_weighted_score": f"WITH {_LATEST}, {_SCORES} SELECT l_orderkey, score FROM scores",
    "p16_grade_bands": f"""
        SELECT o_orderkey, o_totalprice,
               CASE {" ".join(f"WHEN o_totalprice >= {low:.1f} AND o_totalprice < {high:.1f} THEN '{name}'" for name, low, high in BANDS)} END AS band
        FROM orders""",
    "p16b_bands_by_section": """
        WITH steps AS (SELECT o_orderpriority, unnest(range(5)) AS step FROM (SELECT DISTINCT o_orderpriority FROM orders)),
        bands AS (SELECT o_orderpriority, 'band ' || step AS band, step * 80000.0 + length(o_orderpriority) * 1000.0 AS low,
                         CASE WHEN step = 4 THEN 1e300 WHEN step = 3 THEN 60000.0 ELSE 80000.0 END AS width FROM steps)
        SELECT o_orderkey, orders.o_orderpriority, o_totalprice, band FROM orders LEFT JOIN bands
          ON orders.o_orderpriority = bands.o_orderpriority AND o_totalprice >= low AND o_totalprice < low + width""",
    "p17_score_rollup": f"""
        WITH {_PLACED}
        SELECT r_name, n_name, count(*) AS n, avg(o_totalprice) AS mean_score,
               CAST(grouping(r_name) AS INTEGER) AS all_r_name, CAST(grouping(n_name) AS INTEGER) AS all_n_name
        FROM placed GROUP BY ROLLUP (r_name, n_name)""",
    "p18_score_distribution": """
        SELECT o_orderpriority, count(o_totalprice) AS n, min(o_totalprice) AS least, quantile_cont(o_totalprice, 0.25) AS q1,
               quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS most,
               stddev_samp(o_totalprice) AS sd, avg(o_totalprice) AS mean_score
        FROM orders GROUP BY o_orderpriority""",
    # The sketch is exact while a group has fewer rows than its accuracy, 10,000.
    "p18c_score_distribution_sketched": """
        SELECT o_orderpriority, count(o_totalprice) AS n, min(o_totalprice) AS least, quantile_disc(o_totalprice, 0.25) AS q1,
               quantile_disc(o_totalprice, 0.5) AS median, quantile_disc(o_totalprice, 0.75) AS q3, max(o_totalprice) AS most,
               stddev_samp(o_totalprice) AS sd, avg(o_totalprice) AS mean_score
        FROM orders GROUP BY o_orderpriority""",
    "p18b_score_bins": "SELECT o_orderpriority, CAST(floor(o_totalprice / 25000.0) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY ALL",
    "p19_rank_students": f"""
        WITH {_PLACED}
        SELECT o_orderkey, c_nationkey, o_totalprice, rank() OVER best AS place, dense_rank() OVER best AS dense_place,
               percent_rank() OVER best AS percent_place, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter
        FROM placed WINDOW best AS (PARTITION BY c_nationkey ORDER BY o_totalprice DESC)""",
    "p20_item_analysis": f"""
        WITH {_LATEST}, rest AS (
            SELECT l_partkey, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) - l_quantity AS others FROM latest WHERE l_quantity IS NOT NULL
        ), varied AS (
            SELECT l_partkey FROM rest GROUP BY l_partkey HAVING min(l_quantity) < max(l_quantity) AND min(others) < max(others)
        ), fits AS (SELECT l_partkey, corr(l_quantity, others) AS discrimination FROM rest SEMI JOIN varied USING (l_partkey) GROUP BY l_partkey)
        SELECT l_partkey, n, difficulty, discrimination
        FROM (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS difficulty FROM rest GROUP BY l_partkey) LEFT JOIN fits USING (l_partkey)""",
    "p21_agreement": """
        WITH pairs AS (SELECT CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS a, quality AS b FROM labels JOIN documents USING (doc_id)
                       WHERE n_chars IS NOT NULL AND quality IS NOT NULL),
        c AS (SELECT count(*) FILTER (WHERE a = 0 AND b = 0) AS n00, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01,
                     count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11, count(*)::DOUBLE AS n FROM pairs),
        r AS (SELECT *, (n00 + n11) / n AS agreement, ((n10 + n11) * (n01 + n11) + (n00 + n01) * (n00 + n10)) / (n * n) AS chance FROM c)
        SELECT n00, n01, n10, n11, agreement, (agreement - chance) / nullif(1 - chance, 0) AS kappa FROM r""",
    "p22_cutoff_sweep": """
        WITH counted AS (SELECT n_chars AS cutoff, count(*) AS n, sum(quality) AS good FROM labels JOIN documents USING (doc_id)
                         WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY n_chars)
        SELECT cutoff, CAST(sum(n) OVER above AS BIGINT) AS flagged, (sum(good) OVER above)::DOUBLE / (sum(n) OVER above)::DOUBLE AS precision
        FROM counted WINDOW above AS (ORDER BY cutoff DESC ROWS UNBOUNDED PRECEDING)""",
    "p23_ungraded": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "p24_attempt_delta": """
        SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER w AS attempt, o_totalprice - lag(o_totalprice) OVER w AS change,
               max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "p25_feedback_text": _FEEDBACK,
    "p25b_feedback_from_rubric": f"""
        WITH {_LATEST}, marked AS (
            SELECT l_orderkey, l_linenumber, 'revise ' || p_name AS message FROM latest
            LEFT JOIN (SELECT * FROM part WHERE p_brand <> 'Brand#13') ON l_partkey = p_partkey WHERE l_quantity < 25)
        SELECT l_orderkey, coalesce(string_agg(message, '; ' ORDER BY l_linenumber), '') AS feedback, count(*) AS n_missed FROM marked GROUP BY l_orderkey""",
    "p26_common_faults": f"""
        WITH {_LATEST}, counted AS (SELECT l_linenumber, l_partkey, count(*) AS n_missed FROM latest WHERE l_quantity < 25 GROUP BY ALL)
        SELECT l_linenumber, l_partkey, n_missed, place FROM (
            SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY n_missed DESC, l_partkey) AS place FROM counted)
        WHERE place <= 5""",
    "p27_copy_pairs": f"""
        WITH {_PRINTS}, rare AS (SELECT class_id, print FROM held JOIN often USING (print) WHERE NOT is_common),
        sizes AS (SELECT class_id, count(*) AS n FROM rare GROUP BY class_id),
        shared AS (SELECT a.class_id AS class_a, b.class_id AS class_b, count(*) AS shared FROM rare a JOIN rare b ON a.print = b.print AND a.class_id < b.class_id GROUP BY ALL)
        SELECT class_a, class_b, a.n AS prints_a, b.n AS prints_b, shared, shared::DOUBLE / least(a.n, b.n) AS share
        FROM shared JOIN sizes a ON class_a = a.class_id JOIN sizes b ON class_b = b.class_id
        WHERE shared >= 4 AND shared::DOUBLE / least(a.n, b.n) >= 0.5""",
    "p27b_copy_classes": f"""
        WITH {_PRINTS}, counted AS (SELECT class_id, count(*) FILTER (WHERE is_common) AS n_common FROM held JOIN often USING (print) GROUP BY class_id)
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, len(p) AS n_prints, coalesce(n_common, 0) AS n_common
        FROM prints LEFT JOIN leaders USING (p) LEFT JOIN counted USING (class_id)""",
    "p28_streamed_answers": """
        SELECT conv_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text), '')) AS text_md5, count(text) AS n_pages
        FROM conversations GROUP BY conv_id""",
    "p28b_streamed_counts": """
        SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""",
    "p29_late_penalties": """
        WITH due AS (
            SELECT o_orderpriority, min(o_orderdate) AS effective_from, min(o_orderdate) + INTERVAL 12 DAYS AS deadline
            FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)
        ), extended AS (
            SELECT o_orderpriority, o_custkey, o_orderdate - INTERVAL 5 DAYS AS valid_from,
                   CASE WHEN o_orderkey % 14 <> 0 THEN o_orderdate + INTERVAL 5 DAYS END AS valid_to, 1 + o_orderkey % 4 AS days
            FROM orders WHERE o_orderkey % 7 = 0
        ), longest AS (
            SELECT o.o_orderkey, max(days) AS days FROM orders o JOIN extended e ON o.o_orderpriority = e.o_orderpriority AND o.o_custkey = e.o_custkey
               AND e.valid_from <= o.o_orderdate AND (e.valid_to IS NULL OR o.o_orderdate < e.valid_to) GROUP BY o.o_orderkey
        ), placed AS (
            SELECT o.*, deadline, coalesce(days, 0)::INTEGER AS extra_days FROM orders o
            ASOF LEFT JOIN due d ON o.o_orderpriority = d.o_orderpriority AND o.o_orderdate >= d.effective_from
            LEFT JOIN longest USING (o_orderkey)
        ), late AS (
            SELECT *, greatest(ceil((epoch(o_orderdate) - epoch(deadline) - extra_days * 86400) / 86400), 0)::BIGINT AS days_late FROM placed
        )
        SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, o_totalprice, deadline, extra_days, days_late,
               least(days_late * 0.1::DOUBLE, 0.5::DOUBLE) AS penalty, o_totalprice * (1 - least(days_late * 0.1::DOUBLE, 0.5::DOUBLE)) AS final_score FROM late""",
}
