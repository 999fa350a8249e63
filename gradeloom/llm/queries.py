"""One registered query for each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import conversation_repair, fingerprints, html_text, language_mixture, line_dedup, ngram_join, packing, periodic_runs, sentencepieces, token_files, toxicity, url_filters, vector_search
from gradeloom.llm.common import crc_fold
from gradeloom.llm.vocabularies import vocabulary
from gradeloom.session import Scratch
from gradeloom.sources.tables import table

URL_RULES = [
    url_filters.Rule("org", "/", "allow"),
    url_filters.Rule("example.org", "/es/", "block"),
    url_filters.Rule("example.org", "/en/1", "block"),
    url_filters.Rule("com", "/fr/", "allow"),
    url_filters.Rule("com", "/de/", "block"),
]


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k_inner_product(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    model = language_mixture.fit_languages(docs.filter(~held_out))
    found = language_mixture.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "other_share")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepieces.encode_and_decode(docs, vocabulary("piece_bpe_32k.model"))
    return sentencepieces.with_digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.jaccard_components(docs, ngram_join.Likeness(words=4, percent=85))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, unlabelled=docs.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), size=4096, end_id=2)


def with_repeated_ends(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the crc32 of their id (null: of nothing), end in copies of some of their words."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    hit = docs.withColumn("crc", crc).withColumn("words", F.when(F.col("crc") % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")))
    n = F.size("words")
    sized = hit.withColumn("n", n).withColumn("g", F.floor(F.col("crc") / 10)).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    sized = sized.withColumn("rest", F.col("n") - F.col("a")).withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    piece = F.slice("words", F.col("a") + 1, F.col("p"))
    copies = F.slice(F.flatten(F.array_repeat(piece, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), copies), " ")).otherwise(F.coalesce("text", F.lit("")))
    return sized.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(with_repeated_ends(docs))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # Greatest length, then smallest start, then smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    named = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.less")
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def damaged_turns(turns: DataFrame) -> DataFrame:
    """A quarter of the rows, by the crc32 of their conversation and turn, is dropped, emptied, cut, repeated or given to the user."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.withColumn("damage", kind).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_conversations(damaged_turns(turns), turns.select("conv_id"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = Scratch(spark, "token-files").folder
    token_files.write_token_files(docs, vocabulary("byte_bpe_50k.json"), folder, end_id=0)
    return token_files.read_checksums(spark, folder)


QUERIES = {
    "op1_vector_search": op1_vector_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_html_text": op4_html_text,
    "op5_language_id": op5_language_id,
    "op6_fingerprints": op6_fingerprints,
    "op7_sentencepieces": op7_sentencepieces,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_files": op13_token_files,
    "pipeline": corpus_pipeline.run,
}

_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_vector_search": """
        WITH usable AS (
            SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), asked AS (
            SELECT DISTINCT vec_id AS query_id, v FROM usable WHERE vec_id % 50 = 0
        ), scored AS (
            SELECT q.query_id, q.v AS query, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM asked q JOIN usable c ON q.query_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored
        QUALIFY row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id) <= 5""",
    "op2_line_dedup": f"""
        WITH cut AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
        ), lines AS (
            SELECT doc_id, pos, parts[pos] AS line
            FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM cut)
        ), keyed AS (
            SELECT doc_id, pos, line, {_KEY} AS key FROM lines
        ), common AS (
            SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        ), judged AS (
            SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
        )
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op3_url_filters": """
        WITH cut AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), rules(rhost, rpath, rverdict) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                   ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        ), fits AS (
            SELECT page_id, host, path, rhost || rpath AS rule, rverdict
            FROM cut LEFT JOIN rules
              ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        )
        SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM fits
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, rule DESC) = 1""",
    # Equal sets are one class; classes that share a shingle are counted, and links are followed until nothing new is reached.
    "op8_ngram_join": f"""
        WITH RECURSIVE cut AS (
            SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), sets AS (
            SELECT doc_id, list_sort(list_distinct(list_zip(words, words[2:], words[3:], words[4:])[1:greatest(len(words) - 3, least(len(words), 1))])) AS held
            FROM cut
        ), classed AS (
            SELECT doc_id, held, CASE WHEN len(held) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY held) END AS class FROM sets
        ), classes AS (
            SELECT class, held FROM classed WHERE doc_id = class
        ), grams AS (
            SELECT class, len(held) AS size, unnest(held) AS gram FROM classes
        ), links AS (
            SELECT a.class AS one, b.class AS other
            FROM grams a JOIN grams b ON a.gram = b.gram AND a.class <> b.class
            WHERE 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size)
            GROUP BY a.class, b.class, a.size, b.size
            HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))
        ), reached(class, other) AS (
            SELECT class, class FROM classes
            UNION
            SELECT r.class, l.other FROM reached r JOIN links l ON r.other = l.one
        ), components AS (
            SELECT class, min(other) AS component_id FROM reached GROUP BY class
        )
        SELECT doc_id, CAST(len(held) AS BIGINT) AS n_shingles, component_id FROM classed JOIN components USING (class)""",
}
