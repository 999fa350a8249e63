"""Line dedup: drop lines that many documents share.

Lines are exploded and normalised, hashed to 128 bits, and counted by distinct
documents; lines over the threshold are dropped and the rest put together again by
position. Only hashes and positions are dealt by line; the text itself is shuffled once,
by document. The digests are written once, for counting and for dropping. Partial aggregation bounds what a very common line sends, and adaptive
execution splits its partition in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACES, Carried, ascii_lower, digest_columns
from gradeloom.session import materialize


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def exploded_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``row1 row2 doc pos line1 line2`` for each line with a key that is long enough."""
    row1, row2 = digest_columns(F.col("doc_id"), F.col("text"))
    lines = docs.select(row1.alias("row1"), row2.alias("row2"), F.col("doc_id").alias("doc"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("row1", "row2", "doc", "pos", line_key(F.col("line")).alias("key"))
    line1, line2 = digest_columns(F.col("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select("row1", "row2", "doc", "pos", line1.alias("line1"), line2.alias("line2"))


def common_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Hashes of the lines that at least ``min_docs`` distinct documents hold."""
    per_doc = lines.select("line1", "line2", "doc").distinct()
    return per_doc.groupBy("line1", "line2").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs).select("line1", "line2")


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Returns the documents with ``text`` shortened, and ``n_lines``, ``n_dropped``.

    A line's key is the line stripped of ASCII white space and with A-Z in lower case. Keys
    of at least ``min_chars`` code points found in at least ``min_docs`` distinct ``doc_id``
    lose all their lines. A null or empty text is one empty line and comes out as an empty
    text; so does a text that loses every line. Rows that share a ``doc_id`` count as one
    document, rows with a null ``doc_id`` too; every row is returned, repeated ones as often
    as they came. An input column named ``n_lines`` or ``n_dropped``, in any case of letters,
    is replaced; all others stay as they are. An empty table gives an empty result.
    """
    held = Carried(docs, ["doc_id", "text"], ["n_lines", "n_dropped"])
    lines = materialize(exploded_lines(held.df, min_chars), "line-digests")
    common = materialize(common_lines(lines, min_docs), "common-lines")
    dropped = lines.join(common, ["line1", "line2"], "left_semi").groupBy("row1", "row2").agg(F.collect_set("pos").alias("drop"))
    row1, row2 = digest_columns(F.col("doc_id"), F.col("text"))
    whole = held.df.select(row1.alias("row1"), row2.alias("row2"), *[x for x, _ in held.without("text")], split_lines(F.col("text")).alias("lines"))
    joined = whole.join(dropped, ["row1", "row2"], "left")
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(places, F.col("drop")), lambda place: F.col("lines")[place])
    text = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    n_dropped = F.coalesce(F.array_size("drop"), F.lit(0)).cast("long")
    columns = [text.alias(c) if x == "text" else F.col(x).alias(c) for x, c in held.rest]
    return joined.select(*columns, F.size("lines").cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))
