"""Column functions on answers written in C and in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The keywords of C.
C_KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if "
    "inline int long register restrict return short signed sizeof static struct switch typedef "
    "union unsigned void volatile while"
).split()
#: String and character literals, comments, and all the rest.
C_PARTS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|[^"\'/]+|["\'/]'
C_IDENTIFIER, C_PUNCTUATION = r"[A-Za-z_][A-Za-z0-9_]*", r"[!-/:-@\[-^`{-~]"
#: Numbers begin where no identifier goes on; those with a fraction hold a point that is no punctuation.
C_NUMBER, C_FRACTION = r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)?", r"(?<![A-Za-z0-9_])[0-9]+\.[0-9]+"
C_TOKENS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[!-/:-@\[-^`{-~]"


def without_comments(text: Column) -> Column:
    """C source with each comment replaced by a space; literals that look like one are kept."""
    parts = F.regexp_extract_all(text, F.lit(C_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("//") | (x.startswith("/*")), F.lit(" ")).otherwise(x)), "")


def normalize_answer(text: Column, fold_case: bool = True) -> Column:
    """Comments out, runs of white space to one space, ends trimmed, case folded if asked for."""
    short = F.trim(F.regexp_replace(without_comments(text), r"[ \t\n\r\f\x0B]+", " "))
    return F.lower(short) if fold_case else short


def c_identifiers(text: Column) -> Column:
    """Keywords and names. They are among the tokens wherever they stand: a number takes no letter."""
    return F.regexp_extract_all(text, F.lit(C_IDENTIFIER), F.lit(0))


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_ngrams(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``key gram1 gram2``: every run of ``n`` words of each text, as two 64-bit digests.

    The words are found once for each text, before the rows are multiplied.
    """
    words = df.select(key, words_of(F.col(text)).alias("_words")).filter(F.size("_words") >= n)
    placed = words.select(key, "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - (n - 1))).alias("_at"))
    grams = placed.select(key, F.slice("_words", F.col("_at"), F.lit(n)).alias("_gram"))
    return grams.select(key, F.xxhash64("_gram").alias("gram1"), F.xxhash64(F.lit("second"), "_gram").alias("gram2"))


def edit_credit(answer: Column, key: Column) -> Column:
    """1 for equal texts, less with every slip, 0 at the least; null where either is missing."""
    longer = F.greatest(F.length(answer), F.length(key), F.lit(1))
    credit = F.greatest(F.lit(0.0), 1 - F.levenshtein(answer, key) / longer)
    return F.when(answer.isNotNull() & key.isNotNull(), credit)
