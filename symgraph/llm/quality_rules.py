"""Line-first quality rules, in DataFrame operations only.

Each line is judged alone (punctuation and symbols, navigation, boilerplate, shouting, no letters); failing lines go, and a document that
loses too much of its words with them is rejected. Base figures of the whole text come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

_SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Marks between the links of a navigation line.
SEPARATORS = "[|»•·]"
#: A line is boilerplate if it is short and says nothing else.
BOILERPLATE = r"(?i)(licensed under|all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|copyright (\(c\)|©)|permission is hereby granted|subscribe to our|click here|javascript)"
NAVIGATION = r"(?i)^\s*(home|menu|about( us)?|contact( us)?|login|log in|sign (in|up)|search|next|previous|share|tweet|read more|back to top)(\s*[|>/»·-]\s*.{0,40})*\s*$"


def _repeated(words: Column) -> Column:
    """Words in a three-word window found twice or more: equal windows meet when hashes are sorted, then their words count once."""
    n = F.size(words)
    grams = F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")))
    return F.sort_array(grams)


def rules(docs: DataFrame, min_words: int = 50, max_repeat: float = 0.5, symbol_share: float = 0.1, lost_share: float = 0.5, boilerplate_words: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, n_lines_kept, words_kept, cleaned.

    A null or empty text has no words, fails the base and isn't kept. Repeated rows are judged alike. Nothing is
    shuffled: a document is judged within its row, in about n log n of its words.
    """
    rows = docs.select(F.col("doc_id"), text_of().alias("text"))
    words = F.filter(F.split("text", _SPACES), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, _SPACES, "") != ""))
    rows = rows.withColumn("n_words", F.size("words").cast("long")).withColumn("grams", _repeated(F.col("words")))
    g = F.col("grams")
    again = F.filter(g, lambda x, k: (x["g"] == F.get(g, k + 1)["g"]) | (x["g"] == F.get(g, k - 1)["g"]))
    starts = F.transform(again, lambda x: x["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))
    rows = rows.withColumn("n_repeat_words", F.when(F.col("n_words") < 3, 0).otherwise(covered).cast("long"))
    symbols = lambda t: F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))
    n_words = lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+"))
    failed = lambda x: (symbols(x) > F.lit(symbol_share) * F.length(x)) | x.rlike(NAVIGATION) | (3 * F.regexp_count(x, F.lit(SEPARATORS)) >= n_words(x)) | (x.rlike(BOILERPLATE) & (n_words(x) <= boilerplate_words)) | ~x.rlike(r"\p{L}") | (F.length(F.regexp_replace(x, r"[^\p{Lu}]", "")) > 0.5 * F.length(F.regexp_replace(x, r"[^\p{L}]", ""))) & (n_words(x) >= 5)
    rows = rows.withColumn("kept_lines", F.filter("lines", lambda x: ~failed(x)))
    rows = rows.withColumn("cleaned", F.array_join("kept_lines", "\n")).withColumn("words_kept", n_words(F.col("cleaned")).cast("long"))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > int(100 * max_repeat) * F.col("n_words"))
    kept = ~base_failed & (F.col("words_kept") >= (1 - lost_share) * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", F.length(F.regexp_replace("text", _SPACES, "")).cast("long").alias("word_chars"), symbols(F.col("text")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), F.size("kept_lines").cast("long").alias("n_lines_kept"), "words_kept", "cleaned",
    )
