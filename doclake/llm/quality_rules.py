"""Line-first quality rules.

Native: built-in column functions only, row by row, no shuffle. Every line is judged on its own (symbols, navigation, shouting,
boilerplate, repetition); failing lines are removed, and a document that loses too much of its text goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.frames import computed, let

SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Words of which a document needs at least so many, and the largest percentage of them in repeated windows.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A line fails with more symbols than this percentage of its words, ...
SYMBOL_PERCENT = 30
#: ... as navigation with so many separators and more than this percentage of its words being separators, ...
NAVIGATION_MIN, NAVIGATION_PERCENT = 3, 25
#: ... as shouting where so many words all lack lower case and hold exclamation marks at this percentage of them, ...
SHOUTING_MIN_WORDS, SHOUTING_PERCENT = 3, 30
#: ... and for its punctuation where so many words stand without a single mark.
PUNCTUATION_MIN_WORDS = 80
#: Phrases of lines that are notices about a page and not its content.
BOILERPLATE = (
    "licensed under", "all rights reserved", "released under the", "terms of service", "terms of use", "privacy policy",
    "cookie policy", "we use cookies", "accept cookies", "enable javascript", "subscribe to our", "sign up for our",
    "click here to", "share this article", "follow us on", "powered by",
)
#: A boilerplate line is short: at most so many words and characters.
BOILERPLATE_MAX_WORDS, BOILERPLATE_MAX_CHARS = 25, 400
#: The percentage of its words that a document may lose.
MAX_LOST_PERCENT = 50


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def _repeated_words(w: Column) -> Column:
    """Words inside three-word windows that are found twice or more.

    A text whose windows have as many different hashes as there are windows repeats nothing. Otherwise the windows are sorted by
    hash with their starts; neighbours with equal words are the repeated ones, and the distance to the next start tells how many
    new words each covers.
    """

    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        alike = lambda a, b: F.coalesce((a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"])) & (
            F.get(w, a["i"] + 1) == F.get(w, b["i"] + 1)) & (F.get(w, a["i"] + 2) == F.get(w, b["i"] + 2)), F.lit(False))
        return let(ordered, lambda s: F.sort_array(F.transform(F.filter(
            s, lambda x, k: alike(x, F.get(s, k - 1)) | alike(x, F.get(s, k + 1))), lambda x: x["i"])))

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))),
                           F.lit(0).cast("bigint"), lambda a, n: a + n)

    def of(hashes: Column) -> Column:
        none = F.lit(0).cast("bigint")
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), none).otherwise(let(starts(hashes), total))

    windows = lambda ids: F.transform(F.sequence(F.lit(0), F.size(ids) - 3), lambda i: F.xxhash64(F.get(ids, i), F.get(ids, i + 1), F.get(ids, i + 2)))
    hashed = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    return F.when(F.size(w) >= 4, let(hashed, of)).otherwise(F.lit(0).cast("bigint"))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{characters}]", ""))


def line_failure(line: Column, symbols: Column, separators: Column) -> Column:
    """The rule a line fails, or null. ``symbols`` and ``separators`` tell whether its text has any.

    What the whole text lacks needs no look at its lines, and lines that no rule can touch are not split into words.
    """
    n = F.size(words(line))
    low = F.lower(line)
    bars, marks = _count(line, "|»›•·"), _count(line, "!")
    boilerplate = low.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boilerplate = boilerplate | low.contains(phrase)
    return (
        F.when(symbols & (_count(line, "#*$%&<>") * 100 > n * SYMBOL_PERCENT), "symbols")
        .when(separators & (bars >= NAVIGATION_MIN) & (bars * 100 > n * NAVIGATION_PERCENT), "navigation")
        .when(line.contains("!") & (marks * 100 >= n * SHOUTING_PERCENT) & (n >= SHOUTING_MIN_WORDS)
              & (low != line) & (F.upper(line) == line), "shouting")
        .when((F.length(line) <= BOILERPLATE_MAX_CHARS) & boilerplate & (n <= BOILERPLATE_MAX_WORDS), "boilerplate")
        .when((F.length(line) >= 2 * PUNCTUATION_MIN_WORDS - 1) & ~F.regexp_like(line, F.lit(r"\p{P}")) & (n >= PUNCTUATION_MIN_WORDS),
              "punctuation")
    )


def judged(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, lost_words, kept.

    ``cleaned`` is the text without failing lines. A null text has no words: its counts are 0, it fails and ``cleaned`` is null.
    A line that repeats an earlier one counts in ``n_dup_lines`` but is not a failure by itself. Columns of these names in
    ``docs`` are replaced; all others pass through.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost_words", "kept"]
    kept = [c for c in docs.columns if c not in made]
    text = F.coalesce(F.col(text_column), F.lit(""))
    has_word = lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]"))
    gates = computed(docs.select(*kept), {
        "__symbols": F.regexp_like(text, F.lit("[#*$%&<>]")), "__bars": F.regexp_like(text, F.lit("[|»›•·]"))})
    split = computed(gates, {"__w": words(text), "__l": F.transform(
        F.filter(F.split(text, "\n", -1), has_word), lambda x: F.struct(x.alias("line"), line_failure(x, F.col("__symbols"), F.col("__bars")).alias("failed")))})
    line_texts = F.transform("__l", lambda x: x["line"])
    n = F.size("__w").cast("bigint")
    good = F.filter("__l", lambda x: x["failed"].isNull())
    lost = F.aggregate(F.filter("__l", lambda x: x["failed"].isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + F.size(words(x["line"])))
    counted = split.select(
        *kept, n.alias("n_words"), F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        _count(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct(line_texts))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("__w")).alias("n_repeat_words"),
        F.when(F.col(text_column).isNotNull(), F.array_join(F.transform(good, lambda x: x["line"]), "\n")).alias("cleaned"),
        lost.alias("lost_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return counted.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT))


def report(docs: DataFrame) -> DataFrame:
    """The counts and the verdict of each row of ``docs`` (doc_id, text)."""
    return judged(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept")
