"""Column helpers for text: Unicode whitespace, case tests, counts.

Spark's ``trim`` strips only U+0020 and Java's ``\\s`` is ASCII, so every operator uses the constants below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions.frames import let

#: every character that counts as white space
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
#: those of them that are ASCII
PLAIN_SPACE = "".join(c for c in WHITESPACE if c.isascii())
_WS_BODY = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WS = f"[{_WS_BODY}]"
NOT_WS = f"[^{_WS_BODY}]"
#: the same classes as Java spells them; most characters are printable ASCII, so these are told first
SPACE = f"[[^!-~]&&{WS}]"
NOT_SPACE = f"[!-~{NOT_WS}]"


def unicode_regex(pattern: str) -> str:
    """Give ``\\s`` and ``\\d`` their Unicode meaning (the pattern must not use them inside a class)."""
    return pattern.replace(r"\s", WS).replace(r"\d", r"\p{Nd}")


def java_regex(pattern: str) -> str:
    """``unicode_regex`` in the spelling that Spark is quicker with."""
    return pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return ~c.rlike(NOT_SPACE)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words) -> Column:
    return any_of(F.contains(c, F.lit(w)) for w in words)


def lines_of(text: Column) -> Column:
    """All lines of a text; only ``\\n`` ends a line."""
    return F.split(text, "\n", -1)


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def normalise_newlines(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def is_upper(c: Column) -> Column:
    """At least one upper-case letter and no lower- or title-case one."""
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def word_count(text: Column) -> Column:
    # of plain text each word becomes one sign, and white space is left at the end alone
    marks = F.rtrim(F.regexp_replace(text, f"[{PLAIN_SPACE}]*+[^{PLAIN_SPACE}]++", "x"), F.lit(PLAIN_SPACE))
    count = F.when(F.octet_length(text) == F.char_length(text), F.char_length(marks)).otherwise(
        F.regexp_count(text, F.lit(f"{NOT_SPACE}++")))
    return count.cast("bigint")


def char_count(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def indicator_hits(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(
        lambda a, b: a + b,
        [F.contains(low, F.lit(w)).cast("bigint") for w in fixed.LANGUAGE_INDICATORS],
    ))


def language_flag(text: Column) -> Column:
    return F.when(indicator_hits(text) > fixed.LANGUAGE_MIN_HITS, "es").otherwise("en")


def heading_numbered(stripped: Column) -> Column:
    return stripped.rlike(java_regex(fixed.HEADING_NUMBERED))


def is_heading(stripped: Column) -> Column:
    """Heading test on an already stripped line."""
    return (
        (stripped != "")
        & (F.char_length(stripped) < fixed.HEADING_MAX_LENGTH)
        & (
            is_upper(stripped)
            | F.endswith(stripped, F.lit(":"))
            | heading_numbered(stripped)
            | stripped.rlike(fixed.HEADING_CAPITAL)
        )
    )


def is_list_line(line: Column) -> Column:
    """List test on a raw (not stripped) line."""
    return line.rlike("|".join(java_regex(p) for p in fixed.LIST_PATTERNS))


def section_kind(lowered: Column) -> Column:
    """Section opened by a lower-cased line, or null."""
    out = None
    for kind, words in fixed.SECTION_KEYWORDS.items():
        hit = contains_any(lowered, words)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


#: What a text has in lower case where it has a metric of a class, or the letters whose case is not told by that.
METRIC_SIGNS = {
    "percent": ["%"], "money": ["$"], "big_number": ["mil", "thou", *"\u0130\u0131\u017f"],
    "duration": ["año", "year", "mes", "month", *"\u0130\u0131\u017f"],
}


def metric_matches(text: Column, kind: str, low: Column | None = None) -> Column:
    """All matches of one metric class, in text order, with repeats."""
    # what does not match from the first digit of a number does not from a later one, as the same follows
    pattern = "(?iu)" + java_regex(fixed.METRIC_PATTERNS[kind].replace(r"(\d+", r"(\d(?<!\d\d)\d*+"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    cased = [F.contains(F.lower(text) if low is None else low, F.lit(s)) for s in METRIC_SIGNS[kind] if s.isascii() or len(s) > 1]
    other = [F.contains(text, F.lit(s)) for s in METRIC_SIGNS[kind] if not s.isascii() and len(s) == 1]
    return F.when(any_of([*cased, *other]), found).when(text.isNotNull(), F.array().cast("array<string>"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def extension_of(file_name: Column) -> Column:
    """Extension after the last dot of the base name; leading dots do not start an extension."""
    base = F.regexp_extract(file_name, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"(?s)^\.*[^.].*\.([^.]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
