"""Cell predicates of dataset profiling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx

_DIGITS = r"\p{Nd}(?:_?\p{Nd})*"
#: what a float literal may look like: signs, exponents, single underscores between digits, nan and infinities; with white space around
FLOAT = (
    rf"^{tx.SPACE}*+[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])"
    rf"{tx.SPACE}*+\z"
)
DATE = tx.java_regex(r"^\s*+(?:" + "|".join(fixed.DATE_PATTERNS) + ")")


def is_number(cell: Column) -> Column:
    """A number once thousands separators are gone; ``try_cast`` accepts and refuses other spellings."""
    return F.replace(cell, F.lit(","), F.lit("")).rlike(FLOAT)


def is_date(cell: Column) -> Column:
    return cell.rlike(DATE)


def is_blank(cell: Column) -> Column:
    """Missing cells count as complete; only present blank ones are empty."""
    return F.coalesce(tx.strip(cell) == "", F.lit(False))
