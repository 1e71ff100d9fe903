"""Cell helpers: display values, markdown escapes, header and date tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx
from doclake.functions.frames import let

_EPOCH_SERIAL = 25569  # 1970-01-01 as a spreadsheet day number


def normalise(value: Column, kind: Column) -> Column:
    """g11: display text of a cell: whole numbers without fraction, day numbers as time stamps, True/False."""
    number = F.try_to_number(value, F.lit("S999999999999999D9999999999")).cast("double")
    number = F.coalesce(number, value.try_cast("double"))
    days = value.try_cast("double")
    shifted = F.when(days < 60, days + 1).otherwise(days)  # day numbers before the fictitious 1900-02-29
    stamp = F.date_format(
        F.timestamp_seconds(F.round((shifted - _EPOCH_SERIAL) * 86400).cast("bigint")), "yyyy-MM-dd HH:mm:ss"
    )
    large = value.try_cast("decimal(38,0)")  # exact where a double and its picture have too few digits
    whole = number == F.floor(number)
    return (
        F.when((kind == "number") & whole & (F.abs(number) < 1e15), number.cast("bigint").cast("string"))
        .when((kind == "number") & whole & large.isNotNull(), large.cast("string"))
        .when((kind == "datetime") & days.isNotNull(), stamp)
        .when(kind == "boolean", F.when(F.lower(value).isin("true", "1"), "True").otherwise("False"))
        .otherwise(value)
    )


def is_truthy(value: Column, kind: Column) -> Column:
    """Neither missing, nor blank, nor zero, nor false."""
    zero = (kind == "number") & (value.try_cast("double") == 0)
    false = (kind == "boolean") & ~F.lower(value).isin("true", "1")
    return (kind != "empty") & ~F.coalesce(zero, F.lit(False)) & ~false & (tx.strip(value) != "")


def is_digits(c: Column) -> Column:
    return c.rlike(r"^\p{Nd}+$")


def looks_like_date(value: Column) -> Column:
    s = tx.strip(value)
    return (F.char_length(s) >= fixed.DATE_MIN_LENGTH) & tx.contains_any(s, fixed.DATE_INDICATORS)


def census_kind(value: Column, kind: Column) -> Column:
    """What a present cell counts as in the census."""
    return (
        F.when((kind == "empty") | (value == ""), "empty")
        .when(kind == "datetime", "date")
        .when((kind == "text") & looks_like_date(value), "date")
        .otherwise(kind)
    )


def escape_cell(value: Column, limit: int) -> Column:
    """g5: text for one cell of a markdown table."""
    c = F.replace(value, F.lit("|"), F.lit("\\|"))
    c = F.replace(F.translate(c, "\n\r", "  "), F.lit('"'), F.lit('\\"'))
    c = F.regexp_replace(tx.strip(c), f"{tx.SPACE}+", " ")
    shown = lambda c: F.when(F.char_length(c) <= limit, c).when(
        F.char_length(c) > 20, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(F.substring(c, 1, limit))
    return let(c, shown)


def escape_markdown(value: Column) -> Column:
    """g6: backslash before every markdown special; one pass, so the backslashes added are not escaped again."""
    specials = "".join("\\" + c for c in fixed.MARKDOWN_SPECIALS)
    return F.regexp_replace(value, f"([{specials}])", r"\\$1")


def address(row_idx: Column, col_idx: Column) -> Column:
    """A1 reference of a cell: columns count in letters, A to Z, then AA; three letters name 18,278 columns."""
    letter = lambda n: F.chr((n + 65).cast("bigint"))
    n = col_idx - 1
    third = F.when(n >= 702, letter(F.floor((n - 702) / 676) % 26)).otherwise("")
    second = F.when(n >= 26, letter(F.floor((n - 26) / 26) % 26)).otherwise("")
    return F.concat(third, second, letter(n % 26), row_idx.cast("string"))
