"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns (added or replaced) that are evaluated once per row.

    A later filter on an ordinary projected column is pushed below the projection with the whole expression copied
    into it; a generator over a one-element array stops that, so costly columns (decoding, parsing) are not repeated.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression named inside a lambda is otherwise evaluated again
    for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
