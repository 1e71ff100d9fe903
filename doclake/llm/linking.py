"""Groups of similar items from bucket memberships: links between bucket members, and their connected components.

No bucket is expanded into all its pairs. In every round each open bucket names leaders, the leaders are compared with the members
that are not yet connected to them, and links merge components. A bucket is closed when the members that have not led all lie
in one component: every pair of its members has then been compared, or is connected already. The number of leaders grows 32-fold
from round to round, so the number of rounds grows with the logarithm of a bucket's size, whatever the bucket holds. Where members of a
large bucket are near each other but few are similar, that many leaders make many pairs; ``blocks`` then takes over after one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import written


GROWTH = 32


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of the component of every id in ``links`` (a, b), a table that is read in every round.

    Labels spread to neighbours and jump along labels until nothing changes; each round is written to the shared folder.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("comp")))
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        spread = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("comp").alias("far"))
        moved = written(spread.join(jump, "new", "left").select("id", F.col("comp").alias("old"), F.least("new", "far").alias("comp")))
        labels = moved.select("id", "comp")
        if moved.filter(F.col("old") != F.col("comp")).isEmpty():
            return labels


def shared_buckets(members: DataFrame) -> DataFrame:
    """Those of ``members`` (bucket, id, …), a table, whose bucket has others, as a table.

    The buckets are written before they are joined: AQE splits a hot one in a join of two tables, but not where one side is still
    grouped.
    """
    met = written(members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    return written(members.join(met, "bucket"))


def connect(
    members: DataFrame, verified: Callable[[DataFrame], DataFrame], alike: Callable[[Column, Column], Column] | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(id, comp) of all items that are linked to another one.

    With ``finish``, leaders meet members only once, and what is open then goes to it as a table (bucket, id, comp): it returns links
    (a, b) that join all components with similar members in a bucket.

    ``members`` (bucket, id, and ``sketch`` with ``alike``) is a table of the buckets of each item; ``verified`` takes pairs (a, b) and returns
    those that are similar. ``alike`` compares two sketches while leaders meet members, and keeps pairs that cannot be similar from
    becoming rows.
    """
    carried = ["sketch"] if alike else []
    state = members.select("bucket", "id", F.col("id").alias("comp"), *carried)
    links: DataFrame | None = None
    per_bucket = 1
    while True:
        # one order of ids for all buckets: a group that shares many buckets mostly has the same leaders in them
        salt = F.pmod(F.xxhash64(F.lit(per_bucket), "id"), F.lit(per_bucket))
        leaders = written(state.groupBy("bucket", salt.alias("salt")).agg(
            F.min_by(F.struct(F.col("id").alias("lead"), F.col("comp").alias("lead_comp"), *[F.col(c).alias(f"lead_{c}") for c in carried]),
                     F.xxhash64(F.lit("lead"), "id")).alias("l")).select("bucket", "l.*"))
        close = (F.col("comp") != F.col("lead_comp")) & (alike(F.col("sketch"), F.col("lead_sketch")) if alike else F.lit(True))
        met = state.join(leaders, "bucket").filter(close)
        pairs = met.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
        found = written(verified(pairs).select("a", "b"))
        links = found if links is None else links.union(found)
        labels = components(links)
        rest = written(state.join(leaders.select("bucket", F.col("lead").alias("id")), ["bucket", "id"], "left_anti").drop("comp").join(
            labels, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"), *carried))
        open_ones = rest.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket")
        state = written(rest.join(open_ones, "bucket"))
        if state.isEmpty():
            return labels
        if finish is not None:
            return components(links.union(written(finish(state).select("a", "b"))))
        per_bucket *= GROWTH
