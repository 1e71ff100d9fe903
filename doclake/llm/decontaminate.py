"""Benchmark decontamination: n-gram windows of test items are looked up in every window of every document.

Native: built-in column functions only. Documents are scanned row by row against a hash set of the items' windows, every
hit is verified on the words themselves, and hit spans or whole documents are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.frames import computed

#: Everything that is not part of a word: ASCII without digits and lower-case letters (upper case is lowered first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a window.
WINDOW = 10
#: Distinct windows up to which the set is broadcast inside the plan; a larger benchmark is joined by a shuffle.
MAX_BROADCAST_WINDOWS = 100_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def _window(items: Column, position: Column, size: int) -> list[Column]:
    """The elements of one window, one by one: ``slice`` would copy the whole array for each window."""
    return [F.get(items, position + (i - 1)) for i in range(size)]


def _gram(words_: Column, position: Column, size: int) -> Column:
    return F.concat_ws(" ", *_window(words_, position, size))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(size, gram, item_id), distinct: every window of every item; an item shorter than a window is one itself."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = F.col("w")
    whole = F.size("w") < window
    grams = F.when(whole, F.array(F.array_join(w, " "))).otherwise(F.transform(_positions(w, window), lambda i: _gram(w, i, window)))
    return own.select(F.least(F.size("w"), F.lit(window)).alias("size"), F.explode(grams).alias("gram"), "item_id").distinct()


def _positions(w: Column, size: int) -> Column:
    """Starts of windows of one size."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))


def _windows(w: Column, positions: Column, size: int) -> Column:
    return F.transform(positions, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("size"), _gram(w, i, size).alias("gram")))


def _hash(grams: Column, size: int) -> Column:
    """Hash of a window as the scan makes it: of the hashes of its words."""
    parts = F.split(grams, " ")
    return F.xxhash64(*[F.xxhash64(F.get(parts, F.lit(i))) for i in range(size)])


def _candidates(w: Column, ids: Column, grams: dict[int, tuple[list[int], list[str]]]) -> Column:
    """array<struct<pos, size, gram>> of windows that are in the set: looked up by hash, verified by their words."""

    def of(size: int, hashes: list[int], texts: list[str]) -> Column:
        by_hash = F.filter(_positions(w, size), lambda i: F.xxhash64(*_window(ids, i, size)).isin(hashes))
        return F.filter(_windows(w, by_hash, size), lambda s: s["gram"].isin(texts))

    found = [of(size, *lists) for size, lists in sorted(grams.items())]
    return F.concat(*found) if found else F.array().cast("array<struct<pos:int,size:int,gram:string>>")


def _covered(hits: Column) -> Column:
    """Words inside any of the hit windows (array<struct<pos, size, …>>)."""
    ordered = F.array_sort(F.transform(hits, lambda s: F.struct(s["pos"].alias("pos"), (s["pos"] + s["size"]).alias("end"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(ordered, zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["pos"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], s["end"]).alias("upto"),
    ))["n"]


def _window_set(windows: DataFrame, window: int, bound: int) -> dict[int, tuple[list[int], list[str]]] | None:
    """The distinct windows by size, or None where there are more than ``bound``."""
    hashed = F.lit(None).cast("bigint")
    for size in range(1, window + 1):
        hashed = F.when(F.col("size") == size, _hash(F.col("gram"), size)).otherwise(hashed)
    found = windows.select("size", "gram").distinct().limit(bound + 1).withColumn("hash", hashed).collect()
    if len(found) > bound:
        return None
    return {size: ([r["hash"] for r in found if r["size"] == size], [r["gram"] for r in found if r["size"] == size])
            for size in sorted({r["size"] for r in found})}


def scan(docs: DataFrame, windows: DataFrame, window: int = WINDOW, bound: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with ``__words`` and ``__hits`` (array<struct<pos, size, gram>>), the verified windows of each document.

    Up to ``bound`` distinct windows nothing is shuffled: the set travels with the plan. Beyond it, all windows of the
    documents are joined with the items' by a shuffle that AQE splits where a window is hot, and the hits come back by row.
    """
    base = computed(docs, {"__words": words(F.col("text"))})
    grams = _window_set(windows, window, bound)
    if grams is not None:
        hashed = computed(base, {"__ids": F.transform("__words", lambda x: F.xxhash64(x))})
        return computed(hashed, {"__hits": _candidates(F.col("__words"), F.col("__ids"), grams)}).drop("__ids")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most as many as words in a window
    w = F.col("__words")
    every = F.concat(*[_windows(w, _positions(w, n), n) for n in sizes])
    key = ["__k1", "__k2"]
    keyed = base.withColumn("__k1", F.xxhash64(*[F.col(c) for c in docs.columns])).withColumn("__k2", F.hash("text", "__words"))
    hits = (
        keyed.select(*key, F.explode(every).alias("s")).select(*key, "s.*").distinct()
        .join(windows.select("gram").distinct(), "gram")
        .groupBy(*key).agg(F.collect_list(F.struct("pos", "size", "gram")).alias("__hits"))
    )
    none = F.array().cast("array<struct<pos:int,size:int,gram:string>>")
    return keyed.join(hits, key, "left").withColumn("__hits", F.coalesce("__hits", none)).drop(*key)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bound: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits. Repeated rows and repeated or null doc_ids each get their own row; items
    with equal texts all count; a null item_id never names an item. Empty tables give no rows or no hits; other columns are ignored.
    """
    windows = item_windows(benchmark.select("item_id", "text").filter(F.col("item_id").isNotNull()), window)
    scanned = scan(docs.select("doc_id", "text"), windows, window, bound).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("__words").cast("bigint").alias("n_words"),
        _covered(F.col("__hits")).alias("n_hit"),
        F.array_distinct(F.transform("__hits", lambda s: s["gram"])).alias("grams"),
    )
    named = windows.select("gram", "item_id")
    lookup = scanned.withColumn("gram", F.explode_outer("grams")).drop("grams").join(named, "gram", "left")
    out = lookup.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW,
           bound: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` without what the benchmark contains, with the same columns.

    ``documents`` drops every document with a hit; ``spans`` keeps them and cuts the hit words (a single space marks the cut).
    Null and wordless texts stay as they are.
    """
    windows = item_windows(benchmark.select("item_id", "text"), window)
    scanned = scan(docs, windows, window, bound)
    if mode == "documents":
        return scanned.filter(F.size("__hits") == 0).select(*docs.columns)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}")
    # the text is gap, word, gap, word, …, gap: the pieces of both splits interleave
    lower = F.translate("text", UPPER, LOWER)
    gaps = F.regexp_extract_all(lower, F.lit(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    starts_with_gap = F.regexp_like(lower, F.lit(r"^[\x00-\x2F\x3A-\x60\x7B-\x7F]"))
    own = F.array_remove(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1), "")
    lead = F.when(starts_with_gap, F.element_at(gaps, 1)).otherwise("")
    after = F.when(starts_with_gap, F.slice(gaps, 2, F.size(gaps))).otherwise(gaps)
    hit = F.array_distinct(F.flatten(F.transform("__hits", lambda s: F.sequence(s["pos"], s["pos"] + s["size"] - 1))))
    pieces = F.zip_with(
        F.transform(own, lambda x, i: F.when(F.array_contains(F.col("__cut"), i + 1), F.lit(None)).otherwise(x)), after,
        lambda x, gap: F.when(x.isNull(), " ").otherwise(F.concat(x, F.coalesce(gap, F.lit("")))))
    cut = F.regexp_replace(F.concat(lead, F.array_join(pieces, "")), " {2,}", " ")
    return scanned.withColumn("__cut", hit).withColumn(
        "text", F.when(F.size("__hits") == 0, F.col("text")).otherwise(cut)).select(*docs.columns)
