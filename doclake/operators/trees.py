"""JSON/YAML trees (``n*``) and XML trees (``x*``) from node and element tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake import fixed
from doclake.functions import text as tx
from doclake.functions.frames import let
from doclake.sources import trees as src

STAT_FIELDS = ["depth", "kind", "n_children"]
OUTLINE_FIELDS = [
    "node_id", "path", "depth", "object_depth", "key", "ordinal", "kind", "parent_kind", "n_children", "value",
    "key_rank", "item_rank", "last_id", "branch_depth",
]
REPORT_FIELDS = [f for f in OUTLINE_FIELDS if f != "path"] + ["type_name"]
TOP_FIELDS = ["depth", "key", "ordinal", "kind", "parent_kind", "type_name", "n_children"]
CONFIG_FIELDS = ["depth", "key", "kind", "parent_kind", "object_text"]
YAML_FIELDS = sorted({*STAT_FIELDS, *TOP_FIELDS, *CONFIG_FIELDS})

#: A node field by its name: a column of a node table, or a field of an element of ``nodes``.
Of = Callable[[str], Column]


def reported_kind(kind: Column) -> Column:
    """Booleans are reported as numbers and values of other types are not reported."""
    return F.when(kind == "Boolean", "Number").when(kind != "Other", kind)


def complexity(depth: Column, keys: Column) -> Column:
    """n3."""
    return (
        F.when((depth > fixed.COMPLEX_DEPTH) | (keys > fixed.COMPLEX_KEYS), "Complex")
        .when((depth > fixed.MODERATE_DEPTH) | (keys > fixed.MODERATE_KEYS), "Moderate")
        .otherwise("Simple")
    )


def tree_stats(nodes: DataFrame) -> DataFrame:
    """n2, n3: depth, keys, kinds and complexity per document."""
    keys = F.sum(F.when(F.col("kind") == "Object", F.col("n_children")).otherwise(0))
    return (
        nodes.groupBy("doc_id")
        .agg(
            F.max("depth").alias("max_depth"),
            keys.alias("total_keys"),
            F.array_sort(F.collect_set(reported_kind(F.col("kind")))).alias("kinds"),
        )
        .withColumn("complexity", complexity(F.col("max_depth"), F.col("total_keys")))
    )


def preview(c: Column) -> Column:
    cut = F.concat(F.substring(c, 1, fixed.OUTLINE_PREVIEW), F.lit("..."))
    return F.concat(F.lit('"'), F.when(F.char_length(c) > fixed.OUTLINE_PREVIEW, cut).otherwise(c), F.lit('"'))


def is_shown(of: Of = F.col) -> Column:
    """Whether the outline shows a node: every key on its way is among the first five and every array position is the
    first. Below the depth limit only the node that stands for a subtree is left, not the items inside it."""
    too_deep = of("object_depth") > fixed.OUTLINE_DEPTH
    return (
        (of("key_rank") < fixed.OUTLINE_KEYS) & (of("item_rank") == 0)
        & (of("object_depth") <= fixed.OUTLINE_DEPTH + 1)
        & ~(too_deep & (F.coalesce(of("parent_kind"), F.lit("Object")) != "Object"))
    )


def description(of: Of = F.col) -> Column:
    """What the outline says of a node."""
    too_deep = of("object_depth") > fixed.OUTLINE_DEPTH
    kind, n = of("kind"), of("n_children")
    return (
        F.when(too_deep, "...")
        .when((kind == "Object") & (n == 0), "(empty object)")
        .when(kind == "Object", "")
        .when((kind == "Array") & (n == 0), "(empty array)")
        .when(kind == "Array", F.concat(F.lit("Array["), n.cast("string"), F.lit("]:")))
        .when(kind == "String", preview(of("value")))
        .when(kind == "Null", "null")
        .otherwise(of("value"))
    )


def left_out(of: Of = F.col) -> Column:
    """How many entries the outline leaves out below a node."""
    kind = of("kind")
    limit = F.when(kind == "Object", fixed.OUTLINE_KEYS).when(kind == "Array", 1).otherwise(0)
    below = F.greatest(of("n_children") - limit, F.lit(0))
    return F.when(of("object_depth") > fixed.OUTLINE_DEPTH, 0).otherwise(below).cast("bigint")


def outline(nodes: DataFrame) -> DataFrame:
    """n4: the shown part of each tree. One filter over node columns, without windows or joins."""
    return nodes.filter(is_shown()).withColumns({"description": description(), "left_out": left_out()})


def outline_pieces(of: Of) -> Column:
    """What a node adds to the outline text: an opening piece at its place and, when entries are left out, a
    closing piece after its last descendant. The pieces of a document in order are its outline."""
    indent = lambda level: F.repeat(F.lit("  "), level.cast("int"))
    depth, kind, n = of("object_depth"), of("kind"), of("n_children")
    keyed = of("parent_kind") == "Object"
    inner = description(of)
    own_indent = F.when(
        (depth <= fixed.OUTLINE_DEPTH) & ((kind == "Array") | ((kind == "Object") & (n == 0))), indent(depth)
    ).otherwise("")
    value = F.concat(own_indent, inner, F.when((kind == "Array") & (n > 0) & (depth <= fixed.OUTLINE_DEPTH), " ").otherwise(""))
    broken = (kind == "String") & F.contains(inner, F.lit("\n"))
    multi_line = broken | F.coalesce(of("branch_depth") <= fixed.OUTLINE_DEPTH, F.lit(False))
    opening = F.when(
        keyed,
        F.concat(
            F.when(of("ordinal") > 0, "\n").otherwise(""),
            indent(depth - 1), F.lit("- **"), of("key"), F.lit(":**"),
            F.when(multi_line, "\n").otherwise(" "), value,
        ),
    ).otherwise(value)
    more = left_out(of)
    closing = F.when(
        (more > 0) & (kind == "Object"),
        F.concat(F.lit("\n"), indent(depth), F.lit("- ... ("), more.cast("string"), F.lit(" more keys)")),
    ).when(
        (more > 0) & (kind == "Array"), F.concat(F.lit(" (and "), more.cast("string"), F.lit(" more)"))
    )
    piece = lambda at, closes, level, text: F.struct(
        at.alias("at"), F.lit(closes).alias("closes"), level.cast("bigint").alias("level"), text.alias("piece")
    )
    first = piece(of("node_id"), 0, F.lit(0), opening)
    last = piece(of("last_id"), 1, -of("depth"), closing)
    return F.when(closing.isNotNull(), F.array(first, last)).otherwise(F.array(first))


def outline_text(nodes: Column) -> Column:
    """The outline of a document's nodes as one text. Hidden nodes add nothing."""
    shown = F.filter(nodes, lambda x: is_shown(lambda n: x[n]))
    ordered = F.sort_array(F.flatten(F.transform(shown, lambda x: outline_pieces(lambda n: x[n]))))
    return F.array_join(F.transform(ordered, lambda p: p["piece"]), "")


def is_top(of: Of = F.col) -> Column:
    return (of("depth") == 1) & (of("parent_kind") == "Object")


def top_description(of: Of = F.col) -> Column:
    n = of("n_children").cast("string")
    return (
        F.when(of("kind") == "Object", F.concat(F.lit("Object with "), n, F.lit(" properties")))
        .when(of("kind") == "Array", F.concat(F.lit("Array with "), n, F.lit(" items")))
        .otherwise(of("type_name"))
    )


def top_level(nodes: DataFrame) -> DataFrame:
    """n7: the root keys of each document and what they hold."""
    return nodes.filter(is_top()).select("doc_id", "ordinal", "key", top_description().alias("description"))


def config_pattern(of: Of = F.col) -> Column:
    """Configuration type a node stands for, or null. The first matching pattern of a key wins."""
    def found(low: Column) -> Column:
        out = None
        for name, indicators in fixed.CONFIG_PATTERNS:
            title = name.title()
            by_key, by_value = F.contains(low["key"], F.lit(name)), tx.contains_any(low["body"], indicators)
            out = F.when(by_key, f"{title} Configuration") if out is None else out.when(by_key, f"{title} Configuration")
            out = out.when(low["body"].isNotNull() & by_value, f"Possible {title} Config")
        return out

    low = F.struct(F.lower(of("key")).alias("key"), F.lower(of("object_text")).alias("body"))
    return F.when((of("parent_kind") == "Object") & (of("depth") <= fixed.CONFIG_KEY_DEPTH + 1), let(low, found))


def config_patterns(nodes: DataFrame) -> DataFrame:
    """n6: configuration types met in each document, distinct."""
    return nodes.select("doc_id", config_pattern().alias("pattern")).filter(F.col("pattern").isNotNull()).distinct()


def _bulleted(items: Column) -> Column:
    return F.concat(F.lit("- "), F.array_join(items, "\n- "), F.lit("\n"))


def _present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def json_report_expr() -> Column:
    """n5 for JSON: structure header, outline and content, from ``tree``, ``nodes``, ``file_name`` and ``text``."""
    t = F.col("tree")
    return F.concat(
        F.lit("## 📊 JSON Structure Analysis\n- **File:** "), tx.base_name(F.col("file_name")),
        F.lit("\n- **Root Type:** "), t["root_type"],
        F.lit("\n- **Complexity:** "), complexity(t["max_depth"], t["total_keys"]),
        F.lit("\n- **Depth Levels:** "), t["max_depth"].cast("string"),
        F.lit("\n- **Total Keys:** "), t["total_keys"].cast("string"),
        F.lit("\n- **Data Types:** "), F.array_join(t["kinds"], ", "),
        F.lit("\n\n### 🗂️ Key Structure Overview\n"), outline_text(F.col("nodes")),
        F.lit("\n\n### 📋 JSON Content\n```json\n"), F.col("text"), F.lit("\n```"),
    )


def yaml_report_expr() -> Column:
    """n5 for YAML: structure header, configuration types, top level and content."""
    t, nodes = F.col("tree"), F.col("nodes")
    found = F.sort_array(F.array_distinct(_present(F.transform(nodes, lambda x: config_pattern(lambda n: x[n])))))
    tops = F.sort_array(F.transform(F.filter(nodes, lambda x: is_top(lambda n: x[n])), lambda x: F.struct(
        x["ordinal"].alias("ordinal"), x["key"].alias("key"), top_description(lambda n: x[n]).alias("description"))))
    top_lines = F.transform(tops, lambda p: F.concat(F.lit("**"), p["key"], F.lit(":** "), p["description"]))
    part = lambda title, items: let(items, lambda i: F.when(
        F.size(i) > 0, F.concat(F.lit(title + "\n"), _bulleted(i), F.lit("\n"))).otherwise(""))
    return F.concat(
        F.lit("## ⚙️ YAML Configuration Analysis\n- **File:** "), tx.base_name(F.col("file_name")),
        F.lit("\n- **Data Type:** "), t["root_type"],
        F.lit("\n- **Complexity:** "), complexity(t["max_depth"], t["total_keys"]),
        F.lit("\n- **Structure Depth:** "), t["max_depth"].cast("string"),
        F.lit(" levels\n- **Total Keys:** "), t["total_keys"].cast("string"),
        F.lit("\n- **Data Types:** "), F.array_join(t["kinds"], ", "), F.lit("\n\n"),
        part("### 🔧 Detected Configuration Types", found), part("### 🗂️ Top-Level Structure", top_lines),
        F.lit("### 📋 YAML Content\n```yaml\n"), F.col("text"), F.lit("\n```"),
    )


def json_report(docs: DataFrame) -> DataFrame:
    """n5 for JSON, row by row. Malformed documents have no report."""
    parsed = src.with_trees(docs, "json", node_fields=REPORT_FIELDS, summary=True).filter("status = 'ok'")
    return parsed.select("doc_id", json_report_expr().alias("report"))


def yaml_report(docs: DataFrame) -> DataFrame:
    """n5 for YAML, row by row. Unreadable documents have no report."""
    parsed = src.with_trees(docs, "yaml", node_fields=YAML_FIELDS, summary=True).filter("status = 'ok'")
    return parsed.select("doc_id", yaml_report_expr().alias("report"))


# ---- XML -------------------------------------------------------------------------------------


def namespace_of(tag: Column) -> Column:
    """x4: namespace of a ``{ns}name`` tag, empty if none."""
    return F.regexp_extract(tag, r"^\{([^}]*)\}", 1)


def clean_tag(tag: Column) -> Column:
    """x4: tag without its namespace."""
    return F.regexp_replace(tag, r"^\{[^}]*\}", "")


def root_namespace(elements: DataFrame) -> DataFrame:
    """x4: root tag of each document, split."""
    return elements.filter(F.col("depth") == 0).select(
        "doc_id", F.col("tag").alias("root_element"), namespace_of(F.col("tag")).alias("namespace"),
        clean_tag(F.col("tag")).alias("root_tag"),
    )


def xml_stats(elements: DataFrame) -> DataFrame:
    """x2: totals per document."""
    return elements.groupBy("doc_id").agg(
        F.max(F.when(F.col("depth") == 0, F.col("tag"))).alias("root_element"),
        F.count("*").alias("total_elements"),
        F.size(F.collect_set("clean_tag")).cast("bigint").alias("unique_tags"),
        F.max("depth").alias("max_depth"),
        F.sum("n_attributes").alias("attributes"),
        F.sum("text_length").alias("text_length"),
    )


def tag_summary(elements: DataFrame) -> DataFrame:
    """x3: per document and tag: count, attributes, text, children, order of appearance.

    Elements carry their parent's tag, so a row counts for its own tag and as a child of its parent's; one grouping
    replaces the child-to-parent self-join.
    """
    as_self = F.struct(
        F.col("clean_tag").alias("t"), F.lit(1).cast("bigint").alias("one"), F.col("ord").alias("first_ord"),
        (F.col("n_attributes") > 0).alias("attrs"), (F.col("text_length") > 0).alias("text"),
        F.lit(None).cast("string").alias("child"),
    )
    as_child = F.struct(
        F.col("parent_tag").alias("t"), F.lit(0).cast("bigint").alias("one"), F.lit(None).cast("bigint").alias("first_ord"),
        F.lit(False).alias("attrs"), F.lit(False).alias("text"), F.col("clean_tag").alias("child"),
    )
    return (
        elements.select("doc_id", F.inline(F.array(as_self, as_child)))
        .filter(F.col("t").isNotNull())
        .groupBy("doc_id", F.col("t").alias("clean_tag"))
        .agg(
            F.sum("one").alias("n"),
            F.bool_or("attrs").alias("has_attributes"),
            F.bool_or("text").alias("has_text"),
            F.min("first_ord").alias("first_ord"),
            F.array_sort(F.collect_set("child")).alias("children"),
        )
    )


def _tag_line(x: Column) -> Column:
    """x3 as a line of a report."""
    return F.concat(
        F.lit("- **"), x["tag"], F.lit("** ("), x["n"].cast("string"), F.lit("x)"),
        F.when(x["attrs"], " (with attributes)").otherwise(""), F.when(x["text"], " (contains text)").otherwise(""),
        F.when(F.size(x["children"]) > 0, F.concat(F.lit(" → "), F.array_join(x["children"], ", "))).otherwise(""),
    )


def xml_report_expr() -> Column:
    """x5 of a well-formed document from ``xml``, ``file_name`` and ``text``."""
    x = F.col("xml")
    ns = namespace_of(x["root"])
    return F.concat(
        F.lit("## 🔧 XML Document Analysis\n- **File:** "), tx.base_name(F.col("file_name")),
        F.lit("\n- **Root Element:** "), x["root"],
        F.lit("\n- **Namespace:** "), F.when(ns == "", "None").otherwise(ns),
        F.lit("\n- **Total Elements:** "), x["total"].cast("string"),
        F.lit("\n- **Unique Tags:** "), F.size(x["tags"]).cast("string"),
        F.lit("\n- **Max Depth:** "), x["max_depth"].cast("string"),
        F.lit("\n- **Attributes:** "), x["attributes"].cast("string"),
        F.lit("\n- **Text Content:** "), x["text_length"].cast("string"),
        F.lit(" characters\n\n### 🗂️ XML Structure Overview\n"),
        F.array_join(F.transform(x["tags"], _tag_line), "\n"),
        F.lit("\n\n### 📋 Raw XML Content\n```xml\n"), F.col("text"), F.lit("\n```"),
    )


def xml_report(docs: DataFrame) -> DataFrame:
    """x5: report of every XML document, row by row; malformed ones keep their raw text, without enrichment."""
    parsed = src.with_trees(docs, "xml", node_fields=["kind"], summary=True)
    ok = F.col("status") == "ok"
    return parsed.select("doc_id", F.coalesce(ok, F.lit(False)).alias("well_formed"), F.when(ok, xml_report_expr()).otherwise(F.col("text")).alias("report"))
