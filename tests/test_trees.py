"""JSON, YAML and XML trees."""

from __future__ import annotations

import pytest

from doclake.operators import trees
from doclake.sources import trees as src


def test_nodes_keep_document_order_and_last_duplicate(docs_of):
    nodes = src.json_nodes(docs_of('{"b":1,"a":[true,null],"b":"x"}')).orderBy("node_id").collect()
    assert [(n.path, n.kind, n.depth, n.value) for n in nodes] == [
        ("$", "Object", 0, None), ("$.b", "String", 1, "x"), ("$.a", "Array", 1, None),
        ("$.a[0]", "Boolean", 2, "True"), ("$.a[1]", "Null", 2, None)]
    assert [n.last_id for n in nodes] == [4, 1, 4, 3, 4]


def test_malformed_json_has_no_nodes(docs_of):
    assert src.json_nodes(docs_of("{", "", "[1,]")).count() == 0


def test_booleans_count_as_numbers(docs_of):
    stats = trees.tree_stats(src.json_nodes(docs_of("[true]"))).collect()[0]
    assert (stats.kinds, stats.max_depth, stats.total_keys, stats.complexity) == (["Array", "Number"], 1, 0, "Simple")


def test_outline_text(docs_of, value_of):
    body = (
        '{"a":1,"long":"' + "x" * 31 + '","e":{},"f":[],"arr":[{"k":1,"m":{"n":{"o":{"p":1}}}},2,3],"six":6,"seven":7}'
    )
    report = value_of(trees.json_report(docs_of(body, ext="json")), "report")[0]
    outline = report.split("Overview\n")[1].split("\n\n### 📋")[0]
    assert outline == (
        "- **a:** 1\n"
        '- **long:** "' + "x" * 30 + '..."\n'
        "- **e:**   (empty object)\n"
        "- **f:**   (empty array)\n"
        "- **arr:**\n"
        "  Array[3]:   - **k:** 1\n"
        "  - **m:**     - **n:**       - **o:** ... (and 2 more)\n"
        "- ... (2 more keys)")
    assert "- **Root Type:** dict\n- **Complexity:** Complex\n- **Depth Levels:** 6\n- **Total Keys:** 12\n" in report


def test_deep_json_is_walked(docs_of):
    deep = "[" * 500 + "]" * 500
    assert trees.tree_stats(src.json_nodes(docs_of(deep))).collect()[0].max_depth == 499


def test_yaml_kinds_and_rejects(docs_of):
    docs = docs_of("a: 2024-01-01\nb: [1, x]\n", "1: a\n", "a: [1\n", "plain words\n")
    stats = {r.doc_id: r.kinds for r in trees.tree_stats(src.yaml_nodes(docs)).collect()}
    assert stats == {1: ["Array", "Number", "Object", "String"], 4: ["String"]}
    assert [r.doc_id for r in src.yaml_errors(docs).collect()] == [3]


def test_config_patterns(docs_of):
    docs = docs_of('{"my_database":1,"x":{"inner":{"TTL":5}},"deep":{"a":{"b":{"server":1}}},"y":{"z":1}}')
    got = sorted(r.pattern for r in trees.config_patterns(src.json_nodes(docs)).collect())
    assert got == ["Database Configuration", "Possible Cache Config"]


def test_yaml_report(docs_of, value_of):
    report = value_of(trees.yaml_report(docs_of("server:\n  host: h\nn: 1\n", ext="yml")), "report")[0]
    # the value of "server" names a host, and the database pattern is tried before the server pattern
    assert "- Possible Database Config\n" in report and "- **server:** Object with 1 properties\n- **n:** int\n" in report


def test_xml(docs_of, value_of):
    body = '<!-- c --><a xmlns="urn:x" xmlns:k="urn:y" i="1"> t <k:b j="2"/>tail<k:b><c>42</c></k:b></a>'
    docs = docs_of(body, "<a><b></a>", ext="xml")
    elements = src.xml_elements(docs)
    assert [tuple(r)[1:] for r in trees.xml_stats(elements).collect()] == [("{urn:x}a", 4, 3, 2, 2, 3)]
    got = {r.clean_tag: (r.n, r.has_attributes, r.has_text, r.children) for r in trees.tag_summary(elements).collect()}
    assert got == {"a": (1, True, True, ["b"]), "b": (2, True, False, ["c"]), "c": (1, False, True, [])}
    reports = value_of(trees.xml_report(docs), "report")
    assert "- **b** (2x) (with attributes) → c\n- **c** (1x) (contains text)\n" in reports[0] and reports[1] == "<a><b></a>"
    root = trees.root_namespace(elements).collect()[0]
    assert (root.namespace, root.root_tag) == ("urn:x", "a")


def test_yaml_anchors_may_spell_out_more_than_the_text():
    from doclake.sources import trees as src

    text = "base: &x {" + ", ".join(f"k{i}: {i % 10}" for i in range(40)) + "}\n" + "".join(f"s{i}: *x\n" for i in range(20))
    out = {"path": []}
    assert src.yaml_columns(text, out) == 862 > len(text) and len(out["path"]) == 862
    bomb = "a0: &a0 [x]\n" + "".join(f"a{i}: &a{i} [{', '.join([f'*a{i - 1}'] * 9)}]\n" for i in range(1, 12))
    for bad in (bomb, "a: &a [*a]\n", "a: &a {b: {c: [1, *a]}}\n"):
        with pytest.raises(src.Unreadable):
            src.yaml_columns(bad, {"path": []})


# ---- summaries --------------------------------------------------------------------------------


def random_tree(r, depth=0):
    kind = r.random()
    if depth > 6 or kind < 0.35:
        return r.choice([None, True, 1, 2.5, "", "text" * 12, "two\nlines", []])
    if kind < 0.7:
        return {r.choice("abcdefghij") + str(i): random_tree(r, depth + 1) for i in range(r.randrange(0, 8))}
    return [random_tree(r, depth + 1) for _ in range(r.randrange(0, 5))]


@pytest.mark.parametrize("seed", range(40))
def test_summary_has_the_shown_nodes_and_the_statistics_of_all(seed):
    import random

    root = random_tree(random.Random(seed))
    names = [n for n in src.NODE_FIELDS if n not in ("parent_id", "path")]
    full = {n: [] for n in names}
    n = src.node_columns(root, full, 10**6)
    keys = sum(c for k, c in zip(full["kind"], full["n_children"]) if k == "Object")
    kinds = sorted({"Number" if k == "Boolean" else k for k in full["kind"]})
    for reader, shown in src._SHOWN.items():
        out = {n: [] for n in names}
        kept, tree = src.tree_summary(root, reader, out)
        hit = [i for i in range(n) if shown(*(full[f][i] for f in ("depth", "object_depth", "key_rank", "item_rank")))]
        assert kept == len(hit) and all(out[f] == [full[f][i] for i in hit] for f in names)
        assert tree == {"root_type": type(root).__name__, "max_depth": max(full["depth"]), "total_keys": keys, "kinds": kinds}


def test_summary_of_a_large_document_keeps_little():
    import tracemalloc

    root = {"rows": [{"k": i, "v": [i, str(i)]} for i in range(200_000)], "m": {str(i): i for i in range(100_000)}}
    out = {n: [] for n in src.NODE_FIELDS if n not in ("parent_id", "path", "object_text")}
    tracemalloc.start()
    kept, tree = src.tree_summary(root, "json", out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept < 20 and tree["total_keys"] == 500_002 and tree["max_depth"] == 4 and peak < 60 << 20


def test_xml_summary_equals_the_elements(monkeypatch):
    import random

    def element(r, depth=0):
        tag = r.choice(["a", "b", "n:c", "d"])
        inner = "".join(element(r, depth + 1) + r.choice(["", " tail ", "\n"]) for _ in range(r.randrange(0, 4))) if depth < 5 else ""
        return f"<{tag}{r.choice(['', ' x=\"1\"', ' x=\"1\" y=\"2\"'])}>{r.choice(['', ' ', 'text', ' ñ &amp; '])}{inner}<!-- c --></{tag}>"

    for seed in range(30):
        r = random.Random(seed)
        text = f"<?xml version='1.0'?>\n<root xmlns:n='urn:n'>{''.join(element(r) for _ in range(3))}</root>"
        rows = src._elements(text)
        tags = {}
        for parent, depth, tag, clean, parent_tag, n_attributes, length in rows:
            held = tags.setdefault(clean, [0, False, False, set()])
            held[0] += 1
            held[1] |= n_attributes > 0
            held[2] |= length > 0
            if parent_tag is not None:
                tags[parent_tag][3].add(clean)
        want = {"root": rows[0][2], "total": len(rows), "max_depth": max(x[1] for x in rows), "attributes": sum(x[5] for x in rows),
                "text_length": sum(x[6] for x in rows), "tags": [
                    {"tag": t, "n": n, "attrs": a, "text": x, "children": sorted(c)} for t, (n, a, x, c) in tags.items()]}
        for chunk in (1, 7, 1 << 16):
            monkeypatch.setattr(src, "CHUNK", chunk)
            assert src.xml_summary(text) == want
    for bad in ("", "<a>", "<a></b>", "<a/><b/>", "text"):
        with pytest.raises(src.Unreadable):
            src.xml_summary(bad)


def test_xml_summary_of_a_large_document_keeps_little():
    import tracemalloc

    text = "<r>" + "<row id='1'><v>text</v></row>\n" * 100_000 + "</r>"
    tracemalloc.start()
    found = src.xml_summary(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["total"] == 200_001 and peak < 20 << 20


def test_counted_paths_and_tags_leave_a_task_when_there_are_many(spark, monkeypatch):
    from doclake.operators import rollups

    monkeypatch.setattr(src, "COUNTED_KEYS", 3)
    docs = [(1, '{"a":[1,{"b":2}],"x[0]":null}'), (2, '{"a":[],"c":{"a":1}}'), (3, "{"), (4, None), (5, '[[1],[2]]')]
    got = {(r.path, r.kind): (r.docs, r.nodes) for r in rollups.key_inventory(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)).collect()}
    assert got == {("$", "Object"): (2, 2), ("$.a", "Array"): (2, 2), ("$.a[*]", "Number"): (1, 1), ("$.a[*]", "Object"): (1, 1), ("$.a[*].b", "Number"): (1, 1),
                   ('$."x[*]"', "Null"): (1, 1), ("$.c", "Object"): (1, 1), ("$.c.a", "Number"): (1, 1), ("$", "Array"): (1, 1), ("$[*]", "Array"): (1, 2),
                   ("$[*][*]", "Number"): (1, 2)}
    xml = [(1, "<r a='1'><x>t</x><x/></r>"), (2, "<n:x xmlns:n='u'/>"), (3, "<r>")]
    tags = {r.clean_tag: tuple(r)[1:] for r in rollups.tag_inventory(spark.createDataFrame(xml, "doc_id bigint, text string")).collect()}
    assert tags == {"r": (1, 1, 1, 0), "x": (2, 3, 0, 1)}
