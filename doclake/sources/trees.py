"""JSON, YAML and XML documents → node and element tables (n1, s5, s6, x1).

Parsing is the one step Spark's built-ins cannot do here: ``VARIANT`` sorts object keys and refuses duplicates, YAML has
no reader, and the XPath functions fail the job on malformed input. Each helper below turns one document into flat
rows, a batch of documents at a time over Arrow; everything computed from those rows is Spark work. All rows of a
document leave the task that read it, next to each other, so grouping by document combines before the shuffle.
"""

from __future__ import annotations

import json
import re
import sys
import xml.etree.ElementTree as ET
import xml.parsers.expat as expat
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from doclake import fixed
from doclake.functions.frames import computed

FLUSH_ROWS = 50_000


class Unreadable(Exception):
    """A document that cannot be read, with the reason. ``noted``: the text is still shown, with the reason as a note."""

    def __init__(self, message: str, noted: bool = False):
        super().__init__(message)
        self.noted = noted

NODE_FIELDS = {
    "node_id": pa.int64(),       # document order, root 0
    "parent_id": pa.int64(),
    "path": pa.string(),
    "depth": pa.int64(),         # root 0
    "object_depth": pa.int64(),  # enclosing objects only
    "key": pa.string(),
    "ordinal": pa.int64(),       # position in the parent
    "kind": pa.string(),         # Object, Array, String, Number, Boolean, Null, Other
    "parent_kind": pa.string(),
    "type_name": pa.string(),
    "n_children": pa.int64(),
    "value": pa.string(),        # scalars only
    "key_rank": pa.int64(),      # largest key position on the way from the root
    "item_rank": pa.int64(),     # largest array position on the way from the root
    "last_id": pa.int64(),       # last descendant
    "branch_depth": pa.int64(),  # object_depth of the first object with 2+ keys along first children
    "object_text": pa.string(),  # printed value of shallow objects below an object
}
SHALLOW = 3  # deepest level that ``object_text`` is kept for

ELEMENT_FIELDS = {
    "ord": pa.int64(),  # document order, root 0
    "parent_ord": pa.int64(),
    "depth": pa.int64(),
    "tag": pa.string(),
    "clean_tag": pa.string(),
    "parent_tag": pa.string(),
    "n_attributes": pa.int64(),
    "text_length": pa.int64(),
}

_SPARK_TYPES = {pa.int64(): "bigint", pa.string(): "string"}


_KINDS = {dict: "Object", list: "Array", str: "String", bool: "Boolean", int: "Number", float: "Number", type(None): "Null"}


def step(path: str, key: str) -> str:
    return f"{path}.{key}" if key.replace("_", "a").isalnum() else f'{path}."{key}"'


def sound(text: str) -> str:
    """The text with lone surrogates replaced, which no column can hold."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def node_columns(root, out: dict[str, list], budget: int) -> int:
    """Append the nodes of one value tree, in document order, to the wanted columns; returns their number.

    ``budget`` is the number of nodes the text can spell out. References to earlier parts can make more of them, without end
    where a part holds itself; such a document is unreadable.
    """
    paths, texts = "path" in out, "object_text" in out
    nodes: list[tuple] = []
    children_of: list[int] = []
    stack = [(root, None, "$", 0, 0, None, 0, None, 0, 0)]
    while stack:
        node = stack.pop()
        v, _, path, depth, object_depth, _, _, _, key_rank, item_rank = node
        me = len(nodes)
        if me > budget:
            raise Unreadable("references repeat more than the text spells out")
        nodes.append(node)
        if type(v) is dict:
            children_of.append(len(v))
            stack.extend(reversed([
                (c, me, step(path, k) if paths else None, depth + 1, object_depth + 1, k, i, "Object",
                 i if i > key_rank else key_rank, item_rank)
                for i, (k, c) in enumerate((sound(str(k)), c) for k, c in v.items())
            ]))
        elif type(v) is list:
            children_of.append(len(v))
            stack.extend(reversed([
                (c, me, f"{path}[{i}]" if paths else None, depth + 1, object_depth, None, i, "Array",
                 key_rank, i if i > item_rank else item_rank)
                for i, c in enumerate(v)
            ]))
        else:
            children_of.append(0)
    values, parents, node_paths, depths, object_depths, keys, ordinals, parent_kinds, key_ranks, item_ranks = zip(*nodes)
    plain = {
        "parent_id": parents, "path": node_paths, "depth": depths, "object_depth": object_depths, "key": keys,
        "ordinal": ordinals, "parent_kind": parent_kinds, "key_rank": key_ranks, "item_rank": item_ranks,
        "n_children": children_of, "node_id": range(len(nodes)),
    }
    for name in out.keys() & plain.keys():
        out[name].extend(plain[name])
    if "kind" in out:
        out["kind"].extend([_KINDS.get(type(v), "Other") for v in values])
    if "type_name" in out:
        out["type_name"].extend([type(v).__name__ for v in values])
    if "value" in out:
        out["value"].extend([None if v is None or type(v) in (dict, list) else sound(str(v)) for v in values])
    if texts:
        out["object_text"].extend([
            sound(str(v)) if type(v) is dict and p == "Object" and d <= SHALLOW else None
            for v, p, d in zip(values, parent_kinds, depths)
        ])
    if "last_id" in out or "branch_depth" in out:
        last, branch = list(range(len(nodes))), [None] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            n = children_of[i]
            if parents[i] is not None and last[parents[i]] < last[i]:
                last[parents[i]] = last[i]
            branch[i] = object_depths[i] if n > 1 and type(values[i]) is dict else branch[i + 1] if n else None
        for name, column in (("last_id", last), ("branch_depth", branch)):
            if name in out:
                out[name].extend(column)
    return len(nodes)


def _yaml_loader():
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def json_value(text: str):
    """The value of a JSON text. Repeated keys (the last one counts), NaN and integers of any length are read."""
    sys.set_int_max_str_digits(0)
    try:
        return json.loads(text)
    except ValueError as e:
        raise Unreadable(str(e)) from None
    except RecursionError:
        raise Unreadable("nested too deeply") from None


def json_columns(text: str, out: dict[str, list]) -> int:
    """Append the nodes of a JSON text."""
    return node_columns(json_value(text), out, len(text) + 1)


_PLAIN = r"[A-Za-z0-9_\u00c0-\u024f](?:[A-Za-z0-9_\u00c0-\u024f .-]*[A-Za-z0-9_\u00c0-\u024f])?"
#: A line of block YAML without any special sign: indent, dash, key with or without a value, or an item.
_PLAIN_LINE = re.compile(rf"( *)(- )?(?:([A-Za-z_][A-Za-z0-9_-]*):(?: ({_PLAIN}))?|({_PLAIN}))")
_PLAIN_NUMBER = re.compile(r"0|[1-9][0-9]{0,17}")
_WORDS = frozenset({"y", "n", "yes", "no", "true", "false", "on", "off", "null"})
#: Longest line and deepest level that ``plain_yaml`` reads.
PLAIN_LENGTH, PLAIN_DEPTH = 500, 30
_UNSURE = object()


@lru_cache(10_000)
def _resolved(text: str):
    import yaml

    return yaml.load(text, Loader=_yaml_loader())


def _plain_scalar(text: str):
    """What YAML makes of a plain scalar: few words and what begins with a digit are no text."""
    if text[0].isdigit():
        return int(text) if _PLAIN_NUMBER.fullmatch(text) else _resolved(text)
    return _resolved(text) if text.lower() in _WORDS else text


def plain_yaml(text: str):
    """The value of a YAML text of plain lines only (block mappings and sequences of plain scalars), ``_UNSURE`` of any other.

    Most settings are such texts, which a pass over their lines reads several times faster; the YAML parser reads all others.
    """
    root, pending = None, None
    stack: list[tuple[int, dict | list, bool]] = []  # indent, container, whether it is a sequence at its key's indent
    for line in text.removesuffix("\n").split("\n"):
        row = _PLAIN_LINE.fullmatch(line) if len(line) <= PLAIN_LENGTH else None
        if row is None:
            return _UNSURE
        indent, dash, key, value, item = row.groups()
        n, kind = len(indent), list if dash else dict
        if root is None:
            if n:
                return _UNSURE
            root = kind()
            stack.append((0, root, False))
        elif pending is not None:
            holder, name, at = pending
            if n > at or (n == at and dash):
                holder[name] = below = kind()
                stack.append((n, below, n == at))
        pending = None
        while stack and (stack[-1][0] > n or (stack[-1][2] and stack[-1][0] == n and not dash)):
            stack.pop()
        if not stack or stack[-1][0] != n or type(stack[-1][1]) is not kind or len(stack) > PLAIN_DEPTH:
            return _UNSURE
        held = stack[-1][1]
        try:
            if key is None:
                if not dash:
                    return _UNSURE
                held.append(_plain_scalar(item))
                continue
            if key.lower() in _WORDS:
                return _UNSURE
            if dash:
                n += 2
                held.append({})
                held = held[-1]
                stack.append((n, held, False))
            held[key] = None if value is None else _plain_scalar(value)
        except Exception:  # a value that its type refuses: the parser says how
            return _UNSURE
        if value is None:
            pending = (held, key, n)
    return root


def yaml_value(text: str):
    """The value of a YAML text. A key near the root that is not text makes the document unreadable, as does a value that its own
    type refuses (a date that does not exist)."""
    import yaml

    sys.set_int_max_str_digits(0)
    root = plain_yaml(text)
    if root is not _UNSURE:  # its keys are text, and it has no references
        return root
    try:
        root = yaml.load(text, Loader=_yaml_loader())
    except yaml.YAMLError as e:
        raise Unreadable(sound(str(e)), noted=True) from None
    except RecursionError:
        raise Unreadable("nested too deeply") from None
    except (ValueError, TypeError, OverflowError, AttributeError, KeyError) as e:
        raise Unreadable(sound(str(e))) from None
    if _odd_key(root, 0):
        raise Unreadable("a key is not text")
    size, most = spelled_out(root), max(SPELLED_OUT, SPELLED_TIMES * len(text))
    if size is None or size > most:
        raise Unreadable("references repeat more than the text spells out")
    return root


def yaml_columns(text: str, out: dict[str, list]) -> int:
    """Append the nodes of a YAML text."""
    return node_columns(yaml_value(text), out, max(SPELLED_OUT, SPELLED_TIMES * len(text)))


#: A YAML text may spell out so many nodes and characters by its references, or so many times its length where that is more.
SPELLED_OUT, SPELLED_TIMES = 100_000, 20


def spelled_out(root) -> int | None:
    """Nodes and characters of a value tree with its references written out, None where a part holds itself; each part is met once."""
    sizes: dict[int, int | None] = {}  # None while a container is open
    stack = [(root, False)]
    parts = lambda v: v.values() if type(v) is dict else v
    scalar = lambda v: 1 + (len(v) if isinstance(v, (str, bytes)) else 0)
    while stack:
        v, done = stack.pop()
        if type(v) not in (dict, list):
            continue
        if done:
            keys = sum(len(str(k)) for k in v) if type(v) is dict else 0
            sizes[id(v)] = 1 + keys + sum(sizes[id(c)] if type(c) in (dict, list) else scalar(c) for c in parts(v))
        elif id(v) not in sizes:
            sizes[id(v)] = None
            stack.append((v, True))
            stack.extend((c, False) for c in parts(v))
        elif sizes[id(v)] is None:  # still open: what is met now stands inside it
            return None
    return sizes.get(id(root), 1)


def _odd_key(v, depth: int) -> bool:
    if depth > 2:
        return False
    if isinstance(v, dict):
        return any(not isinstance(k, str) or _odd_key(c, depth + 1) for k, c in v.items())
    return isinstance(v, list) and any(_odd_key(c, depth + 1) for c in v)


_DECLARED = re.compile(rb"^\s*<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def xml_text(raw: bytes) -> str | None:
    """Text of XML bytes in the encoding they declare or begin with; None where the bytes are not in it."""
    declared = _DECLARED.match(raw)
    name = next((n for mark, n in _MARKS if raw.startswith(mark)), declared[1].decode() if declared else "utf-8")
    try:
        return raw.decode(name).replace("\r\n", "\n").replace("\r", "\n")
    except (UnicodeDecodeError, LookupError):
        return None


def _undeclared(text: str) -> str:
    """The text without its declaration, as it has no bytes left that this could be about."""
    return re.sub(r"^\s*<\?xml[^>]*\?>", "", text.removeprefix("\ufeff"), count=1)


def _root(text: str):
    try:
        return ET.fromstring(_undeclared(text))
    except (ET.ParseError, ValueError) as e:
        raise Unreadable(str(e)) from None


def _elements(text: str) -> list[tuple]:
    rows: list[tuple] = []
    stack = [(_root(text), None, None, 0)]
    while stack:
        e, parent, parent_tag, depth = stack.pop()
        clean = e.tag.split("}", 1)[-1]
        rows.append((parent, depth, e.tag, clean, parent_tag, len(e.attrib), len((e.text or "").strip())))
        me = len(rows) - 1
        stack.extend([(child, me, clean, depth + 1) for child in reversed(e)])
    return rows


def xml_columns(text: str, out: dict[str, list]) -> int:
    """Append the elements of one document, in document order."""
    rows = _elements(text)
    columns = dict(zip(["parent_ord", "depth", "tag", "clean_tag", "parent_tag", "n_attributes", "text_length"], zip(*rows)))
    columns["ord"] = range(len(rows))
    for name in out:
        out[name].extend(columns[name])
    return len(rows)


READERS: dict[str, Callable[[str, dict[str, list]], int]] = {"json": json_columns, "yaml": yaml_columns, "xml": xml_columns}

# ---- summaries ----------------------------------------------------------------------------------

#: What a report says of a whole tree, and of a whole XML document.
TREE = "struct<root_type:string,max_depth:bigint,total_keys:bigint,kinds:array<string>>"
XML = (
    "struct<root:string,total:bigint,max_depth:bigint,attributes:bigint,text_length:bigint,"
    "tags:array<struct<tag:string,n:bigint,attrs:boolean,text:boolean,children:array<string>>>>"
)
#: Characters of an XML text that are parsed at a time.
CHUNK = 1 << 16

#: Whether a report shows a node with this depth, object depth, key rank and item rank; nothing below a hidden node is shown.
_SHOWN: dict[str, Callable[[int, int, int, int], bool]] = {
    "json": lambda depth, objects, key, item: key < fixed.OUTLINE_KEYS and item == 0 and objects <= fixed.OUTLINE_DEPTH + 1,
    "yaml": lambda depth, objects, key, item: depth <= fixed.CONFIG_KEY_DEPTH + 1,
}


def _branch_depth(v, objects: int) -> int | None:
    """Object depth of the first object with several keys along first children."""
    while type(v) in (dict, list) and v:
        if type(v) is dict and len(v) > 1:
            return objects
        objects += type(v) is dict
        v = next(iter(v.values())) if type(v) is dict else v[0]
    return None


def tree_summary(root, reader: str, out: dict[str, list]) -> tuple[int, dict]:
    """Append the shown nodes of a value tree to the wanted columns; returns their number and the statistics of all nodes.

    What is not shown is counted level by level and never becomes a node.
    """
    shown = _SHOWN[reader]
    deepest = keys = count = kept = 0
    types: set[type] = set()

    def hidden(level: list, depth: int) -> int:
        nonlocal deepest, keys
        n = 0
        while level:
            n += len(level)
            deepest = max(deepest, depth)
            found = set(map(type, level))
            types.update(found)
            if dict not in found and list not in found:
                break
            below: list = []
            for v in level:
                if type(v) is dict:
                    keys += len(v)
                    below.extend(v.values())
                elif type(v) is list:
                    below.extend(v)
            level, depth = below, depth + 1
        return n

    stack: list[tuple] = [(root, 0, 0, None, 0, None, 0, 0)]
    while stack:
        node = stack.pop()
        if len(node) == 2:  # all below a shown node has been met, but for what is hidden
            at, rest = node
            count += rest
            if "last_id" in out:
                out["last_id"][at] = count - 1
            continue
        v, depth, objects, key, ordinal, parent_kind, key_rank, item_rank = node
        kind = type(v)
        types.add(kind)
        deepest = max(deepest, depth)
        if kind is dict:
            keys += len(v)
            below = [(c, depth + 1, objects + 1, sound(str(k)), i, "Object", max(i, key_rank), item_rank) for i, (k, c) in enumerate(v.items())]
        elif kind is list and shown(depth + 1, objects, key_rank, max(1, item_rank)):
            below = [(c, depth + 1, objects, None, i, "Array", key_rank, max(i, item_rank)) for i, c in enumerate(v)]
        elif kind is list:
            below = [(c, depth + 1, objects, None, 0, "Array", key_rank, item_rank) for c in v[:1]]
        else:
            below = []
        seen = [c for c in below if shown(c[1], c[2], c[6], c[7])]
        whole = list(v.values()) if kind is dict else v if kind is list else []
        # ranks only rise along a container, so what is shown comes first
        rest = hidden(whole[len(seen):], depth + 1) if len(seen) < len(whole) else 0
        value = None if v is None or kind in (dict, list) else sound(str(v))
        text = sound(str(v)) if "object_text" in out and kind is dict and parent_kind == "Object" and depth <= SHALLOW else None
        fields = {
            "node_id": count, "depth": depth, "object_depth": objects, "key": key, "ordinal": ordinal, "kind": _KINDS.get(kind, "Other"),
            "parent_kind": parent_kind, "type_name": kind.__name__, "n_children": len(whole), "value": value, "key_rank": key_rank,
            "item_rank": item_rank, "last_id": count, "branch_depth": _branch_depth(v, objects) if "branch_depth" in out else None, "object_text": text,
        }
        for name in out:
            out[name].append(fields[name])
        at = len(out["last_id"]) - 1 if "last_id" in out else 0
        count += 1
        kept += 1
        stack.append((at, rest))
        stack.extend(reversed(seen))
    names = {_KINDS.get(t, "Other") for t in types}
    reported = sorted({"Number" if n == "Boolean" else n for n in names} - {"Other"})
    return kept, {"root_type": type(root).__name__, "max_depth": deepest, "total_keys": keys, "kinds": reported}


def _well_formed(text: str) -> None:
    """What ``xml_summary`` raises of a text, without a look at its elements. Only texts with a document type can have references that
    the parser alone lets pass."""
    bare = _undeclared(text)
    if "<!DOCTYPE" in bare:
        xml_summary(text)
        return
    parser = expat.ParserCreate(None, "}")
    try:
        parser.Parse(bare, True)
    except (expat.ExpatError, ValueError) as e:
        raise Unreadable(str(e)) from None


def xml_summary(text: str) -> dict:
    """Totals of an XML document and of each tag, in order of appearance; elements are dropped as soon as they end."""
    if len(text) <= CHUNK:
        return _small_summary(_root(text))
    parser = ET.XMLPullParser(("start", "end"))
    stack: list = []
    tags: dict[str, list] = {}
    root, total, deepest, attributes, length = None, 0, 0, 0, 0

    def read() -> None:
        nonlocal root, total, deepest, attributes, length
        for event, e in parser.read_events():
            clean = e.tag.split("}", 1)[-1]
            if event == "start":
                root = e.tag if root is None else root
                total += 1
                deepest = max(deepest, len(stack))
                attributes += len(e.attrib)
                held = tags.setdefault(clean, [0, False, False, set()])
                held[0] += 1
                held[1] |= bool(e.attrib)
                if stack:
                    tags[stack[-1].tag.split("}", 1)[-1]][3].add(clean)
                stack.append(e)
            else:
                own = len((e.text or "").strip())
                length += own
                tags[clean][2] |= own > 0
                stack.pop()
                e.clear()
                if stack:
                    stack[-1].remove(e)

    bare = _undeclared(text)
    try:
        for at in range(0, len(bare), CHUNK):
            parser.feed(bare[at : at + CHUNK])
            read()
        parser.close()
        read()
    except (ET.ParseError, ValueError) as e:
        raise Unreadable(str(e)) from None
    return _summary_of(root, total, deepest, attributes, length, tags)


def _summary_of(root: str, total: int, deepest: int, attributes: int, length: int, tags: dict[str, list]) -> dict:
    return {"root": root, "total": total, "max_depth": deepest, "attributes": attributes, "text_length": length, "tags": [
        {"tag": t, "n": n, "attrs": a, "text": x, "children": sorted(c)} for t, (n, a, x, c) in tags.items()]}


def _small_summary(root) -> dict:
    """``xml_summary`` of the elements of a text that is held whole."""
    tags: dict[str, list] = {}
    total = deepest = attributes = length = 0
    stack = [(root, 0, None)]
    while stack:
        e, depth, siblings = stack.pop()
        clean = e.tag.split("}", 1)[-1]
        total += 1
        deepest = max(deepest, depth)
        own = len((e.text or "").strip())
        length += own
        n = len(e.attrib)
        attributes += n
        held = tags.get(clean)
        if held is None:
            held = tags[clean] = [0, False, False, set()]
        held[0] += 1
        held[1] |= n > 0
        held[2] |= own > 0
        if siblings is not None:
            siblings.add(clean)
        if len(e):
            stack.extend([(c, depth + 1, held[3]) for c in reversed(e)])
    return _summary_of(root.tag, total, deepest, attributes, length, tags)


def _exploded(docs: DataFrame, append: Callable[[str, dict[str, list]], int], fields: dict) -> DataFrame:
    """Apply ``append`` to every text and emit what it gathers in Arrow batches of bounded size."""
    names = list(fields)
    schema = pa.schema([("doc_id", pa.int64())] + [(n, fields[n]) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        columns: dict[str, list] = {n: [] for n in names}

        def flush() -> pa.RecordBatch:
            data = [ids, *columns.values()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, schema.types)], schema=schema)
            for v in data:
                v.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text.is_valid:
                    try:
                        ids.extend([doc_id] * append(text.as_py(), columns))
                    except Unreadable:
                        continue
                    if len(ids) >= FLUSH_ROWS:
                        yield flush()
        if ids:
            yield flush()

    ddl = "doc_id bigint, " + ", ".join(f"{n} {_SPARK_TYPES[fields[n]]}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def json_nodes(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """n1: one row per node of every JSON document; only the named fields are built. ``with_trees`` tells which had none and why."""
    return _exploded(docs, json_columns, {n: NODE_FIELDS[n] for n in fields or NODE_FIELDS})


def yaml_nodes(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """s6: the same table for YAML documents."""
    return _exploded(docs, yaml_columns, {n: NODE_FIELDS[n] for n in fields or NODE_FIELDS})


def xml_elements(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """s5, x1: one row per element of every well-formed XML document."""
    return _exploded(docs, xml_columns, {n: ELEMENT_FIELDS[n] for n in fields or ELEMENT_FIELDS})


#: Different keys that a task counts before they leave it.
COUNTED_KEYS = 100_000
_POSITION = re.compile(r"\[[0-9]+\]")


def _counted(docs: DataFrame, keys_of: Callable[[str], dict[tuple, list[int]]], keys: list[str], sums: list[str]) -> DataFrame:
    """(keys, docs, sums) of the documents of a task, counted before they leave it; ``keys_of`` is what one text has of each key."""
    schema = pa.schema([*((k, pa.string()) for k in keys), *((n, pa.int64()) for n in ("docs", *sums))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((*k, *v) for k, v in total.items()))) or [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
            total.clear()
            return batch

        for b in batches:
            for text in b.column("text"):
                if not text.is_valid:
                    continue
                try:
                    found = keys_of(text.as_py())
                except Unreadable:
                    continue
                for key, values in found.items():
                    held = total.get(key)
                    if held is None:
                        total[key] = [1, *values]
                    else:
                        held[0] += 1
                        for i, v in enumerate(values, 1):
                            held[i] += v
                if len(total) >= COUNTED_KEYS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, ", ".join(f"{f.name} {_SPARK_TYPES[f.type]}" for f in schema))


def json_path_counts(docs: DataFrame) -> DataFrame:
    """r4: (path, kind, docs, nodes) of the JSON documents of each task; array positions are dropped from paths."""
    steps: dict[str, str] = {}

    def paths(text: str) -> dict[tuple, list[int]]:
        found: dict[tuple, list[int]] = {}
        stack = [(json_value(text), "$")]
        while stack:
            v, path = stack.pop()
            kind = type(v)
            found.setdefault((path, _KINDS.get(kind, "Other")), [0])[0] += 1
            if kind is dict:
                for k, child in v.items():
                    if k not in steps:
                        if len(steps) > COUNTED_KEYS:
                            steps.clear()
                        steps[k] = _POSITION.sub("[*]", step("", sound(str(k))))
                    stack.append((child, path + steps[k]))
            elif kind is list:
                path += "[*]"
                stack += [(child, path) for child in v]
        return found

    return _counted(docs, paths, ["path", "kind"], ["nodes"])


def xml_tag_counts(docs: DataFrame) -> DataFrame:
    """r3: (clean_tag, docs, elements, attributes, text_length) of the XML documents of each task."""

    def tags(text: str) -> dict[tuple, list[int]]:
        found: dict[tuple, list[int]] = {}
        for e in _root(text).iter():
            held = found.setdefault((e.tag.split("}", 1)[-1],), [0, 0, 0])
            held[0] += 1
            held[1] += len(e.attrib)
            held[2] += len((e.text or "").strip())
        return found

    return _counted(docs, tags, ["clean_tag"], ["elements", "attributes", "text_length"])


def with_trees(rows: DataFrame, reader: str = "reader", wanted: str | None = None, node_fields: list[str] | None = None,
               element_fields: list[str] | None = None, raw: str | None = None, summary: bool = False) -> DataFrame:
    """``rows`` (text and any other columns) with what one parser pass finds, beside each text:

    ``status`` (``ok``, ``noted``, ``malformed``; null for readers without a tree), ``error``, and ``nodes`` or ``elements`` as arrays in document
    order. ``reader`` is a column or one of the reader names; where the column ``wanted`` is false, only status and error are
    found. ``raw`` is a column of XML bytes that are not UTF-8; they are decoded as they declare, and ``text`` is set. With ``summary``,
    ``nodes`` has only what a report shows, and ``tree`` or ``xml`` the statistics of the whole; nothing else is kept of a document.

    Nothing is joined or shuffled, so ids may be null or repeated. Only texts that have a tree go to Python, and their nodes come back
    as soon as there are FLUSH_ROWS of them.
    """
    fields = {n: NODE_FIELDS[n] for n in node_fields or NODE_FIELDS}
    types = {"nodes": fields} if summary else {"nodes": fields, "elements": {n: ELEMENT_FIELDS[n] for n in element_fields or ELEMENT_FIELDS}}
    ddl = lambda fields: "array<struct<" + ",".join(f"{n}:{_SPARK_TYPES[t]}" for n, t in fields.items()) + ">>"
    whole = f", tree {TREE}, xml {XML}" if summary else ""
    found = T.StructType.fromDDL("status string, error string, " + ", ".join(f"{n} {ddl(f)}" for n, f in types.items()) + whole + ", decoded string")

    # of the driver, as workers cannot read a DDL string
    wholes = {n: to_arrow_type(found[n].dataType) for n in ("tree", "xml")} if summary else {}

    def parse(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            held = _Parsed(types, wholes)
            kinds, texts, raws, wanted_of = batch
            has_raw = raws.null_count < len(raws)
            for i, (kind, asked) in enumerate(zip(kinds.to_pylist(), wanted_of.to_pylist())):
                if held.size >= FLUSH_ROWS:
                    yield held.array()
                    held = _Parsed(types, wholes)
                if kind is None:
                    held.add(None, None, None, asked)
                else:
                    held.add(kind, texts[i].as_py(), raws[i].as_py() if has_raw else None, asked)
            if held.status:
                yield held.array()

    kept = [c for c in rows.columns if c not in found.names]
    kind = F.col(reader) if reader in kept else F.lit(reader)
    has_tree = kind.isin(*READERS)
    asked = F.col(wanted) if wanted else F.lit(True)
    data = F.when(has_tree, F.col(raw)) if raw else F.lit(None).cast("binary")
    parsed = F.arrow_udf(parse, found)(F.when(has_tree, kind), F.when(has_tree, F.col("text")), data, asked)
    with_found = computed(rows.select(*kept), {"__found": parsed})
    text = {"text": F.coalesce("__found.decoded", "text")} if raw else {}
    return with_found.withColumns(text | {n: F.col(f"__found.{n}") for n in found.names[:-1]}).drop("__found", *([raw] if raw else []))


class _Parsed:
    """Results of the documents of a batch so far."""

    def __init__(self, types: dict[str, dict], wholes: dict[str, pa.DataType]):
        self.types, self.wholes, self.size = types, wholes, 0
        self.status: list[str | None] = []
        self.error: list[str | None] = []
        self.decoded: list[str | None] = []
        self.columns = {kind: {f: [] for f in fields} for kind, fields in types.items()}
        self.sizes: dict[str, list[int | None]] = {kind: [] for kind in types}
        self.tree: list[dict | None] = []
        self.xml: list[dict | None] = []

    def add(self, reader: str | None, text: str | None, raw: bytes | None, asked: bool | None) -> None:
        decoded = xml_text(raw) if raw is not None else None
        text = decoded if raw is not None else text
        status = error = tree = xml = None
        sizes = dict.fromkeys(self.types)
        if reader is not None and text is not None:
            try:
                if reader == "xml" and self.wholes:
                    if asked:
                        xml = xml_summary(text)
                        self.size += len(xml["tags"])
                    else:
                        _well_formed(text)
                elif self.wholes:
                    root = json_value(text) if reader == "json" else yaml_value(text)
                    if asked:
                        sizes["nodes"], tree = tree_summary(root, reader, self.columns["nodes"])
                        self.size += sizes["nodes"]
                else:
                    kind = "elements" if reader == "xml" else "nodes"
                    n = READERS[reader](text, self.columns[kind] if asked else {})
                    sizes[kind] = n if asked else None
                    self.size += n
                status = "ok"
            except Unreadable as e:
                status, error = "noted" if e.noted else "malformed", str(e)
        self.status.append(status)
        self.error.append(error)
        self.decoded.append(decoded)
        self.tree.append(tree)
        self.xml.append(xml)
        for kind, size in sizes.items():
            self.sizes[kind].append(size)

    def array(self) -> pa.Array:
        arrays = [pa.array(self.status, pa.string()), pa.array(self.error, pa.string())]
        for kind, fields in self.types.items():
            offsets = [0]
            for size in self.sizes[kind]:
                offsets.append(offsets[-1] + (size or 0))
            values = pa.StructArray.from_arrays([pa.array(self.columns[kind][f], t) for f, t in fields.items()], names=list(fields))
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([size is None for size in self.sizes[kind]])))
        names = ["status", "error", *self.types]
        for name, kind in self.wholes.items():
            arrays.append(pa.array(getattr(self, name), kind))
            names.append(name)
        return pa.StructArray.from_arrays([*arrays, pa.array(self.decoded, pa.string())], names=[*names, "decoded"])


def document_status(docs: DataFrame, reader: str) -> DataFrame:
    """(doc_id, status, error) of every document: what the node and element tables leave out, and why."""
    return with_trees(docs.select("doc_id", "text"), reader, node_fields=["kind"], element_fields=["depth"]).select("doc_id", "status", "error")


def yaml_errors(docs: DataFrame) -> DataFrame:
    """s6: the malformed YAML documents with the parser's message; ``document_status`` has every other reason, too."""
    found = with_trees(docs.select("doc_id", "text"), "yaml", node_fields=["kind"], element_fields=["depth"])
    return found.filter("status = 'noted'").select("doc_id", "error")
