"""One nested record -> ordered (key, cleaned key, value) entries.

Document order decides between two keys with the same last part; Spark's own JSON and XML
functions need a schema or sort the keys, so this step runs in Arrow batches. Records are
read as streams of parser events and unfolded with an explicit stack: their depth has no
limit. A record that cannot be unfolded keeps its raw text and has no entries.
"""

from __future__ import annotations

import json
import re
import sys
from collections import Counter
from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake import fixed

ENTRIES = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
]))
#: entries and, per canonical field, the place among them of the one that fills it
PLACED = T.StructType([T.StructField("entries", ENTRIES), T.StructField("at", T.ArrayType(T.IntegerType()))])
#: cleaned name -> (canonical field, place among its aliases)
ALIASES: dict[str, list] = {}
for _field, _names in enumerate(fixed.CANONICAL_ALIASES.values()):
    for _place, _name in enumerate(_names):
        ALIASES.setdefault(_name, []).append((_field, _place))
NOWHERE = [None] * len(fixed.CANONICAL_ALIASES)
# executors get these helpers by value, so they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unfold(key, value, members) -> list:
    """Leaves below ``value`` in document order. ``members(key, value)`` lists the (key, value)
    pairs one level down, or is None for a leaf."""
    leaves, todo = [], [(key, value)]
    while todo:
        key, value = todo.pop()
        below = members(key, value)
        if below is None:
            leaves.append((key, value))
        else:
            todo.extend(reversed(below))
    return leaves


def json_members(key, value):
    if isinstance(value, dict):
        prefix = f"{key}." if key else ""
        return [(prefix + name, child) for name, child in value.items()]
    if isinstance(value, list):
        return [(f"{key}[{at}]" if key else str(at), child) for at, child in enumerate(value)]
    return None


def json_leaves(record: dict) -> list:
    """The same as unfolding a record with ``json_members``, without a list per level."""
    leaves, todo = [], [("", iter(record.items()))]
    while todo:
        prefix, below = todo[-1]
        for name, value in below:
            kind, key = value.__class__, prefix + name
            if kind is dict:
                todo.append((f"{key}." if key else "", iter(value.items())))
                break
            if kind is list:
                shape = "[%d]" if key else "%d"
                todo.append((key, iter([(shape % at, child) for at, child in enumerate(value)])))
                break
            leaves.append((key, value))
        else:
            todo.pop()
    return leaves


class Node:
    """An XML element: local name, attributes without namespace declarations, text before
    the first child, children, and where it stands in the document's bytes."""

    __slots__ = ("name", "attributes", "text", "children", "start", "stop", "filled")

    def __init__(self, name, attributes, start):
        self.name = name.rpartition(":")[2]
        self.attributes = {k: v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}
        self.text, self.children, self.start, self.stop, self.filled = [], [], start, start, False


def parse(data: bytes, depth: int | None = None) -> Node | None:
    """Root of a document; below ``depth`` nothing is kept. None where it is not well formed."""
    reader, top, path = expat.ParserCreate("utf-8"), Node("", {}, 0), []
    reader.buffer_text = True
    path.append(top)

    def begin(name, attributes):
        node = Node(name, attributes, reader.CurrentByteIndex)
        path[-1].filled = True
        if depth is None or len(path) <= depth:
            path[-1].children.append(node)
        path.append(node)

    def end(_):
        node = path.pop()
        node.stop = reader.CurrentByteIndex

    def characters(text):
        path[-1].filled = True
        if not path[-1].children:
            path[-1].text.append(text)

    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = begin, end, characters
    try:
        reader.Parse(data, True)
    except expat.ExpatError:
        return None
    return top.children[0]


def element(document: str) -> Element | None:
    """Root of a record whose places in the text do not matter: the parser's events go straight to
    the tree, without Python in between. Names keep their prefixes. None where it is not well formed."""
    reader, tree = expat.ParserCreate("utf-8"), TreeBuilder()
    reader.buffer_text = True
    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = tree.start, tree.end, tree.data
    try:
        reader.Parse(document.encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return None
    return tree.close()


def local(name: str) -> str:
    return name.rpartition(":")[2]


def xml_members(key, node):
    """Attributes, then children by first appearance of their tag; a tag that comes again is a list."""
    if isinstance(node, str):
        return None
    own = (node.text or "").strip()
    prefix = f"{key}." if key else ""
    found = [(f"{prefix}@{k}", v) for k, v in node.attrib.items() if k != "xmlns" and not k.startswith("xmlns:")]
    if not len(node):
        return found + ([(f"{prefix}#text", own)] if own else []) if found else [(key, own)]
    by_tag: dict[str, list] = {}
    for child in node:
        by_tag.setdefault(local(child.tag), []).append(child)
    for name, same in by_tag.items():
        if len(same) == 1:
            found.append((prefix + name, same[0]))
        else:
            found += [(f"{prefix}{name}[{at}]", child) for at, child in enumerate(same)]
    return found


def event_entries(event: Element) -> list:
    """A Windows event: named data items by their names, every other section unfolded."""
    out = []
    for section in event:
        if local(section.tag) not in ("EventData", "UserData"):
            out += unfold(local(section.tag), section, xml_members)
            continue
        for node in section.iter():
            if local(node.tag) == "Data" and node.attrib.get("Name"):
                out.append((node.attrib["Name"], (node.text or "").strip()))
    return out


def sound(value) -> str | None:
    """Text that UTF-8 can hold: halves of surrogate pairs become question marks."""
    if value is None:
        return None
    value = str(value)
    return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def _columns(records, places: bool):
    """Pairs per record (None = no record) -> entry lists and, where asked, what fills the fields.

    Of the entries with a value the one with the earliest alias fills a field, the last of those
    with the same cleaned key. Records may come from a generator, so that none is kept.
    """
    offsets, codes, values, missing, found = [0], [], [], [], []
    known, keys, names, fills = {}, [], [], []  # keys repeat from record to record
    for pairs in records:
        missing.append(pairs is None)
        at, best = (NOWHERE.copy(), {}) if places else (None, None)
        # a full key seen twice keeps its first place and takes the later value
        for place, (key, value) in enumerate(dict(pairs or ()).items()):
            code = known.get(key)
            if code is None:
                code = known[key] = len(keys)
                keys.append(sound(key))
                # same rule as text.clean_key
                names.append(re.sub(r"[\s\-]+", "_", keys[-1].rpartition(".")[2].strip().lower()))
                fills.append(ALIASES.get(names[-1], ()))
            value = sound(value)
            codes.append(code)
            values.append(value)
            if places and value:
                for field, rank in fills[code]:
                    if rank <= best.get(field, rank):
                        at[field], best[field] = place, rank
        if places:
            found += at
        offsets.append(len(codes))
    codes = pa.array(codes, pa.int32())
    entries = pa.StructArray.from_arrays(
        [pa.array(keys, pa.string()).take(codes), pa.array(names, pa.string()).take(codes), pa.array(values, pa.string())],
        names=["key", "name", "value"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries, mask=pa.array(missing, pa.bool_())), missing, found


def to_arrow(records) -> pa.Array:
    """Pairs per record (None = no record) -> one Arrow array of entry lists."""
    return _columns(records, False)[0]


def to_placed(records) -> pa.Array:
    """Pairs per record (None = no record) -> one Arrow array of ``PLACED``."""
    entries, missing, found = _columns(records, True)
    width = len(NOWHERE)
    at = pa.ListArray.from_arrays(pa.array(range(0, len(missing) * width + 1, width), pa.int32()), pa.array(found, pa.int32()))
    return pa.StructArray.from_arrays([entries, at], names=["entries", "at"], mask=pa.array(missing, pa.bool_()))


def json_record(document: str | None):
    try:
        record = json.loads(document)
    except RecursionError:
        return []
    except (TypeError, ValueError):
        return None
    return json_leaves(record) if isinstance(record, dict) else None


def xml_record(document: str | None):
    root = None if document is None else element(document)
    if root is None:
        return None
    return event_entries(root) if local(root.tag).lower() == "event" else unfold("", root, xml_members)


def whole(data: bytes, node: Node) -> bytes:
    """Bytes of an element: ``stop`` is where its end tag begins, or the end of ``<name/>``."""
    text = data[node.start:node.stop]
    return text if not node.filled and text.endswith(b"/>") else data[node.start:data.index(b">", node.stop) + 1]


def record_texts(document: str | None):
    """Texts of the record elements of a whole document, as they stand in it."""
    if document is None:
        return None
    body = document.strip().lstrip("﻿").encode("utf-8", "replace")
    # a file of sibling elements is read inside a root of our own
    bare = re.sub(rb"^\s*<\?xml[^>]*\?>", b"", body)
    for data in (body, b"<root>" + bare + b"</root>"):
        root = parse(data, depth=2)
        if root is None:
            continue
        if root.name.lower() == "event":
            return [body.decode("utf-8")]
        if not root.children:
            return []
        wanted = Counter(child.name for child in root.children).most_common(1)[0][0]  # the first seen of equals
        return [whole(data, c).decode("utf-8") for c in root.children if c.name == wanted]
    return None


@F.arrow_udf(PLACED)
def json_entries(documents: pa.Array) -> pa.Array:
    """Entries of a JSON object text and their places; NULL for anything that is not one."""
    return to_placed(json_record(d) for d in documents.to_pylist())


@F.arrow_udf(PLACED)
def xml_entries(documents: pa.Array) -> pa.Array:
    """Entries of one XML record and their places; NULL where it does not parse."""
    return to_placed(xml_record(d) for d in documents.to_pylist())


@F.arrow_udf(T.ArrayType(T.StringType()))
def xml_children(documents: pa.Array) -> pa.Array:
    """Record element texts of one whole document; NULL where it does not parse."""
    return pa.array([record_texts(d) for d in documents.to_pylist()], pa.list_(pa.string()))


# a filter on the result must not be pushed below these helpers, it would run them twice
json_entries = json_entries.asNondeterministic()
xml_entries = xml_entries.asNondeterministic()
xml_children = xml_children.asNondeterministic()
