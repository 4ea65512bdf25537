"""Deeply nested records turned into flat tables that keep every child's link to its parent.

Objects of varying presence are classified bottom-up by a tree automaton: leaves have the state of
their JSON type, an array the states of its elements, an object the states of its keys. An object's
state is its structural variant. ``routed`` sends each object to the folder of its array, the rows of
a variant side by side; ``key_catalog`` tells which keys the variants have, with what types, and
which are common to all; ``subtype_table`` reads one array, or one variant, as a table with typed
columns beside the link to the parent, and what no column holds in a map. Structs whose type is
known go through the same automaton as column expressions (``state_of``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

NODE = "root_id string, array_name string, position int, pointer string, parent_pointer string, shape string, fields map<string,string>, kinds map<string,string>"
NODES = "root_id string, nodes array<struct<array_name:string, position:int, pointer:string, parent_pointer:string, shape:string, fields:map<string,string>, kinds:map<string,string>>>"
ARRAYS = ("modules", "components", "tab", "module_group", "module")


def token(key: str) -> str:
    """A key as a token of a JSON pointer (RFC 6901)."""
    return key.replace("~", "~0").replace("/", "~1")


def states(value) -> dict[int, str]:
    """States of all objects and arrays of a parsed JSON value by their id(), bottom-up and without recursion.

    An object inside another one stands in the outer state by a hash of its own state, so that states stay short.
    """
    order, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, (dict, list)):
            order.append(v)
            stack.extend(v.values() if isinstance(v, dict) else v)
    known: dict[int, str] = {}

    def inner(v) -> str:
        if isinstance(v, dict):
            return "{#" + hashlib.sha256(known[id(v)].encode("utf-8", "surrogatepass")).hexdigest()[:16] + "}"
        return known[id(v)] if isinstance(v, list) else _leaf(v)

    for v in reversed(order):  # children stand behind their parents
        if isinstance(v, list):
            known[id(v)] = "[" + "|".join(sorted({inner(x) for x in v})) + "]"
        else:
            known[id(v)] = "{" + ",".join(f"{k}:{inner(x)}" for k, x in sorted(v.items())) + "}"
    return known


def _leaf(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return "number" if isinstance(value, (int, float)) else "string"


def state(value) -> str:
    """State of a parsed JSON value: of the leaf's type, of the elements, or of the keys."""
    return states(value)[id(value)] if isinstance(value, (dict, list)) else _leaf(value)


def _kind(value) -> str:
    """The type a key's column needs: that of a leaf, scalars for an array of leaves, else object or array."""
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array" if any(isinstance(x, (dict, list)) for x in value) else "scalars"
    return _leaf(value)


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def nodes_of(value, arrays: frozenset[str]) -> list[dict]:
    """A row for each object that lies in an array of one of the names, without recursion."""
    out: list[dict] = []
    known = states(value)
    stack = [(value, "", "", None, 0)]
    while stack:
        node, pointer, parent, name, position = stack.pop()
        if isinstance(node, dict):
            if name in arrays:
                flat = {k: _text(v) for k, v in node.items() if v is not None and not isinstance(v, dict) and not (isinstance(v, list) and any(isinstance(x, (dict, list)) for x in v))}
                out.append({"array_name": name, "position": position, "pointer": pointer, "parent_pointer": parent, "shape": known[id(node)], "fields": list(flat.items()), "kinds": [(k, _kind(v)) for k, v in node.items()]})
            for k, v in node.items():
                if isinstance(v, (dict, list)):
                    stack.append((v, f"{pointer}/{token(k)}", pointer, k if isinstance(v, list) else None, 0))
        else:
            for i, v in enumerate(node):  # positions count null elements
                if isinstance(v, (dict, list)):
                    stack.append((v, f"{pointer}/{i}", parent, name if isinstance(v, dict) else None, i))
    return out


def objects(value) -> Iterator[dict]:
    """All objects of a parsed JSON value, without recursion."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            yield v
        if isinstance(v, (dict, list)):
            stack.extend(v.values() if isinstance(v, dict) else v)


def _page(body: str | None) -> tuple[bool, str | None, object]:
    """Whether a response body is whole and good, the page's id as a string, and the parsed body."""
    try:
        parsed = json.loads(body) if body is not None else None
    except (ValueError, RecursionError):
        return False, None, None
    if not isinstance(parsed, dict) or isinstance(parsed.get("retcode"), bool) or parsed.get("retcode") != 0:
        return False, None, None
    data = parsed.get("data")
    page = data.get("page") if isinstance(data, dict) else None
    key = page.get("id") if isinstance(page, dict) else None
    return True, None if key is None or isinstance(key, (dict, list)) else _text(key), parsed


def _walk(arrays: tuple[str, ...], carried: tuple[str, ...]):
    wanted = frozenset(arrays)
    kind = pa.list_(pa.struct([("array_name", pa.string()), ("position", pa.int32()), ("pointer", pa.string()), ("parent_pointer", pa.string()), ("shape", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("kinds", pa.map_(pa.string(), pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, roots, nodes = [], [], []
            for i, body in enumerate(b.column("body").to_pylist()):
                good, root, parsed = _page(body)
                if good:
                    keep.append(i)
                    roots.append(root)
                    nodes.append(nodes_of(parsed, wanted) if root is not None else [])
            rows = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carried), pa.array(roots, pa.string()), pa.array(nodes, kind)], names=[*carried, "root_id", "nodes"])

    return run


def page_nodes(fetches: DataFrame, arrays: tuple[str, ...] = ARRAYS) -> DataFrame:
    """Objects of the named arrays in the latest good fetch of each content_key.

    ``fetches``: content_key, ok, http_status, body, fetched_at. Good is a fetch that is ok, has
    status 200, parses whole and has retcode 0; of several the latest counts (a null time is the
    earliest, equal times go by body). Pages without an id and null content_keys give nothing.
    """
    rows = fetches.where(F.col("ok") & (F.col("http_status") == 200) & F.col("content_key").isNotNull() & F.col("body").isNotNull())
    rows = rows.select("content_key", "fetched_at", "body").withColumn("tie", F.xxhash64("body"))
    parsed = rows.mapInArrow(_walk(arrays, ("content_key", "fetched_at", "tie")), "content_key string, fetched_at timestamp, tie long, " + NODES)
    newest = parsed.groupBy("content_key").agg(F.max_by(F.struct("root_id", "nodes"), F.struct("fetched_at", "tie")).alias("p"))
    return newest.where("p.root_id is not null").select(F.col("p.root_id").alias("root_id"), F.explode("p.nodes").alias("n")).select("root_id", "n.*")


def shape_counts(nodes: DataFrame) -> DataFrame:
    """Structural variants (array_name, shape, n, roots) among the nodes."""
    return nodes.groupBy("array_name", "shape").agg(F.count("*").alias("n"), F.countDistinct("root_id").alias("roots"))


#: Columns that a table gets at most; further keys stay in the map ``rest``.
MOST_COLUMNS = 500
LINKS = ["root_id", "pointer", "parent_pointer", "position", "shape"]


def routed(nodes: DataFrame) -> DataFrame:
    """The nodes as a stored table with one folder an array, in which the rows of a variant lie together."""
    return stored(nodes.sortWithinPartitions("array_name", "shape"), "array_name")


def key_catalog(nodes: DataFrame) -> DataFrame:
    """(array_name, key, kind, n, variants, common) of all keys: objects and variants with the key, and whether all variants have it.

    ``kind`` is null, bool, number, string, scalars, array or object; mixed if a key has several (null aside).
    """
    one = nodes.groupBy("array_name", "shape").agg(F.count("*").alias("n"), F.first("kinds").alias("kinds"))
    total = one.groupBy("array_name").agg(F.count("*").alias("all_variants"))
    keys = one.select("array_name", "n", F.explode("kinds").alias("key", "kind"))
    typed = F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))
    kind = F.when(F.size(typed) == 0, "null").when(F.size(typed) == 1, F.element_at(typed, 1)).otherwise("mixed")
    out = keys.groupBy("array_name", "key").agg(kind.alias("kind"), F.sum("n").alias("n"), F.count("*").alias("variants")).join(total, "array_name")
    return out.select("array_name", "key", "kind", "n", "variants", (F.col("variants") == F.col("all_variants")).alias("common"))


def _typed(value: Column, kind: str) -> Column:
    if kind == "number":
        return value.cast("double")
    if kind == "bool":
        return value.cast("boolean")
    return F.from_json(value, "array<string>") if kind == "scalars" else value


def subtype_table(nodes: DataFrame, array_name: str, shape: str | None = None, common: bool = False) -> DataFrame:
    """The objects of an array, or of one of its variants, with a typed column a key beside the links.

    With ``common`` only the keys that all variants share get a column (the supertype). Columns come in
    the order of the keys; keys that an object lacks are null; numbers are doubles, arrays of scalars
    arrays of strings, keys of mixed kind text. Keys beyond MOST_COLUMNS (the rarest) and those without a
    column are in ``rest``; nested objects are tables of their own. A key that clashes with a link or with
    ``rest``, or with another key but for letter case, gets the suffix _value and its number.
    """
    rows = nodes.where(F.col("array_name") == array_name)
    if shape is not None:
        rows = rows.where(F.col("shape") == shape)
    keys = key_catalog(rows).where(~F.col("kind").isin("object", "array"))
    if common:
        keys = keys.where("common")
    known = sorted((r["key"], r["kind"]) for r in keys.orderBy(F.desc("n"), "key").limit(MOST_COLUMNS).collect())
    taken = {c.lower() for c in [*LINKS, "rest"]}
    columns = []
    for i, (key, kind) in enumerate(known):
        name = key if key and key.lower() not in taken else f"{key}_value{'' if key.lower() + '_value' not in taken and key else i}"
        taken.add(name.lower())
        columns.append(_typed(F.col("fields")[key], kind).alias(name))
    rest = F.map_filter("fields", lambda k, _: ~k.isin(*(k for k, _ in known))) if known else F.col("fields")
    return rows.select(*LINKS, *columns, rest.alias("rest"))


def state_of(value: Column, kind) -> Column:
    """The automaton's state of a column of a known type, as an expression: null, a leaf's type, [states] or {key:state}."""
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        inner = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f"{f.name}:"), state_of(value[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name))), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        inner = F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(F.transform(value, lambda x: state_of(x, kind.elementType)))), "|"), F.lit("]"))
    else:
        inner = F.lit("bool" if isinstance(kind, T.BooleanType) else "string" if isinstance(kind, T.StringType) else "number")
    return F.when(value.isNull(), "null").otherwise(inner)


def lineage_nodes(records: DataFrame) -> DataFrame:
    """(record_id, built_at, level, parent_pointer, refs, shape) of every lineage at four levels: record, section, component and unit.

    Each level is its own scan of only the pointer columns, so that the texts of the units are never
    read. ``refs`` are the pointers of its raw references, ``shape`` the structural variant of the pair.
    """
    records = records.where(F.col("record_id").isNotNull())
    section = lambda x: records.select("record_id", "built_at", F.explode("sections").alias("s")).select("record_id", "built_at", x)
    levels = [
        ("record", records.select("record_id", "built_at", F.col("lineage").alias("l"))),
        ("section", section(F.col("s.lineage").alias("l"))),
        ("component", section(F.explode("s.component_contexts").alias("x")).select("record_id", "built_at", F.col("x.lineage").alias("l"))),
        ("unit", section(F.explode("s.units").alias("x")).select("record_id", "built_at", F.col("x.lineage").alias("l"))),
    ]
    parts = [rows.select("record_id", "built_at", F.lit(name).alias("level"), F.col("l.parsed_json_pointer").alias("parent_pointer"), F.col("l.raw_refs.json_pointer").alias("refs")) for name, rows in levels]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    pair = F.struct("parent_pointer", "refs")
    return nodes.withColumn("shape", state_of(pair, nodes.select(pair.alias("p")).schema["p"].dataType))


def lineage_links(records: DataFrame) -> DataFrame:
    """Distinct links (record_id, parent_pointer, child_pointer) of the latest build of each record, from ``lineage_nodes``.

    Only variants with a pointer and a reference with one give links; null arrays, null elements and null
    pointers give nothing, and an empty pointer is a pointer. Null record ids are left out.
    """
    nodes = lineage_nodes(records).where(F.col("shape").rlike(r"^\{parent_pointer:string,refs:\[.*string.*\]\}$"))
    links = nodes.select("record_id", "built_at", "parent_pointer", F.explode("refs").alias("child_pointer")).where("child_pointer is not null")
    newest = records.where(F.col("record_id").isNotNull()).groupBy("record_id").agg(F.max("built_at").alias("newest"))
    links = links.distinct().join(newest, "record_id").where(F.col("built_at").eqNullSafe(F.col("newest")))
    return links.select("record_id", "parent_pointer", "child_pointer").distinct()
