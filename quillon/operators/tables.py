"""Documents to typed tables: schema inference as a distributed aggregate, and shredding in one pass.

A table holds one document a row. An array root gives one record for each item, any other root is
one record; null and unreadable texts give none. Inference sends one small row for each distinct
key or path of a partition, so what is shuffled and collected grows with the schema and not with
the rows; ``max_fields`` stops schemas that grow with the data (keys that are really values).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.functions import dialect
from quillon.functions.dialect import NOTHING
from quillon.functions.schemas import Field, leaves, to_struct

MAX_FIELDS = 20_000
BATCH_ROWS = 2_000
#: Summaries kept in a task before they are sent on.
MOST_HELD = 50_000
_BIT = {"null": 0, "boolean": 1, "int": 2, "double": 4, "string": 8, "regex": 8, "array": 16, "dictionary": 32}
_MASK = {type_: 0 if kind in (None, "null") else _BIT[kind] for type_, kind in dialect._KINDS.items()}
#: Types whose values go into a column as they are.
_AS_THEY_ARE = {"boolean": {bool, type(None)}, "int64": {int, type(None)}, "double": {float, type(None)}, "string": {str, type(None)}}
_SUMMARY = pa.schema([("path", pa.list_(pa.string())), ("mask", pa.int32()), ("present", pa.int64()), ("rows", pa.int64()), ("at_row", pa.int64()), ("at_key", pa.int64())])


def _records(text):
    tree = dialect.parse(text)
    return () if tree is NOTHING else tree if isinstance(tree, list) else (tree,)


def _nested_seen(record):
    for path, _, _, key, kind, n, _, _ in _paths(record):
        yield path, kind, not (kind == "null" or (kind == "dictionary" and n == 0))


def _paths(record):
    stack = [((), None, record)]
    while stack:
        path, key, x = stack.pop()
        yield path, 0, 0, key, dialect.kind(x), len(x) if isinstance(x, (list, dict)) else 0, None, None
        if isinstance(x, dict):
            stack.extend(reversed([((*path, "." + k), k, v) for k, v in x.items()]))
        elif isinstance(x, list):
            stack.extend(reversed([((*path, "[]"), None, v) for v in x]))


def _summaries(df: DataFrame, doc: str, nested: bool, max_fields: int, ordinal: str | None) -> dict[tuple, object]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[list(p) for p in held], *zip(*held.values())] if held else [[]] * 6, _SUMMARY.types)], schema=_SUMMARY)

        def see(path, mask, rows, at, place):
            found = held.get(path)
            if found is None:
                held[path] = [mask, rows if mask else 0, rows, at, place]
                return
            found[0] |= mask
            found[1] += rows if mask else 0
            found[2] += rows
            if at is not None and (found[3] is None or at < found[3]):
                found[3], found[4] = at, place

        shapes: dict[tuple, list] = {}

        def fold():
            """Records of one shape (keys and types) count together."""
            for (of, keys, types), (rows, at, place) in shapes.items():
                see(("value",), _MASK[of], rows, at, place)
                for i, (key, kind) in enumerate(zip(keys, types), 1):
                    see(("key", key), _MASK[kind], rows, at, place + i)
            shapes.clear()

        for b in batches:
            for at, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                place = 0
                for record in _records(text):
                    if nested:
                        for path, kind, present in _nested_seen(record):
                            see(path, _BIT[kind] if present and kind != "null" else 0, 1, at, place)
                            place += 1
                        continue
                    shape = (dict, tuple(record), tuple(map(type, record.values()))) if type(record) is dict else (type(record), (), ())
                    found = shapes.get(shape)
                    if found is None:
                        shapes[shape] = [1, at, place]
                    else:
                        found[0] += 1
                        if at is not None and (found[1] is None or at < found[1]):
                            found[1], found[2] = at, place
                    place += 1 + len(shape[1])
                if len(shapes) > MOST_HELD // 10:
                    fold()
                if len(held) > MOST_HELD:
                    yield out()
                    held.clear()
        fold()
        yield out()

    place = F.col(ordinal).cast("long") if ordinal else F.monotonically_increasing_id()
    seen = df.select(place.alias("at"), F.col(doc).alias("text")).mapInArrow(run, "path array<string>, mask int, present long, rows long, at_row long, at_key long")
    plan = seen.groupBy("path").agg(F.bit_or("mask").alias("mask"), F.sum("present").alias("present"), F.sum("rows").alias("rows"), F.min(F.struct("at_row", "at_key")).alias("first"))
    found = plan.limit(max_fields + 1).collect()  # one row more than is allowed shows that there are too many
    if len(found) > max_fields:
        raise ValueError(f"more than {max_fields} distinct fields: keys that are values?")
    return {tuple(r.path): r for r in sorted(found, key=lambda r: tuple(r.first))}


def _scalar(mask: int) -> str:
    return {0: "string", 1: "boolean", 2: "int64", 4: "double", 6: "double", 8: "string"}.get(mask, "json")


def infer_flat(df: DataFrame, doc: str, scalar_name: str = "value", max_fields: int = MAX_FIELDS, ordinal: str | None = None) -> list[Field]:
    """Columns in the order of first appearance. Records that are all objects give one column a key, others one column.

    The order of rows is that of the column ``ordinal``; without one it is that of partitions, which is no contract.
    """
    found = _summaries(df, doc, False, max_fields, ordinal)
    whole = found.get(("value",))
    if whole is None:
        return [Field(scalar_name, "string", False)]
    if not (whole.mask == _BIT["dictionary"] and whole.present == whole.rows):
        return [Field(scalar_name, _scalar(whole.mask), whole.present != whole.rows)]
    return [Field(p[1], _scalar(r.mask), r.present != whole.rows) for p, r in found.items() if p[0] == "key"]


def infer_nested(df: DataFrame, doc: str, max_fields: int = MAX_FIELDS, ordinal: str | None = None) -> list[Field]:
    """Objects become groups and arrays lists; null and ``{}`` count as missing; mixed kinds become JSON text. ``ordinal`` as in ``infer_flat``."""
    found = _summaries(df, doc, True, max_fields, ordinal)
    below: dict[tuple, list[tuple]] = {}
    for path in found:
        if path:
            below.setdefault(path[:-1], []).append(path)

    def node(path, name, nullable) -> Field:
        r = found.get(path)
        if r is None or not r.mask:
            return Field(name, "string", True)
        if r.mask == _BIT["dictionary"]:
            return Field(name, "group", nullable, group(path, r.present))
        if r.mask == _BIT["array"]:
            return Field(name, "list", nullable, (node((*path, "[]"), "element", True),))
        return Field(name, _scalar(r.mask), nullable)

    def group(path, rows) -> tuple[Field, ...]:
        return tuple(node(p, p[-1][1:], found[p].present < rows) for p in below.get(path, []) if p[-1] != "[]")

    root = found.get(())
    return list(group((), root.rows)) if root else []


def _cell(x, f: Field):
    """A value in its column: null stays null, ints widen to double, other mismatches give the zero of the type."""
    if x is NOTHING or x is None:
        return None
    if f.kind == "json":
        return dialect.dump(x)
    if f.kind == "string":
        return str(x) if isinstance(x, str) else ""
    if f.kind == "boolean":
        return bool(x) if isinstance(x, (bool, int)) else False
    if f.kind == "int64":
        return x if isinstance(x, int) and not isinstance(x, bool) else 0
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else 0.0


def _node(x, f: Field):
    if f.kind not in ("group", "list"):
        return None if x == {} and isinstance(x, dict) else _cell(x, f)
    if x is NOTHING or x is None or (isinstance(x, dict) and not x):
        return None
    if f.kind == "list":
        return [_node(v, f.children[0]) for v in x] if isinstance(x, list) else None
    return {c.name: _node(x.get(c.name, NOTHING) if isinstance(x, dict) else NOTHING, c) for c in f.children}


def shred(df: DataFrame, doc: str, fields: list[Field], nested: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One typed row for each record, with the columns ``keep`` of its document before it. Keys outside ``fields`` are pruned.

    A lone ``value`` field takes the record itself unless the record is an object with that key.
    Tables without columns can't be stored and raise.
    """
    if not fields:
        raise ValueError("no fields: a table needs one column at least")
    keep = keep or []
    if clash := {f.name for f in fields} & set(keep):
        raise ValueError(f"fields and kept columns share names: {sorted(clash)}")
    schema = to_struct(fields)
    whole = len(fields) == 1 and fields[0].name == "value"
    for c in reversed(keep):
        schema.fields.insert(0, df.schema[c])
        schema.names.insert(0, c)
    arrow = to_arrow_schema(schema)
    make = _node if nested else _cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def column(records, f):
            if whole:
                return [make(x if (v := x.get("value", NOTHING) if isinstance(x, dict) else NOTHING) is NOTHING else v, f) for x in records]
            found = [x.get(f.name) if type(x) is dict else None for x in records]  # a missing key is like a null
            if set(map(type, found)) <= _AS_THEY_ARE.get(f.kind, set()):
                return found
            return [make(x, f) for x in found]

        for b in batches:
            origin, records = [], []
            for i, text in enumerate(b.column(0).to_pylist()):
                own = _records(text)
                records += own
                origin += [i] * len(own)
            kept = [b.column(j + 1).take(pa.array(origin, pa.int64())) for j in range(len(keep))]
            for s in range(0, len(origin), BATCH_ROWS):
                part = records[s : s + BATCH_ROWS]
                made = [pa.array(column(part, f), t) for f, t in zip(fields, arrow.types[len(keep) :])]
                yield pa.RecordBatch.from_arrays([k.slice(s, BATCH_ROWS).cast(t) for k, t in zip(kept, arrow.types)] + made, schema=arrow)

    return df.select(F.col(doc).alias("__doc"), *keep).mapInArrow(run, schema)


def to_table(df: DataFrame, doc: str, nested: bool = False, keep: list[str] | None = None, ordinal: str | None = None) -> DataFrame:
    """Infer and shred: two passes over the documents."""
    return shred(df, doc, (infer_nested if nested else infer_flat)(df, doc, ordinal=ordinal), nested, keep)


def _stripes(x, f: Field, rep: int, deep: int, repeated: int, path: tuple):
    """(leaf path, repetition level, definition level, value) of each slot under a node."""
    missing = x is NOTHING or x is None or (isinstance(x, dict) and not x)
    here = (*path, f.name)
    if f.kind == "list":
        inner = (*here, "list")
        if missing or not isinstance(x, list) or not x:
            level = deep if missing or not isinstance(x, list) else deep + f.nullable
            yield from ((p, rep, level, None) for p in _leaf_paths(f.children, inner))
            return
        for i, v in enumerate(x):
            yield from _stripes(v, f.children[0], repeated + 1 if i else rep, deep + f.nullable + 1, repeated + 1, inner)
    elif f.kind == "group":
        if missing:
            yield from ((p, rep, deep, None) for p in _leaf_paths(f.children, here))
            return
        for c in f.children:
            yield from _stripes(x.get(c.name, NOTHING) if isinstance(x, dict) else NOTHING, c, rep, deep + f.nullable, repeated, here)
    elif missing:
        yield ".".join(here), rep, deep, None
    else:
        yield ".".join(here), rep, deep + f.nullable, dialect.dump(x)


def _leaf_paths(fields, path: tuple) -> list[str]:
    return [p for p, _, _ in leaves(fields, path)]


def stripe(df: DataFrame, doc: str, fields: list[Field], keep: list[str] | None = None) -> DataFrame:
    """The slots that a nested table stores: (ord, leaf, rep, def, value) for each leaf of each record, ``ord`` counting the slots of a document.

    For inspection: the Parquet writer makes the same levels itself.
    """
    keep = keep or []
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, origin = [], []
            for i, text in enumerate(b.column(0).to_pylist()):
                slots = [s for record in _records(text) for f in fields for s in _stripes(record.get(f.name, NOTHING) if isinstance(record, dict) else NOTHING, f, 0, 0, 0, ())]
                rows += [(n, *s) for n, s in enumerate(slots)]
                origin += [i] * len(slots)
            kept = [b.column(j + 1).take(pa.array(origin, pa.int64())) for j in range(len(keep))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], [*keep, "ord", "leaf", "rep", "def", "value"])

    return df.select(F.col(doc).alias("__doc"), *keep).mapInArrow(run, f"{kinds}ord long, leaf string, rep long, def long, value string")


def describe(table: DataFrame, fields: list[Field]) -> DataFrame:
    """(ord, name, kind, nullable, present, rows) of each column: its type and how many rows hold a value; one pass."""
    found = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"`{f.name}`").alias(f"p{i}") for i, f in enumerate(fields)])
    lines = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(f.name).alias("name"), F.lit(f.kind).alias("kind"), F.lit(f.nullable).alias("nullable"), F.col(f"p{i}").alias("present"), F.col("rows")) for i, f in enumerate(fields)])
    return found.select(F.inline(lines))
