"""Column functions on documents.

A document column holds text. ``parse`` turns any text into canonical text; the native functions
(``kind``, the accessors, ``keys``, ``contains_all``, ``count``) read canonical text, and those that look
inside a container need it strict (regular expressions as strings). The others accept any text,
read it leniently and do all their work in one Arrow-batched pass; null or unreadable texts give null.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from quillon.functions import dialect
from quillon.functions.dialect import NOTHING, Regex

CHILD = StructType([StructField("ord", LongType()), StructField("key", StringType()), StructField("kind", StringType()), StructField("text", StringType())])
NODE = StructType([StructField("path", ArrayType(StringType())), StructField("depth", LongType()), *CHILD.fields, StructField("n_children", LongType())])
TYPES = {"document": StringType(), "string": StringType(), "int": LongType(), "double": DoubleType(), "float": FloatType(), "boolean": BooleanType()}


def _as_column(doc: Column | str) -> Column:
    return F.col(doc) if isinstance(doc, str) else doc


def _each(fn: Callable, doc: Column | str, returns: DataType = StringType(), *more: Column) -> Column:
    @F.pandas_udf(returns)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if t is NOTHING else fn(t, *rest) for t, *rest in ((dialect.parse(text), *rest) for text, *rest in zip(*cols))], dtype=object)

    if isinstance(returns, StructType):  # structs come back as one frame
        @F.pandas_udf(returns)
        def run(*cols: pd.Series) -> pd.DataFrame:
            blank = (None,) * len(returns)
            rows = [blank if t is NOTHING else fn(t, *rest) for t, *rest in ((dialect.parse(text), *rest) for text, *rest in zip(*cols))]
            return pd.DataFrame(rows, columns=returns.names, dtype=object)

    return run(_as_column(doc), *more)


# Text to text.


def parse(doc: Column | str, strict: bool = False) -> Column:
    """Canonical compact text of what can be read, from text or UTF-8 bytes; ``strict`` writes regular expressions as strings."""
    return _each(lambda t: dialect.dump(t, strict=strict), doc)


def parsed(doc: Column | str, fn: Callable, returns: DataType | str = "string") -> Column:
    """What ``fn`` makes of each parsed tree (None, numbers, text, lists and dicts); it also sees ``NOTHING``."""
    @F.pandas_udf(returns)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fn(dialect.parse(t)) for t in texts], dtype=object)

    return run(_as_column(doc))


def with_parsed(df: DataFrame, doc: str, name: str, fn: Callable, returns: DataType | str = "string") -> DataFrame:
    """``parsed`` as a step of ``DataFrame.transform``."""
    return df.withColumn(name, parsed(doc, fn, returns))


def pretty(doc: Column | str) -> Column:
    return _each(lambda t: dialect.dump(t, pretty=True), doc)


def sort_keys(doc: Column | str) -> Column:
    """Keys of all objects in shortlex order; inside a chain of edits take ``sorted_keys()``."""
    return edit(doc, sorted_keys())


def sort_all(doc: Column | str) -> Column:
    """Keys and items in shortlex order; inside a chain of edits take ``sorted_all()``."""
    return edit(doc, sorted_all())


_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timeZone": "UTC", "ignoreNullFields": "false"}


def _json_text(value: Column, of: DataType) -> Column:
    """JSON text of a typed value. Infinities carry their sign, which ``to_json`` leaves out."""
    if isinstance(of, StructType):
        text = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(dialect.dump(f.name) + ":"), _json_text(value[f.name], f.dataType)) for f in of.fields]), F.lit("}"))
    elif isinstance(of, ArrayType):
        text = F.concat(F.lit("["), F.concat_ws(",", F.transform(value, lambda x: _json_text(x, of.elementType))), F.lit("]"))
    else:
        text = F.regexp_extract(F.to_json(F.array(value), _OPTIONS), r"(?s)^\[(.*)\]$", 1)
        if isinstance(of, (DoubleType, FloatType)):
            text = F.when(value == float("inf"), F.lit('"+Infinity"')).otherwise(text)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def from_struct(df: DataFrame, *columns: str) -> Column:
    """Canonical text of an object with the columns (all without any): nulls are written, times are UTC seconds, infinity is "+Infinity"."""
    members = [F.concat(F.lit(dialect.dump(n) + ":"), _json_text(F.col(f"`{n}`"), df.schema[n].dataType)) for n in columns or df.columns]
    return parse(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))


def document(value) -> Column:
    """A literal document from a Python value."""
    return F.lit(dialect.dump(dialect.from_python(value)))


def scalar(value: Column | str) -> Column:
    """A text, number or boolean column as a document; null is the document null."""
    return parse(F.coalesce(F.regexp_extract(F.to_json(F.array(_as_column(value))), r"(?s)^\[(.*)\]$", 1), F.lit("null")))


def array_of(*docs: Column | str) -> Column:
    """An array of canonical documents, without reading them; null counts as the document null."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(_as_column(d), F.lit("null")) for d in docs]), F.lit("]"))


def object_of(**docs: Column | str) -> Column:
    """An object of canonical documents, without reading them; null counts as the document null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(dialect.dump(k) + ":"), F.coalesce(_as_column(d), F.lit("null"))) for k, d in docs.items()]), F.lit("}"))


def same(a: Column | str, b: Column | str) -> Column:
    """Equal in type, order of keys and value (1 is not 1.0); null where either is no document."""
    @F.pandas_udf(BooleanType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if (p := dialect.parse(m)) is NOTHING or (q := dialect.parse(n)) is NOTHING else dialect.same(p, q) for m, n in zip(x, y)], dtype=object)

    return run(_as_column(a), _as_column(b))


def export_to(prefix: Column | str, doc: Column | str) -> Column:
    """The compact text after what is there already."""
    return F.concat(_as_column(prefix), _as_column(doc))


def export_size(doc: Column | str) -> Column:
    """Bytes of the compact text (of canonical documents)."""
    return F.octet_length(_as_column(doc)).cast("long")


def reify(doc: Column | str, of: DataType | str | None = None) -> Column:
    """Native values of a strict document: as type ``of``, else as VARIANT (which sorts keys)."""
    return F.from_json(_as_column(doc), of) if of is not None else F.try_parse_json(_as_column(doc))


# Native, on canonical text.


def kind(doc: Column | str) -> Column:
    """null, boolean, int, double, string, regex, array or dictionary; null for no document."""
    doc = _as_column(doc)
    first = F.substring(doc, 1, 1)
    names = {"{": "dictionary", "[": "array", '"': "string", "/": "regex", "n": "null", "t": "boolean", "f": "boolean"}
    found = F.when(doc.isNull() | (first == ""), F.lit(None).cast("string"))
    for mark, name in names.items():
        found = found.when(first == mark, name)
    return found.when(F.contains(doc, F.lit(".")), "double").otherwise("int")


def string_value(doc: Column | str) -> Column:
    """Strings and regular expressions only; other kinds give null."""
    doc = _as_column(doc)
    decoded = F.get(F.from_json(F.concat(F.lit("["), doc, F.lit("]")), "array<string>"), 0)
    return F.when(kind(doc) == "string", decoded).when(kind(doc) == "regex", doc)


def int_value(doc: Column | str) -> Column:
    return F.when(kind(doc) == "int", _as_column(doc).cast("bigint"))


def double_value(doc: Column | str) -> Column:
    """Doubles only; ints give null."""
    return F.when(kind(doc) == "double", _as_column(doc).cast("double"))


def bool_value(doc: Column | str) -> Column:
    return F.when(kind(doc) == "boolean", _as_column(doc) == "true")


def keys(doc: Column | str) -> Column:
    """Keys in document order; null for what is no object."""
    return F.when(kind(doc) == "dictionary", F.json_object_keys(_as_column(doc)))


def contains_key(doc: Column | str, key: str) -> Column:
    return F.coalesce(F.array_contains(keys(doc), key), F.lit(False))


def contains_all(doc: Column | str, wanted: list[str]) -> Column:
    """An object that has every key; without keys wanted true for any object."""
    if not wanted:
        return F.coalesce(kind(doc) == "dictionary", F.lit(False))
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), keys(doc))) == 0, F.lit(False))


def count(doc: Column | str) -> Column:
    """Bytes of a string, children of a container, else 0."""
    doc = _as_column(doc)
    k = kind(doc)
    return F.when(k.isin("string", "regex"), F.octet_length(string_value(doc))).when(k == "array", F.json_array_length(doc)).when(k == "dictionary", F.size(keys(doc))).when(doc.isNotNull(), 0).cast("long")


# Navigation.


def _walk(tree, steps):
    for step in steps:
        if isinstance(step, int):
            if not isinstance(tree, list) or not 0 <= step < len(tree):
                return NOTHING
            tree = tree[step]
        elif isinstance(tree, dict) and step in tree:
            tree = tree[step]
        else:
            return NOTHING
    return tree


def _typed(tree, steps, as_type):
    value = _walk(tree, steps)
    if value is NOTHING and as_type != "document" and steps and isinstance(steps[-1], int) and steps[-1] >= 0:
        parent = _walk(tree, steps[:-1])  # a typed reader takes an object's values by position
        if isinstance(parent, dict) and steps[-1] < len(parent):
            value = list(parent.values())[steps[-1]]
    if as_type == "document":
        return dialect.dump(value)
    if value is NOTHING and as_type == "boolean" and steps and isinstance(steps[-1], str) and isinstance(_walk(tree, steps[:-1]), dict):
        return False  # a missing key reads as false
    k = dialect.kind(value)
    if as_type in ("double", "float"):
        return float(value) if k in ("double", "int") else None
    wanted = {"string": ("string", "regex"), "int": ("int",), "boolean": ("boolean",)}[as_type]
    return (str(value) if as_type == "string" else value) if k in wanted else None


def path(doc: Column | str, *steps: str | int, as_type: str = "document") -> Column:
    """What lies at keys and indices, as canonical text or a typed value; nothing is coerced but int to double.

    An index asks an array. As the last step of a typed path it also asks an object's values by position.
    """
    return _each(lambda t: _typed(t, steps, as_type), doc, TYPES[as_type])


def extract(doc: Column | str, **fields: tuple) -> Column:
    """Many paths in one pass: ``extract("doc", k=("int", "a", 0, "k"))`` gives a struct."""
    wanted = list(fields.values())
    schema = StructType([StructField(n, TYPES[t]) for n, (t, *_) in fields.items()])
    return _each(lambda t: tuple(_typed(t, steps, as_type) for as_type, *steps in wanted), doc, schema)


def _children(tree):
    items = tree.items() if isinstance(tree, dict) else ((None, v) for v in tree) if isinstance(tree, list) else ()
    return [(i, k, dialect.kind(v), dialect.dump(v)) for i, (k, v) in enumerate(items)]


def children(doc: Column | str) -> Column:
    """Direct children in order: array<struct<ord, key, kind, text>>."""
    return _each(lambda t: [dict(zip(CHILD.names, c)) for c in _children(t)], doc, ArrayType(CHILD))


def walking(doc: Column | str) -> Column:
    """Children that are containers; the key of an item is its index."""
    found = F.filter(children(doc), lambda c: c["kind"].isin("array", "dictionary"))
    return F.transform(found, lambda c: c.withField("key", F.coalesce(c["key"], c["ord"].cast("string"))))


def nodes(doc: Column | str) -> Column:
    """All nodes in document order; items of one array share a path."""
    def rows(tree):
        return [{"path": list(p), "depth": d, "ord": o, "key": k, "kind": kd, "text": text, "n_children": n} for p, d, o, k, kd, n, text, _ in dialect.nodes(tree)]

    return _each(rows, doc, ArrayType(NODE))


def values(doc: Column | str) -> Column:
    """An object's values as an array; arrays and scalars stay; a regular expression becomes a string."""
    return edit(doc, (lambda t, _: list(t.values()) if isinstance(t, dict) else str(t) if isinstance(t, Regex) else t, None))


# Edits. Each takes a tree and returns the edited tree; those that don't fit the kind change nothing.


def replace_at(at: int, value):
    return lambda t, v: [*t[:at], v, *t[at + 1 :]] if isinstance(t, list) and 0 <= at < len(t) else t, value


def append(value):
    return lambda t, v: [*t, v] if isinstance(t, list) else t, value


def insert(at: int, value):
    """Pads with null until the array is longer than ``at``, then inserts."""
    def run(t, v):
        if not isinstance(t, list) or at < 0:
            return t
        t = t + [None] * (at + 1 - len(t))
        return [*t[:at], v, *t[at:]]

    return run, value


def set_at(at: int, value):
    def run(t, v):
        if not isinstance(t, list) or at < 0:
            return t
        t = t + [None] * (at + 1 - len(t))
        t[at] = v
        return t

    return run, value


def rename(key: str, new: str):
    """Keeps the position. Where ``new`` is a key already, the value that stands later stays."""
    return lambda t, _: {new if k == key else k: v for k, v in t.items()} if isinstance(t, dict) else t, None


def set_key(key: str, value):
    return lambda t, v: {**t, key: v} if isinstance(t, dict) else t, value


def remove_at(at: int):
    return lambda t, _: [v for i, v in enumerate(t) if i != at] if isinstance(t, list) else t, None


def remove_key(key: str):
    return lambda t, _: {k: v for k, v in t.items() if k != key} if isinstance(t, dict) else t, None


def clean():
    """Direct null children go."""
    return lambda t, _: {k: v for k, v in t.items() if v is not None} if isinstance(t, dict) else [v for v in t if v is not None] if isinstance(t, list) else t, None


def sort_array(key: Callable | None = None, before: Callable | None = None):
    """Items in the order of ``key(item)``, or by ``before(a, b)``: whether a comes before b."""
    if before is not None:
        def order(a, b):
            return -1 if before(a, b) else 1 if before(b, a) else 0

        return lambda t, _: sorted(t, key=functools.cmp_to_key(order)) if isinstance(t, list) else t, None
    return lambda t, _: sorted(t, key=key) if isinstance(t, list) else t, None


def sorted_keys():
    return lambda t, _: dialect.sort_keys(t), None


def sorted_all():
    return lambda t, _: dialect.sort_all(t), None


def replace(value):
    """The whole document gives way."""
    return lambda t, v: v, value


# What a typed setter writes for a null.
_EMPTY = {"string": "", "int": 0, "double": 0.0, "boolean": False}


def set_typed(as_type: str, value):
    """The root's value changes if its kind is ``as_type`` (string, int, double or boolean; a string setter fits regular expressions too); null sets the empty value."""
    def run(t, v):
        k = dialect.kind(t)
        if k == "regex" and as_type == "string":
            return Regex("" if v is None else v)
        if k != as_type or (v is not None and dialect.kind(v) not in (as_type, "regex" if as_type == "string" else as_type)):
            return t
        return _EMPTY[as_type] if v is None else str(v) if as_type == "string" else v

    return run, value


def at(path: tuple, change: tuple):
    """An edit of what lies at keys and indices; where nothing lies nothing changes."""
    fn, value = change

    def run(t, v):
        if _walk(t, path) is NOTHING:
            return t

        def inner(x, steps):
            if not steps:
                return fn(x, v)
            x = x.copy()
            x[steps[0]] = inner(x[steps[0]], steps[1:])
            return x

        return inner(t, path)

    return run, value


def edit(doc: Column | str, *edits: tuple) -> Column:
    """All edits in order, in one pass. Values are Python values or columns of document text (null or unreadable: null)."""
    columns = [v for _, v in edits if isinstance(v, Column)]
    fixed = [None if isinstance(v, Column) else dialect.from_python(v) for _, v in edits]
    given = [isinstance(v, Column) for _, v in edits]
    steps = [fn for fn, _ in edits]

    def run(tree, *texts):
        rest = iter(texts)
        for fn, value, is_column in zip(steps, fixed, given):
            if is_column:
                found = dialect.parse(next(rest))
                value = None if found is NOTHING else found
            tree = fn(tree, value)
        return dialect.dump(tree)

    return _each(run, doc, StringType(), *columns)
