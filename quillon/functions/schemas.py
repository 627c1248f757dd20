"""Schemas of document tables: fields that know JSON leaves, and schemas from Python classes."""

from __future__ import annotations

import dataclasses
import enum
import types
import typing

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

_SPARK = {"boolean": BooleanType(), "int64": LongType(), "double": DoubleType(), "string": StringType(), "json": StringType()}


#: Classes that may stand inside each other without an optional field or a list between them.
MAX_DEPTH = 32


class SchemaError(TypeError):
    """A field has no column type, or classes nest too deeply."""


@dataclasses.dataclass(frozen=True)
class Field:
    """A column or a node: ``kind`` is boolean, int64, double, string, json, group or list (one child, ``element``)."""

    name: str
    kind: str
    nullable: bool = False
    children: tuple[Field, ...] = ()

    def spark(self) -> DataType:
        if self.kind == "group":
            return to_struct(self.children)
        if self.kind == "list":
            return ArrayType(self.children[0].spark(), True)
        return _SPARK[self.kind]


def to_struct(fields) -> StructType:
    """Columns may hold nulls whatever the field says: Spark has no check of required fields on write."""
    return StructType([StructField(f.name, f.spark(), True, {"json": True} if f.kind == "json" else None) for f in fields])


def leaves(fields, path: tuple = (), deep: int = 0, repeated: int = 0) -> list[tuple]:
    """(path, max definition level, max repetition level) of each leaf, in order."""
    found = []
    for f in fields:
        d, r, here = deep + f.nullable, repeated, (*path, f.name)
        if f.kind == "list":
            found += leaves(f.children, (*here, "list"), d + 1, r + 1)
        elif f.kind == "group":
            found += leaves(f.children, here, d, r)
        else:
            found.append((".".join(here), d, r))
    return found


def annotate(fields) -> list[tuple]:
    """(leaf number, path, max definition level, max repetition level, kind, nullable) of each leaf, in order."""
    def kinds(of):
        for f in of:
            if f.kind in ("group", "list"):
                yield from kinds(f.children)
            else:
                yield f.kind, f.nullable

    return [(i, *leaf, *k) for i, (leaf, k) in enumerate(zip(leaves(fields), kinds(fields)))]


def describe(fields, deep: int = 0) -> list[str]:
    """A line for each node, children after their parent."""
    out = []
    for f in fields:
        out.append("  " * deep + f"{f.name}: {f.kind}{' optional' if f.nullable else ''}")
        out += describe(f.children, deep + 1)
    return out


def shape(cls) -> str:
    """record, array or scalar: how values of a class stand in a document."""
    hint, _ = _plain(cls)
    if dataclasses.is_dataclass(hint):
        return "record"
    return "array" if typing.get_origin(hint) in (list, tuple) or hint in (list, tuple) else "scalar"


def _check_depth(cls, deep: int = 0) -> None:
    """Classes that need one of themselves, or more than MAX_DEPTH of others, have no values."""
    if deep > MAX_DEPTH:
        raise SchemaError(f"too deep: more than {MAX_DEPTH} classes need each other")
    hints = typing.get_type_hints(cls)
    for f in dataclasses.fields(cls):
        hint, optional = _plain(hints[f.name])
        if not optional and dataclasses.is_dataclass(hint):
            _check_depth(hint, deep + 1)


def _plain(hint) -> tuple[object, bool]:
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        return (rest[0] if len(rest) == 1 else dict), len(rest) < len(typing.get_args(hint))
    return hint, False


def _leaf(hint, name: str) -> str:
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        raise SchemaError(f"field {name}: enumerations have no column type")
    return {bool: "boolean", int: "int64", float: "double", str: "string"}.get(hint, "json")


def flat_fields(cls, scalar_name: str = "value") -> list[Field]:
    """One column for each field, in order; what is no bool, int, float or str becomes JSON text."""
    if not dataclasses.is_dataclass(cls):
        return [Field(scalar_name, _leaf(cls, scalar_name))]
    _check_depth(cls)
    hints = typing.get_type_hints(cls)
    out = []
    for f in dataclasses.fields(cls):
        hint, optional = _plain(hints[f.name])
        out.append(Field(f.name, _leaf(hint, f.name), optional))
    return out


def nested_fields(cls, max_recursion: int = 1) -> list[Field]:
    """Classes become groups and lists become lists; dates, mappings and enumerations become JSON text.

    A class may stand at most ``max_recursion`` times (1 at least) inside itself; deeper fields of it are left out.
    """
    cap = max(1, max_recursion)

    def node(name, hint, seen) -> Field | None:
        hint, optional = _plain(hint)
        if typing.get_origin(hint) in (list, tuple) or hint is list:
            inner = (typing.get_args(hint) or (dict,))[0]
            found = node("element", inner, seen)
            return found and Field(name, "list", optional, (dataclasses.replace(found, nullable=True),))
        if dataclasses.is_dataclass(hint):
            if seen.count(hint) > cap:
                return None
            return Field(name, "group", optional, tuple(group(hint, seen)))
        return Field(name, "json" if isinstance(hint, type) and issubclass(hint, enum.Enum) else _leaf(hint, name), optional)

    def group(of, seen):
        hints = typing.get_type_hints(of)
        found = (node(f.name, hints[f.name], (*seen, of)) for f in dataclasses.fields(of))
        return [f for f in found if f]

    if not dataclasses.is_dataclass(cls):
        raise SchemaError(f"{cls} has no fields")
    return group(cls, ())
