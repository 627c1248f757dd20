"""The lenient JSON dialect: text to tree, tree to text.

A tree is made of None, bool, int, float, str, Regex, list and dict (in key order). Reading never
fails: what can't be read is left out, and NOTHING stands for a text without any value.

Rules: commas and white space only separate; ``}`` and ``]`` both close; open containers close at
the end; a key opens with either quote and closes with a double quote; of equal keys the last
value stays at the first place; ``/pattern/flags`` is a regular expression; a bare token that holds
``true`` or ``false`` is that; other bare tokens are numbers or nothing. Of several roots the first
scalar stays until a container comes; a later container, or a scalar after one, takes its place.
NUL ends the text. Whole numbers are 64 bit; a token without a point is a whole number, so ``1e5``
is nothing; numbers print as Java prints them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring as _quoted

_GAP = re.compile(rb"[ \t\n\r,]*")
_BLANK = re.compile(rb"[ \t\n\r]*")
_QUOTED = re.compile(rb'(?:[^"\\\x00]|\\[^\x00])*', re.S)
_TO_COLON = re.compile(rb"(?:[^:\\\x00]|\\[^\x00])*", re.S)
_PATTERN = re.compile(rb"/[^/\x00]*/?[igm]*")
_BARE = re.compile(rb"[^ \t\n\r,\]}]*?(?:true|false)|[^ \t\n\r,\]}]+")
_WHOLE = re.compile(rb"[+-]?[0-9]+\Z")
_REAL = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\(.)", re.S)
# The short escapes of JSON.
_SHORT = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


# What strict JSON reads otherwise than the dialect: long whole numbers, exponents without a point, words for numbers, halves of pairs, NUL.
_NOT_ALIKE = re.compile(r"[0-9]{19}|(?<![.0-9])[0-9]+[eE]|NaN|Infinity|\\u[dD]|\x00")
_strict = json.loads


class Regex(str):
    """A regular expression literal, with its slashes and flags."""


#: No document. Python's own singleton, which stays one wherever functions of this module are sent to.
NOTHING = ...


def unescape(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    if "\\" not in text:
        return text
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _SHORT.get(m[2], m[2]), text)
    if any("\ud800" <= c <= "\udfff" for c in out):  # pairs make one character, halves none
        out = out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return out


def _number(token: bytes):
    if b"." in token:
        return float(token) if _REAL.match(token) else NOTHING
    if _WHOLE.match(token) and -(1 << 63) <= (n := int(token)) < 1 << 63:
        return n
    return NOTHING


class _Reader:
    """Containers that are open, innermost last, and the root so far."""

    def __init__(self, data: bytes):
        self.data, self.open, self.root, self.holds = data, [], NOTHING, False

    def add(self, key: str | None, value) -> None:
        if value is NOTHING:
            return
        if self.open:
            top = self.open[-1]
            if type(top) is list:
                top.append(value)
            elif key is not None:
                top[key] = value
        elif not self.holds:
            self.root, self.holds = value, True

    def begin(self, key: str | None, node) -> None:
        if self.open:
            self.add(key, node)
        self.open.append(node)

    def end(self) -> None:
        if self.open:
            node = self.open.pop()
            if not self.open:  # a closed root gives way to what follows
                self.root, self.holds = node, False
        else:
            self.holds = False

    def scalar(self, at: int) -> tuple[object, int]:
        """(value, place after it); the place is at a separator, a closer or the end."""
        data, c = self.data, self.data[at : at + 1]
        if c == b'"':
            m = _QUOTED.match(data, at + 1)
            return unescape(m[0]), m.end() + 1
        if c == b"/":
            m = _PATTERN.match(data, at)
            return (Regex(m[0].decode("utf-8", "replace")) if m.end() > at + 1 else ""), m.end()
        if data.startswith(b"null", at):
            return None, at + 4
        m = _BARE.match(data, at)
        if not m:
            return NOTHING, at
        for word, value in ((b"true", True), (b"false", False)):
            if m[0].endswith(word):
                return value, m.end()
        return _number(m[0]), m.end()

    def read(self):
        data, n, at, key = self.data, len(self.data), 0, None
        while True:
            at = _GAP.match(data, at).end()
            if at >= n or data[at] == 0:
                break
            c = data[at : at + 1]
            if c in b"}]":
                self.end()
                at += 1
            elif c in b"{[":
                following = data[at + 1 : at + 2]
                shape = following if following in (b"}", b"]") else {b"{": b"}", b"[": b"]"}[c]
                self.begin(key, {} if shape == b"}" else [])
                key = None
                at += 1
            elif self.open and type(self.open[-1]) is dict and c in b"\"'":
                m = _QUOTED.match(data, at + 1)
                name = unescape(m[0])
                at = _BLANK.match(data, _TO_COLON.match(data, m.end() + 1).end() + 1).end() if m.end() < n else n
                if at >= n:
                    break
                if data[at : at + 1] in (b"{", b"["):
                    key = name
                    continue
                bare = data[at : at + 1] not in (b'"', b"/") and not data.startswith(b"null", at)
                value, at = self.scalar(at)
                self.add(name, value)
                if bare and not isinstance(value, bool) and data[at : at + 1] == b"]":
                    self.end()  # the closer then closes once more
            else:
                value, to = self.scalar(at)
                self.add(None, value)
                at = max(to, at + 1)
        while self.open:
            self.end()
        return self.root


def parse(text: str | bytes | None):
    """The tree of a text, or NOTHING. Strict JSON that both readers read alike takes the fast one."""
    if text is None:
        return NOTHING
    if isinstance(text, str) and not _NOT_ALIKE.search(text):
        try:
            return _strict(text)
        except (ValueError, RecursionError):
            pass
    return _Reader(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else bytes(text)).read()


def number_text(x: float) -> str:
    """A double as Java prints it; not finite ones as words."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return f"{x:.1f}" if x == int(x) else repr(x) if "e" not in repr(x) else f"{x:f}".rstrip("0")
    digits, _, power = f"{x!r}".partition("e")
    if power:
        return f"{digits if '.' in digits else digits + '.0'}E{int(power)}"
    sign, body = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
    whole, _, rest = body.partition(".")
    if whole != "0":
        tail = (whole[1:] + rest).rstrip("0") or "0"
        return f"{sign}{whole[0]}.{tail}E{len(whole) - 1}"
    bare = rest.lstrip("0")
    return f"{sign}{bare[0]}.{bare[1:] or '0'}E{-(len(rest) - len(bare) + 1)}"


def _leaf(x, strict: bool) -> str:
    kind = type(x)
    if kind is str:
        return _quoted(x)
    if kind is bool:
        return "true" if x else "false"
    if kind is int:
        return str(x)
    if x is None:
        return "null"
    if kind is float:
        t = number_text(x)
        return _quoted("+Infinity" if t == "Infinity" else t) if t[-1] in "Ny" else t
    return str(x) if isinstance(x, Regex) and not strict else _quoted(str(x))


def _compact(x, strict: bool, put: Callable[[str], None]) -> None:
    kind = type(x)
    if kind is dict:
        mark = "{"
        for key, v in x.items():
            put(f"{mark}{_quoted(key)}:")
            _compact(v, strict, put)
            mark = ","
        put("{}" if mark == "{" else "}")
    elif kind is list:
        mark = "["
        for v in x:
            put(mark)
            _compact(v, strict, put)
            mark = ","
        put("[]" if mark == "[" else "]")
    else:
        put(_leaf(x, strict))


def dump(tree, pretty: bool = False, strict: bool = False) -> str | None:
    """Compact text, or with 4 spaces for each level. ``strict`` writes regular expressions as strings. NOTHING gives None."""
    if tree is NOTHING:
        return None
    out: list[str] = []
    if not pretty:
        try:
            _compact(tree, strict, out.append)
            return "".join(out)
        except RecursionError:  # deep trees are written without recursion
            out.clear()
    stack: list = [("value", tree, 0)]
    while stack:
        what, x, level = stack.pop()
        if what == "text":
            out.append(x)
        elif isinstance(x, (list, dict)) and x:
            items = list(x.items()) if isinstance(x, dict) else [(None, v) for v in x]
            opened, closed = "{}" if isinstance(x, dict) else "[]"
            out.append(opened)
            line = "\n" + "    " * (level + 1) if pretty else ""
            todo: list = []
            for k, (key, v) in enumerate(items):
                lead = ("," if k else "") + line + ((_quoted(key) + (": " if pretty else ":")) if key is not None else "")
                todo += [("text", lead, 0), ("value", v, level + 1)]
            todo.append(("text", ("\n" + "    " * level if pretty else "") + closed, 0))
            stack.extend(reversed(todo))
        elif isinstance(x, list):
            out.append("[]")
        elif isinstance(x, dict):
            out.append("{}")
        else:
            out.append(_leaf(x, strict))
    return "".join(out)


_KINDS = {type(None): "null", bool: "boolean", int: "int", float: "double", Regex: "regex", str: "string", list: "array", dict: "dictionary", type(NOTHING): None}


def kind(x) -> str | None:
    """Type tag: null, boolean, int, double, string, regex, array or dictionary."""
    return _KINDS[type(x)]


def shortlex(text: str) -> tuple[int, bytes]:
    """Sort key: shorter first, then by bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw


def _rebuild(tree, make):
    """``make`` applied to every container after its children, without recursion."""
    holder = [tree]
    stack = [(holder, 0, False)]
    while stack:
        parent, at, done = stack.pop()
        x = parent[at]
        if done:
            parent[at] = make(x)
        elif isinstance(x, (list, dict)):
            parent[at] = x = x.copy()
            stack.append((parent, at, True))
            stack.extend((x, k, False) for k in (x if isinstance(x, dict) else range(len(x))))
    return holder[0]


def sort_keys(tree):
    """Keys of all objects in shortlex order; arrays as they are."""
    return _rebuild(tree, lambda x: dict(sorted(x.items(), key=lambda kv: shortlex(kv[0]))) if isinstance(x, dict) else x)


def sort_all(tree):
    """Keys, and the items of arrays by their sorted text, in shortlex order."""
    return _rebuild(tree, lambda x: dict(sorted(x.items(), key=lambda kv: shortlex(kv[0]))) if isinstance(x, dict) else sorted(x, key=lambda v: shortlex(dump(v))))


def same(a, b) -> bool:
    """Equal in type, order and value: 1 is not 1.0, and objects with other key orders differ."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if type(x) is not type(y):
            return False
        if isinstance(x, dict):
            if list(x) != list(y):
                return False
            stack.extend(zip(x.values(), y.values()))
        elif isinstance(x, list):
            if len(x) != len(y):
                return False
            stack.extend(zip(x, y))
        elif x != y:
            return False
    return True


def reify(tree, null=None):
    """Plain Python values: regular expressions as text, ``null`` in the place of each null."""
    holder = [tree]
    stack = [(holder, 0)]
    while stack:
        parent, at = stack.pop()
        x = parent[at]
        if isinstance(x, (list, dict)):
            parent[at] = x = x.copy()
            stack.extend((x, k) for k in (x if isinstance(x, dict) else range(len(x))))
        elif x is None or x is NOTHING:
            parent[at] = null
        elif isinstance(x, Regex):
            parent[at] = str(x)
    return holder[0]


def nodes(tree) -> Iterator[tuple]:
    """(path, depth, ord, key, kind, n_children, text, parent path with positions) of each node, in document order.

    ``path`` has ``[]`` for a step into an array, so that its items share one.
    """
    if tree is NOTHING:
        return
    stack: list = [((), 0, 0, None, tree, ())]
    while stack:
        path, depth, order, key, x, place = stack.pop()
        n = len(x) if isinstance(x, (list, dict)) else 0
        yield path, depth, order, key, kind(x), n, dump(x), place
        if isinstance(x, dict):
            stack.extend(reversed([((*path, k), depth + 1, i, k, v, (*place, k)) for i, (k, v) in enumerate(x.items())]))
        elif isinstance(x, list):
            stack.extend(reversed([((*path, "[]"), depth + 1, i, None, v, (*place, str(i))) for i, v in enumerate(x)]))


_CONVERSIONS: dict[type, Callable] = {}


def register_conversion(kind: type, convert: Callable) -> None:
    """Values of ``kind`` (and its subclasses) become what ``convert`` makes of them, which is converted in turn."""
    _CONVERSIONS[kind] = convert


def from_python(value, inside: bool = False):
    """A tree from Python values: numbers, text, None, sequences, mappings, dates, dataclasses, and kinds with a conversion.

    A kind has one if it is registered or has a method ``to_document``. Keys that are no text are
    left out. Other kinds become null inside a container and raise on their own.
    """
    import dataclasses
    import datetime
    import decimal

    if value is None or isinstance(value, (bool, Regex)):
        return value
    if type(value) not in (str, int, float, list, dict):
        for kind in type(value).__mro__:
            if kind in _CONVERSIONS:
                return from_python(_CONVERSIONS[kind](value), inside)
        if hasattr(value, "to_document"):
            return from_python(value.to_document(), inside)
    if isinstance(value, str):
        return str(value)
    if isinstance(value, int):
        return int(value)
    if isinstance(value, (float, decimal.Decimal)):
        return float(value)
    if isinstance(value, datetime.datetime):
        moment = value.astimezone(datetime.timezone.utc) if value.tzinfo else value
        return moment.strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: from_python(getattr(value, f.name), True) for f in dataclasses.fields(value) if getattr(value, f.name) is not None}
    if isinstance(value, dict):
        return {k: from_python(v, True) for k, v in value.items() if isinstance(k, str)}
    if isinstance(value, (list, tuple)):
        return [from_python(v, True) for v in value]
    if inside:
        return None
    raise TypeError(f"no document can be made of {type(value)}")
