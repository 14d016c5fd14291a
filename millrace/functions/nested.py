"""Nested types such as ``ARRAY<STRUCT<a INT64, b STRING(10)>>``: text, field schemas and Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from millrace.functions.types import InvalidLength

_TOKEN = re.compile(r"\s*(?:([A-Za-z_][\w$-]*|`[^`]+`)|(\([^)]*\))|([<>,]))")
# Names that the field schema uses for types.
FIELD_NAMES = {"INT": "INTEGER", "INT64": "INTEGER", "SMALLINT": "INTEGER", "BIGINT": "INTEGER", "TINYINT": "INTEGER", "BYTEINT": "INTEGER", "DECIMAL": "NUMERIC", "BIGDECIMAL": "BIGNUMERIC", "FLOAT": "FLOAT64", "BOOLEAN": "BOOL"}


@dataclass
class Nested:
    """A type: its name, length, element of an array, or named fields of a struct."""

    type: str
    length: str | None = None
    element: Nested | None = None
    fields: list[tuple[str, Nested]] = field(default_factory=list)
    required: bool = False


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise InvalidLength(f"unexpected {text[at:]!r}")
        out.append(found[1] or found[2] or found[3])
        at = found.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.items, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self, expected: str | None = None) -> str:
        item = self.peek()
        if item is None or (expected is not None and item != expected):
            raise InvalidLength(f"unexpected {item!r}" + (f", expected {expected!r}" if expected else ""))
        self.at += 1
        return item

    def name(self) -> str:
        item = self.take()
        if item[0] in "(<>,":
            raise InvalidLength(f"unexpected {item!r}, a name is expected")
        return item.strip("`")

    def type(self) -> Nested:
        out = Nested(self.name().upper())
        if out.type == "ARRAY":
            self.take("<")
            out.element = self.type()
            self.take(">")
        elif out.type == "STRUCT":
            self.take("<")
            while self.peek() != ">":
                out.fields.append((self.name(), self.type()))
                if self.peek() == ",":
                    self.take()
                elif self.peek() != ">":
                    raise InvalidLength(f"unexpected {self.peek()!r} in STRUCT")
            self.take(">")
        elif self.peek() and self.peek()[0] == "(":
            out.length = re.sub(r"\s+", "", self.take()[1:-1])
        if (self.peek() or "").upper() == "NOT":
            self.take()
            if self.take().upper() != "NULL":
                raise InvalidLength("NULL is expected after NOT")
            out.required = True
        return out


def parse_type(text: str) -> Nested:
    parser = _Parser(text)
    out = parser.type()
    if parser.peek() is not None:
        raise InvalidLength(f"unexpected {parser.peek()!r} after the type")
    return out


def to_text(node: Nested) -> str:
    if node.element is not None:
        return f"ARRAY<{to_text(node.element)}>"
    if node.type == "STRUCT":
        return "STRUCT<" + ",".join(f"{name} {to_text(child)}" for name, child in node.fields) + ">"
    return node.type + (f"({node.length})" if node.length else "")


def to_field(name: str | None, node: Nested) -> dict:
    """The field schema of a column: a repeated mode stands for an array, a record for a struct."""
    out = {"name": name} if name is not None else {}
    if node.element is not None:
        inner = to_field(None, node.element)
        return out | inner | {"mode": "REPEATED"}
    if node.type == "STRUCT":
        out |= {"type": "RECORD", "fields": [to_field(n, c) for n, c in node.fields]}
    else:
        out["type"] = FIELD_NAMES.get(node.type, node.type)
        if node.length and out["type"] in ("STRING", "BYTES"):
            out["maxLength"] = node.length
        elif node.length and out["type"] in ("NUMERIC", "BIGNUMERIC"):
            p, _, s = node.length.partition(",")
            out |= {"precision": p} | ({"scale": s} if s else {})
    return out | ({"mode": "REQUIRED"} if node.required else {})


def from_field(schema: dict) -> Nested:
    """The inverse of ``to_field``."""
    kind = schema["type"].upper()
    if kind in ("RECORD", "STRUCT"):
        node = Nested("STRUCT", fields=[(f["name"], from_field(f)) for f in schema.get("fields", [])])
    else:
        length = schema.get("maxLength") or ",".join(str(schema[k]) for k in ("precision", "scale") if schema.get(k) not in (None, "")) or None
        node = Nested(kind, length and str(length))
    mode = (schema.get("mode") or "NULLABLE").upper()
    if mode == "REPEATED":
        return Nested("ARRAY", element=node)
    node.required = mode == "REQUIRED"
    return node


def to_spark(node: Nested) -> T.DataType:
    if node.element is not None:
        return T.ArrayType(to_spark(node.element))
    if node.type == "STRUCT":
        return T.StructType([T.StructField(n, to_spark(c), not c.required) for n, c in node.fields])
    from millrace.functions.types import TypeDef

    return TypeDef("bigquery", node.type, node.length).spark()
