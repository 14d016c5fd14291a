"""Column types of several SQL dialects, their base types, rendering, and the Spark types that hold them.

Each dialect is a table of rules: which base type a type name has, how its length is checked, and which canonical
name its aliases share. All behaviour is read from these tables.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

BASE_TYPES = ("BOOLEAN", "DATE", "FLOAT", "INTEGER", "NUMERIC", "STRING", "TIMESTAMP")
DIALECTS = ("snowflake", "bigquery", "redshift", "mysql", "oracle", "generic")


class TypeError_(ValueError):
    """A type, length or option that its dialect does not know."""


class InvalidType(TypeError_):
    pass


class InvalidLength(TypeError_):
    pass


class InvalidOption(TypeError_):
    pass


class InvalidCompression(TypeError_):
    pass


# --- length rules -----------------------------------------------------------------------------------------------------


def _number(text: str) -> int | None:
    return int(float(text)) if re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", text) else None


@dataclass(frozen=True)
class Length:
    """One number from ``low`` to ``high``; ``needed`` if it may not be left out."""

    low: int
    high: int
    needed: bool = False

    def fits(self, length: str | None) -> bool:
        if length in (None, ""):
            return not self.needed
        n = _number(length)
        return n is not None and self.low <= n <= self.high


@dataclass(frozen=True)
class Precision:
    """Precision, and after a comma a scale; ``below`` asks for a scale under the precision, ``spread`` limits p - s."""

    high: int
    scale: int
    below: bool = False
    spread: int | None = None

    def fits(self, length: str | None) -> bool:
        if length in (None, ""):
            return True
        parts = [_number(p) for p in length.split(",")]
        if len(parts) > 2 or None in parts:
            return False
        p, s = parts[0], parts[1] if len(parts) == 2 else 0
        if not 0 < p <= self.high or s > self.scale or s > p or (self.below and len(parts) == 2 and s >= p):
            return False
        return self.spread is None or max(1, s) <= p <= s + self.spread


class NoLength:
    def fits(self, length: str | None) -> bool:
        return length in (None, "")


class AnyLength:
    def fits(self, length: str | None) -> bool:
        return True


class VectorLength:
    """``INT,n`` or ``FLOAT,n`` with a dimension from 1 to 4096."""

    def fits(self, length: str | None) -> bool:
        found = re.fullmatch(r"(INT|FLOAT),[^\S\r\n]*(\d{1,4})", length or "", re.I)
        return bool(found) and 1 <= int(found[2]) <= 4096


_NO, _ANY = NoLength(), AnyLength()


@dataclass(frozen=True)
class Rule:
    base: str
    length: Any = _NO
    canonical: str | None = None


def _rules(*groups: tuple[str, str, Any, str | None]) -> dict[str, Rule]:
    return {name: Rule(base, length, canonical if canonical != name else None) for names, base, length, canonical in groups for name in names.split("|")}


# Type names, base types, canonical names and length limits of each dialect.
RULES: dict[str, dict[str, Rule]] = {
    "snowflake": _rules(
        ("NUMBER|DEC|DECIMAL|NUMERIC", "NUMERIC", Precision(38, 38), "NUMBER"),
        ("INT|INTEGER|BIGINT|SMALLINT|TINYINT|BYTEINT", "INTEGER", _NO, "NUMBER"),
        ("FLOAT|FLOAT4|FLOAT8|DOUBLE|DOUBLE PRECISION|REAL", "FLOAT", _NO, "FLOAT"),
        ("VARCHAR|CHAR|CHARACTER|CHAR VARYING|CHARACTER VARYING|STRING|TEXT|NCHAR VARYING|NCHAR|NVARCHAR|NVARCHAR2", "STRING", Length(1, 134217728), "VARCHAR"),
        ("BOOLEAN", "BOOLEAN", _NO, None),
        ("DATE", "DATE", _NO, None),
        ("DATETIME|TIMESTAMP_NTZ", "TIMESTAMP", Length(0, 9), "TIMESTAMP_NTZ"),
        ("TIMESTAMP|TIMESTAMP_LTZ|TIMESTAMP_TZ", "TIMESTAMP", Length(0, 9), None),
        ("TIME", "STRING", Length(0, 9), None),
        ("BINARY|VARBINARY", "STRING", Length(1, 8388608), "BINARY"),
        ("VARIANT|OBJECT|ARRAY|GEOGRAPHY|GEOMETRY", "STRING", _NO, None),
        ("VECTOR", "STRING", VectorLength(), None),
    ),
    "bigquery": _rules(
        ("INT64|INT|SMALLINT|INTEGER|BIGINT|TINYINT|BYTEINT", "INTEGER", _NO, "INTEGER"),
        ("NUMERIC|DECIMAL", "NUMERIC", Precision(38, 9, spread=29), "NUMERIC"),
        ("BIGNUMERIC|BIGDECIMAL", "NUMERIC", Precision(76, 38, spread=38), "BIGNUMERIC"),
        ("FLOAT64|FLOAT", "FLOAT", _NO, "FLOAT64"),
        ("BOOL|BOOLEAN", "BOOLEAN", _NO, "BOOL"),
        ("DATE", "DATE", _NO, None),
        ("DATETIME|TIME|TIMESTAMP", "TIMESTAMP", _NO, None),
        ("STRING|BYTES", "STRING", Length(1, 2**63 - 1), None),
        ("GEOGRAPHY|INTERVAL|JSON", "STRING", _NO, None),
        ("ARRAY|STRUCT", "STRING", _ANY, None),
    ),
    "redshift": _rules(
        ("SMALLINT|INT2|INTEGER|INT|INT4|BIGINT|INT8", "INTEGER", _NO, None),
        ("DECIMAL|NUMERIC", "NUMERIC", Precision(37, 37), None),
        ("REAL|FLOAT4|DOUBLE PRECISION|FLOAT8|FLOAT", "FLOAT", _NO, None),
        ("BOOLEAN|BOOL", "BOOLEAN", _NO, None),
        ("VARCHAR|CHARACTER VARYING|NVARCHAR|TEXT", "STRING", Length(1, 65535), None),
        ("CHAR|CHARACTER|NCHAR|BPCHAR", "STRING", Length(1, 4096), None),
        ("DATE", "DATE", _NO, None),
        ("TIMESTAMP|TIMESTAMP WITHOUT TIME ZONE|TIMESTAMPTZ|TIMESTAMP WITH TIME ZONE", "TIMESTAMP", Length(1, 11), None),
    ),
    "mysql": _rules(
        ("INTEGER|INT|TINYINT|SMALLINT|MEDIUMINT|BIGINT", "INTEGER", Length(1, 255), None),
        ("DECIMAL|DEC|FIXED|NUMERIC", "NUMERIC", Precision(65, 30), None),
        ("FLOAT|DOUBLE PRECISION|REAL|DOUBLE", "FLOAT", Precision(255, 30, below=True), None),
        ("DATE", "DATE", _NO, None),
        ("DATETIME|TIMESTAMP", "TIMESTAMP", _NO, None),
        ("TIME", "STRING", Length(0, 6), None),
        ("CHAR", "STRING", Length(1, 255), None),
        ("VARCHAR", "STRING", Length(1, 4294967295, needed=True), None),
        ("BIT|YEAR|BLOB|TEXT", "STRING", _NO, None),
    ),
    "oracle": _rules(
        ("NUMBER|BINARY_FLOAT|BINARY_DOUBLE", "NUMERIC", _ANY, None),
        ("DATE|TIMESTAMP|TIMESTAMP WITH LOCAL TIME ZONE", "TIMESTAMP", _ANY, None),
        ("VARCHAR2|CHAR|CLOB|RAW|BLOB", "STRING", _ANY, None),
    ),
    # Matched without regard to case, spellings such as TIMESTAMP_NTZ included.
    "generic": _rules(
        ("DATE", "DATE", _ANY, None),
        ("DATETIME|DATETIME2|SMALLDATETIME|DATETIMEOFFSET|TIMESTAMP_LTZ|TIMESTAMP_NTZ|TIMESTAMP_TZ|TIMESTAMPTZ|TIMESTAMP|TIMESTAMP WITH TIME ZONE|TIMESTAMP WITH LOCAL TIME ZONE|TIMESTAMP WITHOUT TIME ZONE", "TIMESTAMP", _ANY, None),
        ("REAL|FLOAT|FLOAT4|DOUBLE PRECISION|FLOAT8|BINARY_FLOAT|BINARY_DOUBLE|DOUBLE|D_FLOAT|QUAD", "FLOAT", _ANY, None),
        ("BOOLEAN|BOOL", "BOOLEAN", _ANY, None),
        ("INTEGER|INT|SMALLINT|MEDIUMINT|INT2|TINYINT|BIGINT|INT8|BIGSERIAL|SERIAL8|INT4|INT64", "INTEGER", _ANY, None),
        ("NUMERIC|DECIMAL|DEC|FIXED|MONEY|SMALLMONEY|NUMBER", "NUMERIC", _ANY, None),
    ),
}

# The type that stands for a base type, and its length.
FOR_BASE: dict[str, dict[str, tuple[str, str | None]]] = {
    "snowflake": {"BOOLEAN": ("BOOLEAN", None), "DATE": ("DATE", None), "FLOAT": ("FLOAT", None), "INTEGER": ("INTEGER", None), "NUMERIC": ("NUMERIC", "38,9"), "STRING": ("VARCHAR", None), "TIMESTAMP": ("TIMESTAMP", None)},
    "bigquery": {"BOOLEAN": ("BOOL", None), "DATE": ("DATE", None), "FLOAT": ("FLOAT64", None), "INTEGER": ("INT64", None), "NUMERIC": ("NUMERIC", None), "STRING": ("STRING", None), "TIMESTAMP": ("TIMESTAMP", None)},
    "oracle": {"BOOLEAN": ("NUMBER", None), "DATE": ("DATE", None), "FLOAT": ("NUMBER", None), "INTEGER": ("NUMBER", None), "NUMERIC": ("NUMBER", None), "STRING": ("VARCHAR2", None), "TIMESTAMP": ("DATE", None)},
}
_NAME_FOR_BASE = {("snowflake", "NUMERIC"): "NUMBER"}

# Redshift encodings; each names the groups of types that it takes, or, after a minus, does not take.
_SMALL, _MIDDLE, _LARGE, _DECIMAL = "SMALLINT|INT2", "INT|INTEGER|INT4", "BIGINT|INT8", "DECIMAL|NUMERIC"
_TIMES = "DATE|TIMESTAMP|TIMESTAMP WITHOUT TIME ZONE|TIMESTAMPTZ|TIMESTAMP WITH TIME ZONE"
ENCODINGS = {
    "RAW": "-", "ZSTD": "-", "RUNLENGTH": "-",
    "BYTEDICT": "-BOOLEAN|BOOL",
    "LZO": "-BOOLEAN|BOOL|REAL|FLOAT4|DOUBLE PRECISION|FLOAT8|FLOAT",
    "DELTA": f"{_SMALL}|{_MIDDLE}|{_LARGE}|{_TIMES}|{_DECIMAL}",
    "DELTA32K": f"{_MIDDLE}|{_LARGE}|{_TIMES}|{_DECIMAL}",
    "MOSTLY8": f"{_SMALL}|{_MIDDLE}|{_LARGE}|{_DECIMAL}",
    "MOSTLY16": f"{_MIDDLE}|{_LARGE}|{_DECIMAL}",
    "MOSTLY32": f"{_LARGE}|{_DECIMAL}",
    "TEXT255": "VARCHAR|CHARACTER VARYING|NVARCHAR|TEXT",
    "TEXT32K": "VARCHAR|CHARACTER VARYING|NVARCHAR|TEXT",
}
OPTIONS = {"snowflake": (), "bigquery": ("fields",), "redshift": ("compression",), "mysql": (), "oracle": (), "generic": ("format",)}


@dataclass(frozen=True)
class TypeDef:
    """A checked, immutable type of one dialect; the given spelling is kept."""

    dialect: str
    type: str
    length: str | None = None
    nullable: bool = True
    default: str | None = None
    compression: str | None = None
    format: str | None = None
    fields: list | None = field(default=None, hash=False)

    def __post_init__(self) -> None:
        if self.dialect not in RULES:
            raise InvalidOption(f"unknown dialect {self.dialect!r}")
        if isinstance(self.length, dict):
            object.__setattr__(self, "length", length_from_parts(self.length))
        elif self.length is not None:
            object.__setattr__(self, "length", str(self.length))
        if self.default == "" and self.dialect != "generic":
            object.__setattr__(self, "default", None)
        for option in ("compression", "format", "fields"):
            if getattr(self, option) is not None and option not in OPTIONS[self.dialect]:
                raise InvalidOption(f"option {option!r} is not supported by {self.dialect}")
        rule = self.rule
        if rule is None and self.dialect != "generic":
            raise InvalidType(f"{self.type!r} is not a valid type")
        if rule is not None and not rule.length.fits(self.length):
            raise InvalidLength(f"{self.length!r} is not valid length for {self.type}")
        if self.compression:
            allowed = ENCODINGS.get(self.compression.upper())
            names = set((allowed or "").lstrip("-").split("|"))
            if allowed is None or (self.key in names) == allowed.startswith("-"):
                raise InvalidCompression(f"{self.compression!r} is not valid compression for {self.type}")

    @property
    def key(self) -> str:
        return self.type.upper()

    @property
    def rule(self) -> Rule | None:
        return RULES[self.dialect].get(self.key)

    @property
    def base_type(self) -> str:
        if self.dialect == "snowflake" and self.key == "NUMBER" and self.length == "38,0":
            return "INTEGER"
        return self.rule.base if self.rule else "STRING"

    @property
    def canonical(self) -> str:
        """The name that the backend itself reports."""
        return (self.rule and self.rule.canonical) or self.type

    @property
    def has_precision(self) -> bool:
        return isinstance(self.rule and self.rule.length, Precision)

    def precision_scale(self) -> tuple[int, int]:
        """Precision and scale, by default 38 and 0."""
        parts = [int(p) for p in (self.length or "38").split(",")]
        return parts[0], parts[1] if len(parts) > 1 else 0

    def type_sql(self) -> str:
        if self.dialect == "oracle" and self.key not in ("VARCHAR2", "CHAR"):
            return self.type
        if not self.length:
            return self.type
        return f"{self.type}<{self.length}>" if self.dialect == "bigquery" and self.key in ("ARRAY", "STRUCT") else f"{self.type}({self.length})"

    def sql(self) -> str:
        """The definition as its dialect writes it after a column's name."""
        sql, nulls = self.type_sql(), "" if self.nullable else " NOT NULL"
        default = f" DEFAULT {self.default}" if self.default is not None else ""
        if self.dialect == "bigquery":
            return sql if self.key in ("ARRAY", "STRUCT") else sql + default + nulls
        if self.dialect == "redshift":
            return sql + nulls + (f" ENCODE {self.compression}" if self.compression else "")
        if self.dialect == "generic":
            default = f" DEFAULT '{self.default}'" if self.default is not None else " DEFAULT NULL" if self.nullable else ""
            return sql + (" NULL" if self.nullable else " NOT NULL") + default
        return sql + nulls + default

    def as_dict(self) -> dict[str, Any]:
        out = {"type": self.type, "length": self.length, "nullable": self.nullable}
        for name in ("default", "compression", "format", "fields"):
            if getattr(self, name) is not None:
                out[name] = getattr(self, name)
        return out

    def metadata(self) -> dict[str, Any]:
        """What a Spark field keeps beside its type."""
        return {"dialect": self.dialect, "basetype": self.base_type, **self.as_dict()}

    def spark(self) -> T.DataType:
        """The Spark type that holds this type's values."""
        key, base = self.key, self.base_type
        if self.dialect == "bigquery" and key in ("ARRAY", "STRUCT"):
            from millrace.functions.nested import parse_type, to_spark

            return to_spark(parse_type(self.type_sql())) if self.length else T.StringType()
        if key == "VECTOR":
            return T.ArrayType(T.FloatType() if self.length.upper().startswith("FLOAT") else T.IntegerType())
        if key in ("VARIANT", "OBJECT", "JSON"):
            return T.VariantType()
        if self.dialect == "snowflake" and key == "ARRAY":
            return T.ArrayType(T.VariantType())
        if key in ("BINARY", "VARBINARY", "BYTES", "RAW", "BLOB"):
            return T.BinaryType()
        if base == "NUMERIC":
            if self.dialect == "oracle" and key.startswith("BINARY_"):
                return T.DoubleType()
            p, s = self.precision_scale() if self.length else (38, 9) if self.dialect == "bigquery" else (38, 0)
            return T.DecimalType(p, s) if p <= 38 else T.StringType()
        if base == "TIMESTAMP":
            local = key in ("TIMESTAMP_LTZ", "TIMESTAMP_TZ", "TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITH LOCAL TIME ZONE", "DATETIMEOFFSET")
            if key == "TIME":
                return T.StringType()
            return T.TimestampType() if local or (self.dialect == "bigquery" and key == "TIMESTAMP") else T.TimestampNTZType()
        return {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType()}.get(base, T.StringType())


def length_from_parts(parts: dict[str, Any]) -> str | None:
    """A length from ``character_maximum`` or ``numeric_precision`` and ``numeric_scale``."""
    unknown = set(parts) - {"character_maximum", "numeric_precision", "numeric_scale"}
    if unknown:
        raise InvalidOption(f"length option {sorted(unknown)[0]!r} not supported")
    if parts.get("character_maximum") is not None:
        return str(parts["character_maximum"])
    p, s = parts.get("numeric_precision"), parts.get("numeric_scale")
    return None if p is None else str(p) if s is None else f"{p},{s}"


def type_for_base(dialect: str, base: str) -> str:
    """The dialect's type name for a base type."""
    return _NAME_FOR_BASE.get((dialect, base.upper())) or _for_base(dialect, base)[0]


def definition_for_base(dialect: str, base: str) -> TypeDef:
    name, length = _for_base(dialect, base)
    return TypeDef(dialect, name, length)


def _for_base(dialect: str, base: str) -> tuple[str, str | None]:
    if base.upper() not in BASE_TYPES:
        raise InvalidType(f"base type {base!r} is not valid")
    if dialect not in FOR_BASE:
        raise NotImplementedError(f"{dialect} has no type by base type")
    return FOR_BASE[dialect][base.upper()]


def parse_type_text(dialect: str, text: str, nullable: bool = True, default: str | None = None) -> TypeDef:
    """A definition from catalog text such as ``NUMBER(38,0)`` or ``VARCHAR(10)``."""
    found = re.fullmatch(r"\s*([^(<]+?)\s*(?:\(([^)]*)\)|<(.*)>)?\s*([^()<>]*)", text, re.S)
    if not found:
        raise InvalidType(f"{text!r} is not a valid type")
    name = " ".join(x for x in (found[1], found[4].strip()) if x)
    length = found[2] if found[2] is not None else found[3]
    return TypeDef(dialect, name, length.replace(" ", "") if found[2] is not None else length, nullable, default)
