"""Definitions, options and results of loads."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import Enum

from pyspark.sql import types as T

from millrace.functions.types import TypeDef

TIMESTAMP = "_timestamp"
MAX_COLUMNS = {"snowflake": 10000, "redshift": 1600}
TABLE_NAME = re.compile(r"^[-_A-Za-z\d$]+$")
TEMPORARY_PREFIX = "__temp_"


class TypeMode(Enum):
    STRING = "string"
    USER = "user"


class TimestampMode(Enum):
    NONE = "none"
    CURRENT = "current"
    FROM_SOURCE = "from_source"


class ChangePolicy(Enum):
    """When a row counts as changed."""

    EMPTY_EQ_NULL = "empty_eq_null"  # compared as text, null equals empty
    DISTINCT = "distinct"  # null-safe comparison of values
    STRING_NE = "string_ne"  # the source's null equals empty; the destination's null never differs


class MatchPolicy(Enum):
    """When keys match; a destination's null key never does."""

    EXACT = "exact"
    SOURCE_EMPTY = "source_empty"  # the source's null key is the empty string
    SOURCE_EMPTY_AS_TEXT = "source_empty_as_text"  # and the destination's key is compared as text


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: TypeDef

    @staticmethod
    def generic(name: str, dialect: str = "snowflake") -> ColumnDef:
        """A string column that is not null and empty by default."""
        return ColumnDef(name, TypeDef(dialect, "STRING" if dialect == "bigquery" else "VARCHAR", None, False, "''"))

    @staticmethod
    def timestamp(dialect: str = "snowflake") -> ColumnDef:
        return ColumnDef(TIMESTAMP, TypeDef(dialect, "TIMESTAMP_NTZ" if dialect == "snowflake" else "TIMESTAMP"))

    def field(self) -> T.StructField:
        return T.StructField(self.name, self.type.spark(), True, self.type.metadata())

    @staticmethod
    def from_field(spark_field: T.StructField) -> ColumnDef:
        meta = dict(spark_field.metadata)
        if "dialect" not in meta:
            raise ValueError(f"column {spark_field.name!r} has no definition")
        meta.pop("basetype", None)
        return ColumnDef(spark_field.name, TypeDef(meta.pop("dialect"), **meta))


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: tuple[str, ...] = ()
    temporary: bool = False
    table_type: str = "table"

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "primary_key", tuple(self.primary_key))
        if not TABLE_NAME.match(self.name):
            raise ValueError(f"invalid table name {self.name!r}")
        if self.temporary and not (self.name.startswith(TEMPORARY_PREFIX) and len(self.name) > len(TEMPORARY_PREFIX)):
            raise ValueError(f"a temporary table's name starts with {TEMPORARY_PREFIX}")
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError("duplicate column names")
        missing = [k for k in self.primary_key if k not in names]
        if missing:
            raise ValueError(f"primary key columns {missing} are not columns of {self.name}")
        for dialect, most in MAX_COLUMNS.items():
            if any(c.type.dialect == dialect for c in self.columns) and len(names) > most - 1:
                raise ValueError(f"too many columns: at most {most - 1}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnDef:
        return next(c for c in self.columns if c.name == name)

    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])


@dataclass(frozen=True)
class ImportOptions:
    convert_empty_to_null: tuple[str, ...] = ()
    incremental: bool = False
    timestamp_mode: TimestampMode = TimestampMode.CURRENT
    skip_lines: int = 0
    type_mode: TypeMode = TypeMode.STRING
    import_as_null: tuple[str, ...] = ("",)
    only_first_null_token: bool = False
    ignore_columns: tuple[str, ...] = ()
    change: ChangePolicy | None = None
    match: MatchPolicy | None = None
    auto_cast: bool = False
    import_time: datetime | None = None

    def __post_init__(self) -> None:
        for name in ("convert_empty_to_null", "import_as_null", "ignore_columns"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    @property
    def strings(self) -> bool:
        return self.type_mode is TypeMode.STRING

    @property
    def change_policy(self) -> ChangePolicy:
        return self.change or (ChangePolicy.EMPTY_EQ_NULL if self.strings else ChangePolicy.DISTINCT)

    @property
    def match_policy(self) -> MatchPolicy:
        return self.match or (MatchPolicy.SOURCE_EMPTY if self.strings else MatchPolicy.EXACT)

    def now(self) -> datetime:
        """One moment for a whole import: UTC, whole seconds."""
        return self.import_time or datetime.now(UTC).replace(microsecond=0, tzinfo=None)


@dataclass(frozen=True)
class ExportOptions:
    file_type: str = "csv"
    compressed: bool = False
    enclosure: str = '"'
    manifest: bool = True
    timezone: str | None = None
    fraction: bool = False
    slice_bytes: int = 200_000_000

    def __post_init__(self) -> None:
        if self.file_type not in ("csv", "parquet"):
            raise ValueError(f"unsupported file type {self.file_type!r}")
        if self.file_type == "parquet" and self.timezone:
            raise ValueError("a time zone can only be set for CSV")


@dataclass
class ImportState:
    staging: str = ""
    imported_rows: int = 0
    imported_columns: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    timers: list[dict[str, float | str]] = field(default_factory=list)

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        """Wall-clock time of an action; lazy steps take none."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.timers.append({"name": name, "durationSeconds": time.perf_counter() - began})
