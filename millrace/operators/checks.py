"""Validation of columns, keys, types and values before a load."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import any_of, column
from millrace.model import ColumnDef, TableDef
from millrace.plans.errors import ColumnsMismatch

MINIMAL, LENGTH, STRICT = 0, 1, 2

# Types whose columns may be loaded into longer ones; lengths of all other types must be equal.
MAY_GROW = (
    ["NUMBER", "DECIMAL", "NUMERIC"]
    + ["VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT"]
    + ["TIME", "DATETIME", "TIMESTAMP", "TIMESTAMP_NTZ", "TIMESTAMP_LTZ", "TIMESTAMP_TZ"]
    + ["FLOAT", "FLOAT4", "FLOAT8", "REAL"]
    + ["BINARY", "VARBINARY"]
)


def require_columns(source: Sequence[str], destination: Sequence[str]) -> None:
    """The source has columns, and the destination has all of them; names compare exactly."""
    if not source:
        raise ColumnsMismatch("no columns found in the source", [], list(destination))
    missing = [c for c in source if c not in set(destination)]
    if missing:
        raise ColumnsMismatch(f"columns missing in the destination: {', '.join(missing)}", missing, [])


def same_length(source: ColumnDef, destination: ColumnDef, option: int) -> bool:
    """STRICT: equal; LENGTH: the source is not longer; MINIMAL: not compared."""
    a, b = source.type.length, destination.type.length
    if option & STRICT:
        return a == b
    if not option & LENGTH or a == b:
        return True
    if a is None or b is None:
        return False
    x, y = a.split(","), b.split(",")
    if len(x) != len(y):
        return True
    try:
        return all(int(i) <= int(j) for i, j in zip(x, y, strict=True))
    except ValueError:
        return a == b


def load_rule(column: ColumnDef) -> int:
    """The length rule for a column of a typed load from a table; BigQuery's own loads compare types only."""
    if column.type.dialect == "bigquery":
        return MINIMAL
    return LENGTH if column.type.key in MAY_GROW else STRICT


def _compare(pairs: Iterable[tuple[ColumnDef, ColumnDef]], option: int | None) -> None:
    for a, b in pairs:
        if a.type.key != b.type.key or not same_length(a, b, load_rule(a) if option is None else option):
            raise ColumnsMismatch(f"source {a.name} ({a.type.type_sql()}) does not match destination {b.name} ({b.type.type_sql()})", [a.name], [b.name])


def _used(columns: Iterable[ColumnDef], ignore: Iterable[str]) -> list[ColumnDef]:
    out = set(ignore)
    return [c for c in columns if c.name not in out]


def same_columns_ordered(source: TableDef, destination: TableDef, option: int | None = STRICT, ignore: Sequence[str] = ()) -> None:
    """Names, types and lengths agree pairwise; ignored columns are left out first, neighbours too. No option: each
    column's own rule for loads."""
    a, b = _used(source.columns, ignore), _used(destination.columns, ignore)
    if len(a) != len(b):
        raise ColumnsMismatch(f"tables have {len(a)} and {len(b)} columns", [c.name for c in a], [c.name for c in b])
    for x, y in zip(a, b, strict=True):
        if x.name != y.name:
            raise ColumnsMismatch(f"columns {x.name} and {y.name} do not match", [x.name], [y.name])
    _compare(zip(a, b, strict=True), option)


def same_columns_unordered(source: TableDef, destination: TableDef, option: int = STRICT, ignore: Sequence[str] = ()) -> None:
    a, b = ({c.name: c for c in _used(t.columns, ignore)} for t in (source, destination))
    if set(a) != set(b):
        raise ColumnsMismatch("tables have different columns", sorted(set(a) - set(b)), sorted(set(b) - set(a)))
    _compare(((a[n], b[n]) for n in a), option)


def same_primary_keys(a: Sequence[str], b: Sequence[str]) -> None:
    if sorted(a) != sorted(b):
        raise ColumnsMismatch(f"primary keys do not match: {list(a)} and {list(b)}", list(a), list(b))


def column_map(source: Sequence[str], destination: Sequence[str], by_order: bool = False, ignore: Sequence[str] = ()) -> dict[str, str]:
    """Source name to destination name, by order or by name."""
    a, b = ([c for c in names if c not in set(ignore)] for names in (source, destination))
    if by_order:
        if len(a) != len(b):
            raise ColumnsMismatch(f"tables have {len(a)} and {len(b)} columns", list(a), list(b))
        return dict(zip(a, b, strict=True))
    require_columns(a, b)
    return {c: c for c in a}


def in_ignoring_case(name: str, names: Iterable[str]) -> bool:
    return name.lower() in {n.lower() for n in names}


def equal_ignoring_case(a: str, b: str) -> bool:
    return a.lower() == b.lower()


def _longest(c: ColumnDef) -> int | None:
    """How long a text column's values may be, if the definition says."""
    kind = c.type
    texts = kind.base_type == "STRING" and kind.canonical in ("VARCHAR", "STRING", "CHAR", "TEXT", "NVARCHAR")
    return int(kind.length) if texts and kind.length and kind.length.isdigit() else None


def violations(definition: TableDef, present: Iterable[str]) -> Column:
    """The first rule that a row breaks, or null: NOT NULL, text too long, vector of another size."""
    out: list[Column] = []
    for c in definition.columns:
        if c.name not in set(present):
            continue
        value, kind = column(c.name), c.type
        if not kind.nullable:
            out.append(F.when(value.isNull(), F.lit(f"NOT_NULL: column {c.name}")))
        if (most := _longest(c)) is not None:
            out.append(F.when(F.length(value) > most, F.lit(f"EXCEED_LIMIT_LENGTH: column {c.name}")))
        if kind.key == "VECTOR":
            out.append(F.when(F.size(value) != int(kind.length.split(",")[1]), F.lit(f"VALUE_CONVERSION: column {c.name}")))
    return F.coalesce(*out, F.lit(None).cast("string")) if out else F.lit(None).cast("string")


def enforced(df: DataFrame, definition: TableDef) -> DataFrame:
    """The same rows; writing them fails on the first that breaks a rule. One expression in the scan, no extra pass."""
    broken = violations(definition, df.columns)
    checks = [c for c in definition.columns if c.name in df.columns]
    if not checks:
        return df
    first = checks[0].name
    dtype = df.schema[first].dataType
    return df.withColumn(first, F.when(broken.isNotNull(), F.raise_error(broken).cast(dtype)).otherwise(column(first)))


def bad_rows(df: DataFrame, definition: TableDef, nulls_allowed: Iterable[str] = ()) -> DataFrame:
    """``(column, problem, value)`` for each value that the definition does not take, in one scan without a shuffle.

    A text that is no value of its column's type, a null in a column that takes none (but for ``nulls_allowed``), a
    text that is too long. ``value`` is its first 100 characters. Semi-structured columns and vectors are not looked at.
    """
    found, free = [], set(nulls_allowed)
    for c in definition.columns:
        if c.name not in df.columns:
            continue
        value, kind, have = column(c.name), c.type.spark().simpleString(), df.schema[c.name].dataType.simpleString()
        problem = F.lit(None).cast("string")
        if not c.type.nullable and c.name not in free:
            problem = F.when(value.isNull(), "NOT_NULL")
        if have == "string" and kind == "string" and (most := _longest(c)) is not None:
            problem = F.coalesce(problem, F.when(F.length(value) > most, "EXCEED_LIMIT_LENGTH"))
        if have == "string" and not any(x in kind for x in ("string", "variant", "array", "map", "struct")):
            problem = F.coalesce(problem, F.when(value.isNotNull() & value.try_cast(kind).isNull(), "VALUE_CONVERSION"))
        shown = F.substring(value.cast("string"), 1, 100) if have in ("string", "bigint", "int", "double", "boolean", "date") else F.lit(None).cast("string")
        found.append(F.struct(F.lit(c.name).alias("column"), problem.alias("problem"), shown.alias("value")))
    if not found:
        return df.sparkSession.createDataFrame([], "column string, problem string, value string")
    return df.select(F.explode(F.filter(F.array(*found), lambda x: x["problem"].isNotNull())).alias("x")).select("x.*")


def rows_with_nulls(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.where(any_of([column(n).isNull() for n in names], False))
