"""Column expressions of the load projections. All are JVM-side built-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """An identifier for Spark SQL; an embedded quote is doubled."""
    return "`" + name.replace("`", "``") + "`"


def sql_literal(value: str | None, dialect: str = "spark") -> str:
    """A string literal; an embedded quote is doubled, or escaped where the dialect wants it."""
    if value is None:
        return "NULL"
    if dialect in ("bigquery", "spark"):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + value.replace("'", "''") + "'"


def identifier(name: str, dialect: str) -> str:
    """An identifier as the dialect quotes it."""
    mark = "`" if dialect in ("bigquery", "mysql", "spark") else '"'
    return mark + name.replace(mark, mark * 2) + mark


def column(name: str) -> Column:
    return F.col(quoted(name))


def null_to_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def tokens_to_null(value: Column, tokens: list[str]) -> Column:
    """Null where the raw field equals one of the tokens; an absent field is an empty one first."""
    raw = F.coalesce(value, F.lit(""))
    return F.when(~raw.isin(tokens), raw) if tokens else raw


def as_variant(value: Column) -> Column:
    """A string stays a string inside the variant; it is not parsed."""
    return value.cast("variant")


def as_object(value: Column) -> Column:
    """Parsed JSON that must be an object."""
    parsed = F.parse_json(value)
    wrong = value.isNotNull() & ~F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(wrong, F.raise_error(F.concat(F.lit("VALUE_CONVERSION: not an object: "), value)).cast("variant")).otherwise(parsed)


def as_array(value: Column) -> Column:
    """Parsed JSON that must be an array."""
    parsed = F.from_json(value, "array<variant>")
    return F.when(value.isNotNull() & parsed.isNull(), F.raise_error(F.concat(F.lit("VALUE_CONVERSION: not an array: "), value)).cast("array<variant>")).otherwise(parsed)


def as_vector(value: Column, dim: int, element: str = "float") -> Column:
    """Parsed JSON that must be an array of ``dim`` numbers."""
    parsed = F.from_json(value, f"array<{element}>")
    wrong = value.isNotNull() & (parsed.isNull() | (F.size(parsed) != dim))
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"VALUE_CONVERSION: not a vector of {dim}: "), value)).cast(f"array<{element}>")).otherwise(parsed)


def any_of(conditions: list[Column], empty: bool) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(empty)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def csv_field(value: Column, is_string: bool, enclosure: str = '"') -> Column:
    """A field by type: null is nothing, strings are enclosed, an empty string is two enclosures."""
    text = value.cast("string")
    if is_string and enclosure:
        text = F.concat(F.lit(enclosure), F.replace(text, F.lit(enclosure), F.lit(enclosure * 2)), F.lit(enclosure))
    return F.coalesce(text, F.lit(""))
