"""Tables and queries as sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.expressions import column, quoted
from millrace.model import ImportOptions
from millrace.operators.transforms import as_strings


@dataclass(frozen=True)
class TableSource:
    """A catalog table, all columns or a projection that reaches the scan; optionally all as text.

    With ``by_position`` the n-th column goes to the destination's n-th column, whatever their names.
    """

    table: str
    columns: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    cast_to_string: bool = False
    schema: str | None = None
    by_position: bool = False

    @property
    def name(self) -> str:
        return f"{quoted(self.schema)}.{quoted(self.table)}" if self.schema else self.table

    def read(self, spark: SparkSession, options: ImportOptions = ImportOptions()) -> DataFrame:
        df = spark.table(self.name)
        if self.columns:
            df = df.select(*[column(c) for c in self.columns])
        return as_strings(df) if self.cast_to_string else df


@dataclass(frozen=True)
class QuerySource:
    """Any query, with named or positional bindings; ``by_position`` as for a table."""

    query: str
    bindings: dict[str, Any] | list[Any] | None = None
    columns: tuple[str, ...] = ()
    primary_key: tuple[str, ...] = ()
    views: dict[str, DataFrame] = field(default_factory=dict)
    by_position: bool = False

    def read(self, spark: SparkSession, options: ImportOptions = ImportOptions()) -> DataFrame:
        df = spark.sql(self.query, args=self.bindings or None, **self.views)
        return df.select(*[column(c) for c in self.columns]) if self.columns else df


@dataclass(frozen=True)
class FrameSource:
    """A DataFrame at hand."""

    frame: DataFrame
    primary_key: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.frame.columns)

    def read(self, spark: SparkSession, options: ImportOptions = ImportOptions()) -> DataFrame:
        return self.frame
