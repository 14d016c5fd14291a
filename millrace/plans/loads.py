"""Load modes: full, create-as-select, incremental and append, from any source into a stored table."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.expressions import column
from millrace.functions.types import TypeDef
from millrace.model import TIMESTAMP, ColumnDef, ImportOptions, ImportState, MatchPolicy, TableDef, TimestampMode
from millrace.operators import checks
from millrace.operators import transforms as X
from millrace.plans.errors import MOST_ROWS, LoadError, NotNullViolation, RowTooLarge, ValueConversion, classified
from millrace.plans.store import COLUMNS, TableStore
from millrace.sources.tables import TableSource


def staging_definition(destination: TableDef, source_columns: list[str], strings: bool) -> TableDef:
    """Source order; destination types (or strings), all nullable; unknown columns are long strings."""
    dialect = destination.columns[0].type.dialect if destination.columns else "snowflake"
    text = TypeDef(dialect, "STRING" if dialect == "bigquery" else "VARCHAR", None if dialect == "bigquery" else "16777216")
    columns = []
    for name in source_columns:
        kind = text
        if not strings and name in destination.names:
            own = destination.column(name).type
            kind = TypeDef(own.dialect, own.type, own.length)
        columns.append(ColumnDef(name, kind))
    return TableDef(f"__temp_{uuid.uuid4().hex}", tuple(columns), destination.primary_key, temporary=True)


class Loader:
    """Loads into the tables of a store."""

    def __init__(self, store: TableStore):
        self.store, self.spark = store, store.spark

    # --- staging ---

    def stage(self, source: Any, destination: TableDef, options: ImportOptions, state: ImportState) -> DataFrame:
        """The source's rows as the staging table would hold them. Lazy: reading happens with the final write."""
        df = self._read(source, destination, options)
        checks.require_columns(df.columns, [*destination.names, TIMESTAMP])
        definition = staging_definition(destination, df.columns, options.strings)
        if isinstance(source, TableSource) and not options.strings:
            self._require_same_types(source, definition, options)
        state.staging, state.imported_columns = definition.name, list(df.columns)
        if not options.strings:
            # Texts become values of the destination's types; semi-structured ones wait for their own casts.
            casts = {}
            for c in definition.columns:
                kind = c.type.spark()
                if df.schema[c.name].dataType.simpleString() == "string" and kind.simpleString() != "string" and not (options.auto_cast and c.type.key in ("VARIANT", "OBJECT", "ARRAY", "VECTOR")):
                    casts[c.name] = X.auto_cast(column(c.name), df.schema[c.name].dataType, destination, c.name) if c.type.key in ("VARIANT", "OBJECT", "ARRAY", "VECTOR") and c.name in destination.names else column(c.name).cast(kind)
            df = df.withColumns(casts) if casts else df
        return df

    def _read(self, source: Any, destination: TableDef, options: ImportOptions) -> DataFrame:
        df = source.read(self.spark, options)
        if not getattr(source, "by_position", False):
            return df
        names = [c for c in destination.names if c != TIMESTAMP]
        if len(df.columns) == len(destination.names):
            names = destination.names
        if len(df.columns) != len(names):
            raise checks.ColumnsMismatch(f"tables have {len(df.columns)} and {len(names)} columns", list(df.columns), names)
        return df.toDF(*names)

    def _require_same_types(self, source: TableSource, staging: TableDef, options: ImportOptions) -> None:
        """Types and lengths of a source whose definitions the catalog knows; others are checked by their values."""
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {source.name}").collect()}
        if COLUMNS not in found:
            return
        known = {c.pop("name"): TypeDef(c.pop("dialect"), **c) for c in json.loads(found[COLUMNS])}
        read = source.columns or self.spark.table(source.name).columns
        columns = [ColumnDef(new, known[old]) for old, new in zip(read, staging.names, strict=True)]
        checks.same_columns_ordered(TableDef("source", tuple(columns)), staging, None, [*options.ignore_columns, TIMESTAMP])

    # --- loads ---

    def load(self, source: Any, table: str, options: ImportOptions = ImportOptions(), create_as_select: bool = False) -> ImportState:
        state = ImportState()
        try:
            if create_as_select and not options.incremental:
                self._create_as_select(source, table, options, state)
            elif options.incremental and self.store.definition(table).primary_key and not create_as_select:
                self._incremental(source, table, options, state)
            elif options.incremental:
                self._append(source, table, options, state)
            else:
                self._full(source, table, options, state)
        except Exception as e:
            error = classified(e)
            if isinstance(error, (NotNullViolation, RowTooLarge, ValueConversion)):
                error.with_rows(self._bad_rows(source, table, options))
            raise error from e
        return state

    def _bad_rows(self, source: Any, table: str, options: ImportOptions) -> list[str]:
        """Up to one more than ``MOST_ROWS`` values that a failed load did not take. The source is read once more, until
        that many are found; if that fails as well, there are none to tell."""
        try:
            destination = self.store.definition(table)
            df = self._read(source, destination, options).drop(*options.ignore_columns)
            texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"] if options.strings else []
            found = checks.bad_rows(df, destination, texts).limit(MOST_ROWS + 1).collect()
        except (PySparkException, Py4JError, LoadError):
            return []
        return [f"{r['problem']}: column {r['column']}" + ("" if r["value"] is None else f": {r['value']}") for r in found]

    def _projected(self, df: DataFrame, destination: TableDef, options: ImportOptions) -> DataFrame:
        df = df.drop(*options.ignore_columns)
        df = X.with_timestamp(X.normalised(df, options, destination), options)
        return df if TIMESTAMP in destination.names else df.drop(TIMESTAMP)

    def _counted(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("n")), seen

    def _full(self, source: Any, table: str, options: ImportOptions, state: ImportState) -> None:
        version, destination = self.store.version(table), self.store.definition(table)
        staged, seen = self._counted(self.stage(source, destination, options, state))
        name = "fromStagingToTargetWithDedup" if destination.primary_key else "copyFromStagingToTarget"
        with state.timed(name):
            # Keys are normalised before rows are told apart: null and empty keys are one where both become empty.
            rows = X.dedup(self._projected(staged, destination, options), destination.primary_key)
            self.store.commit(table, checks.enforced(rows, destination), version)
        state.imported_rows = seen.get["n"]

    def _create_as_select(self, source: Any, table: str, options: ImportOptions, state: ImportState) -> None:
        """Replaces the table; no dedup, no null conversion, always a timestamp."""
        version, destination = self.store.version(table), self.store.definition(table)
        staged, seen = self._counted(source.read(self.spark, options))
        fields = staged.schema.fields
        if all("dialect" in f.metadata for f in fields):
            own = TableDef(table, tuple(ColumnDef.from_field(f) for f in fields))
            checks.same_columns_unordered(own, destination, checks.STRICT, [TIMESTAMP])
        elif set(staged.columns) - {TIMESTAMP} != set(destination.names) - {TIMESTAMP}:
            raise checks.ColumnsMismatch("tables have different columns", sorted(set(staged.columns) - set(destination.names)), sorted(set(destination.names) - set(staged.columns)))
        checks.same_primary_keys(getattr(source, "primary_key", ()) or destination.primary_key, destination.primary_key)
        state.imported_columns = list(staged.columns)
        columns = [*(destination.column(c) for c in staged.columns if c != TIMESTAMP), ColumnDef.timestamp(destination.columns[0].type.dialect)]
        with state.timed("ctasLoad"):
            rows = staged.drop(TIMESTAMP).withColumn(TIMESTAMP, F.lit(str(options.now())).cast("timestamp_ntz"))
            self.store.commit(table, rows, version, TableDef(table, tuple(columns), destination.primary_key))
        state.imported_rows = seen.get["n"]

    def _incremental(self, source: Any, table: str, options: ImportOptions, state: ImportState) -> None:
        version, destination = self.store.version(table), self.store.definition(table)
        key = destination.primary_key
        staged = self.stage(source, destination, options, state).drop(*options.ignore_columns)
        if options.strings:
            # Normalise keys first, so that null and empty keys do not become two rows of one key.
            staged = staged.withColumns({k: F.coalesce(column(k), F.lit("")) for k in key if staged.schema[k].dataType.simpleString() == "string"})
        rows, seen = self._counted(X.dedup(staged, key))
        normal = X.normalised(rows, options, destination)
        stamp = None
        if options.timestamp_mode is TimestampMode.CURRENT and TIMESTAMP in destination.names:
            stamp = F.lit(str(options.now())).cast("timestamp_ntz")
        match = MatchPolicy.EXACT if options.match_policy is MatchPolicy.SOURCE_EMPTY and not options.strings else options.match_policy
        with state.timed("updateTargetTable"):
            merged = X.upsert(self.store.read(table), normal, key, match, options.change_policy, stamp)
            self.store.commit(table, checks.enforced(merged, destination), version)
        state.imported_rows = seen.get["n"]

    def _append(self, source: Any, table: str, options: ImportOptions, state: ImportState) -> None:
        destination = self.store.definition(table)
        staged, seen = self._counted(self.stage(source, destination, options, state))
        with state.timed("insertIntoTargetFromStaging"):
            self.store.append(table, checks.enforced(self._projected(staged, destination, options), destination))
        state.imported_rows = seen.get["n"]
