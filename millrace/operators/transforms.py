"""The load semantics as pure transforms from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import expressions as E
from millrace.functions.expressions import column
from millrace.model import TIMESTAMP, ChangePolicy, ImportOptions, MatchPolicy, TableDef, TimestampMode

_ROW, _D, _S = "__millrace_row", "__millrace_d", "__millrace_s"
BROADCAST_BYTES = 64 << 20


def _orderable(df: DataFrame, name: str) -> Column:
    """A column to sort by; variants and what holds them sort by their JSON text."""
    kind = df.schema[name].dataType
    if "variant" in kind.simpleString() or isinstance(kind, T.MapType):
        return F.to_json(column(name))
    return column(name)


def dedup(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each key. Of equal keys the first by all other columns, ascending with nulls first, stays; null keys
    form a group. Without a key nothing is removed. Catalyst limits each group before the shuffle, so hot keys send
    one row for each task."""
    if not key:
        return df
    rest = [c for c in df.columns if c not in set(key)]
    order = [_orderable(df, c).asc_nulls_first() for c in [*key, *rest]]
    window = Window.partitionBy(*[column(k) for k in key]).orderBy(*order)
    return df.withColumn(_ROW, F.row_number().over(window)).where(F.col(_ROW) == 1).drop(_ROW)


def unique_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The distinct keys, null keys included."""
    return df.select(*[column(k) for k in key]).distinct()


def _is_string(destination: TableDef | None, name: str, df: DataFrame) -> bool:
    if destination is not None and name in destination.names:
        return destination.column(name).type.base_type == "STRING" and isinstance(df.schema[name].dataType, T.StringType)
    return isinstance(df.schema[name].dataType, T.StringType)


def normalised(df: DataFrame, options: ImportOptions, destination: TableDef | None = None) -> DataFrame:
    """Nulls and empty strings as the load wants them, and casts to the destination's types.

    String mode: null becomes empty; in columns that convert, empty becomes null; columns of other base types pass.
    Typed mode: semi-structured targets are cast, all else passes.
    """
    convert, out = set(options.convert_empty_to_null), []
    for name in df.columns:
        value, text = column(name), _is_string(destination, name, df)
        if options.strings:
            if text:
                value = E.empty_to_null(value) if name in convert else E.null_to_empty(value)
            elif destination is not None and name in destination.names and isinstance(df.schema[name].dataType, T.StringType) and name != TIMESTAMP:
                value = (E.empty_to_null(value) if name in convert else value).cast(destination.column(name).type.spark())
        elif options.auto_cast and destination is not None and name in destination.names and name not in options.ignore_columns:
            value = auto_cast(value, df.schema[name].dataType, destination, name)
        out.append(value.alias(name))
    return df.select(*out)


def auto_cast(value: Column, have: T.DataType, destination: TableDef, name: str) -> Column:
    """The cast to a semi-structured destination type, if the source's type differs."""
    kind = destination.column(name).type
    if kind.dialect != "snowflake" or not isinstance(have, T.StringType):
        return value
    if kind.key == "VARIANT":
        return E.as_variant(value)
    if kind.key == "OBJECT":
        return E.as_object(value)
    if kind.key == "ARRAY":
        return E.as_array(value)
    if kind.key == "VECTOR":
        element, dim = kind.length.split(",")
        return E.as_vector(value, int(dim), "float" if element.upper() == "FLOAT" else "int")
    return value


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as text."""
    return df.select(*[column(c).cast("string").alias(c) for c in df.columns])


def with_timestamp(df: DataFrame, options: ImportOptions, now: datetime | None = None) -> DataFrame:
    """The import's one timestamp, unless the source brings its own or none is wanted."""
    if options.timestamp_mode is TimestampMode.NONE:
        return df.drop(TIMESTAMP)
    if options.timestamp_mode is TimestampMode.FROM_SOURCE or TIMESTAMP in df.columns:
        return df
    return df.withColumn(TIMESTAMP, F.lit(str(now or options.now())).cast("timestamp_ntz"))


def changed(columns: Sequence[str], policy: ChangePolicy, left: str = "d", right: str = "s", types: dict[str, T.DataType] | None = None) -> Column:
    """Whether any column differs between two aliased sides; without columns everything counts as changed."""
    out = []
    for c in columns:
        d, s = F.col(f"{left}.{E.quoted(c)}"), F.col(f"{right}.{E.quoted(c)}")
        if policy is ChangePolicy.EMPTY_EQ_NULL:
            out.append(E.null_to_empty(d.cast("string")) != E.null_to_empty(s.cast("string")))
        elif policy is ChangePolicy.STRING_NE:
            out.append(F.coalesce(d.cast("string") != E.null_to_empty(s.cast("string")), F.lit(False)))
        elif types and "variant" in types[c].simpleString():
            out.append(~F.to_json(d).eqNullSafe(F.to_json(s)))
        else:
            out.append(~d.eqNullSafe(s))
    return E.any_of(out, True)


def matched(key: Sequence[str], policy: MatchPolicy, left: str = "d", right: str = "s") -> Column:
    """The equi-join condition on the key; expressions stay on their side, so it hashes."""
    out = []
    for k in key:
        d, s = F.col(f"{left}.{E.quoted(k)}"), F.col(f"{right}.{E.quoted(k)}")
        if policy is MatchPolicy.EXACT:
            out.append(d == s)
        elif policy is MatchPolicy.SOURCE_EMPTY:
            out.append(d == E.null_to_empty(s))
        else:
            out.append(d.cast("string") == E.null_to_empty(s.cast("string")))
    return E.all_of(out)


def delete_matched(staging: DataFrame, destination: DataFrame, key: Sequence[str], policy: MatchPolicy = MatchPolicy.EXACT) -> DataFrame:
    """Staged rows without a partner in the destination."""
    return staging.alias("s").join(destination.alias("d"), matched(key, policy), "left_anti")


def update_candidates(destination: DataFrame, staging: DataFrame, key: Sequence[str], match: MatchPolicy, change: ChangePolicy, is_changed: bool = True) -> DataFrame:
    """Staged rows whose partner differs (or, if not ``is_changed``, does not)."""
    columns = [c for c in staging.columns if c in destination.columns and c != TIMESTAMP]
    test = changed(columns, change, types={c: destination.schema[c].dataType for c in columns})
    joined = destination.alias("d").join(staging.alias("s"), matched(key, match))
    return joined.where(test if is_changed else ~test).select("s.*")


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a frame's bytes, taken from the plan without running it; huge where it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def upsert(
    destination: DataFrame,
    staging: DataFrame,
    key: Sequence[str],
    match: MatchPolicy = MatchPolicy.EXACT,
    change: ChangePolicy = ChangePolicy.DISTINCT,
    timestamp: Column | None = None,
    values: dict[str, Column] | None = None,
    defaults: dict[str, Column] | None = None,
    small_source: bool = False,
) -> DataFrame:
    """The destination after a keyed merge of deduplicated staged rows, as one full outer join.

    A matched row takes the staged values only if some column differs; unmatched staged rows are added; columns that
    are not staged keep their values, or take ``defaults`` in new rows. ``timestamp`` goes to changed and new rows,
    unless staging has its own. Presence is told by a literal flag, since keys may be null. ``small_source`` asks for
    the form in which the destination is not shuffled: a left join with the broadcast source, and the rest of the source
    by the keys that were met, which are no more than the source's. It is taken if the source's estimated bytes are at
    most ``BROADCAST_BYTES``; rows are the same either way.
    """
    staged = [c for c in staging.columns if c in destination.columns]
    compare = [c for c in staged if c != TIMESTAMP]
    types = {c: destination.schema[c].dataType for c in compare}
    d = destination.withColumn(_D, F.lit(True)).alias("d")
    s = staging.withColumn(_S, F.lit(True)).alias("s")
    condition = matched(key, match)
    if small_source and estimated_bytes(staging) <= BROADCAST_BYTES:
        both = d.join(F.broadcast(s), condition, "left")
        met = d.join(F.broadcast(s), condition).select(*[F.col(f"s.{E.quoted(k)}").alias(f"m{i}") for i, k in enumerate(key)]).distinct()
        new = s.join(F.broadcast(met), E.all_of([F.col(f"s.{E.quoted(k)}").eqNullSafe(F.col(f"m{i}")) for i, k in enumerate(key)]), "left_anti")
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema]
        names_d, names_s = [f"d{i}" for i in range(len(d.columns))], [f"s{i}" for i in range(len(s.columns))]
        both = both.select(*[F.col(f"d.{E.quoted(c)}").alias(n) for c, n in zip(d.columns, names_d, strict=True)], *[F.col(f"s.{E.quoted(c)}").alias(n) for c, n in zip(s.columns, names_s, strict=True)])
        new = new.select(*[x.alias(n) for x, n in zip(nothing, names_d, strict=True)], *[F.col(f"s.{E.quoted(c)}").alias(n) for c, n in zip(s.columns, names_s, strict=True)])
        rows = both.unionByName(new)
        rows = rows.select(F.struct(*[F.col(n).alias(c) for c, n in zip(d.columns, names_d, strict=True)]).alias("d"), F.struct(*[F.col(n).alias(c) for c, n in zip(s.columns, names_s, strict=True)]).alias("s"))
    else:
        rows = d.join(s, condition, "full_outer")
    has_d, has_s = F.col(f"d.{_D}").isNotNull(), F.col(f"s.{_S}").isNotNull()
    take = has_s & (~has_d | changed(compare, change, types=types))
    out = []
    for field in destination.schema:
        c = field.name
        old = F.col(f"d.{E.quoted(c)}")
        if c == TIMESTAMP and TIMESTAMP not in staged and timestamp is not None:
            new = F.when(take, timestamp.cast(field.dataType)).otherwise(old)
        elif c in staged:
            value = (values or {}).get(c, F.col(f"s.{E.quoted(c)}"))
            new = F.when(take, value.cast(field.dataType) if not isinstance(field.dataType, T.VariantType) else value).otherwise(old)
        else:
            new = F.when(has_d, old).otherwise((defaults or {}).get(c, F.lit(None)).cast(field.dataType))
        out.append(new.alias(c))
    return rows.select(*out)


def aligned(df: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Columns by name in the destination's order and types; missing ones get their default or null."""
    out = []
    for field in schema:
        value = column(field.name) if field.name in df.columns else (defaults or {}).get(field.name, F.lit(None))
        have = df.schema[field.name].dataType if field.name in df.columns else None
        out.append((value if have == field.dataType else value.cast(field.dataType)).alias(field.name, metadata=field.metadata))
    return df.select(*out)
