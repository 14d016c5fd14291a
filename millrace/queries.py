"""Queries over the given tables, one for each operator of the engine, with equivalent SQL.

The tables hold no nulls or empty strings where null handling matters, so expressions inject them by key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import expressions as E
from millrace.functions.types import TypeDef
from millrace.model import ChangePolicy, ColumnDef, ExportOptions, ImportOptions, MatchPolicy, TableDef, TimestampMode, TypeMode
from millrace.operators import checks
from millrace.operators import transforms as X
from millrace.plans.loads import Loader
from millrace.plans.store import TableStore
from millrace.session import read_table
from millrace.sources.export import csv_lines, export
from millrace.sources.files import FileSource
from millrace.sources.tables import FrameSource, QuerySource, TableSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
STAMP = "2022-02-02 00:00:00"
VECTOR_SIZE = 64  # as the given table declares it
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return register


def _stamp():
    return F.lit(STAMP).cast("timestamp_ntz")


def _first_sql(key: list[str], rest: list[str], table: str = "lineitem") -> str:
    order = ", ".join(f"{c} asc nulls first" for c in [*key, *rest])
    return f"select * exclude (rn) from (select *, row_number() over (partition by {', '.join(key)} order by {order}) as rn from {table}) where rn = 1"


# --- full loads ---


@query(_first_sql(["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber", *LINES[2:]]))
def full_load_dedup_single_pk(spark: SparkSession, sf: str) -> DataFrame:
    return X.dedup(read_table(spark, sf, "lineitem"), ["l_orderkey"])


@query(_first_sql(["l_orderkey", "l_linenumber"], LINES))
def full_load_dedup_multi_pk(spark: SparkSession, sf: str) -> DataFrame:
    return X.dedup(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"select *, timestamp '{STAMP}' as _timestamp from orders")
def full_load_no_pk(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "orders")
    return X.with_timestamp(X.normalised(df, ImportOptions(type_mode=TypeMode.USER)), ImportOptions(), STAMP)


@query(f"select *, timestamp '{STAMP}' as _timestamp from customer")
def full_load_ctas(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").withColumn("_timestamp", _stamp())


@query(f"select * exclude (rn), timestamp '{STAMP}' as _timestamp from (select k, v, row_number() over (partition by k order by k, v) as rn from (select case when o_orderkey % 7 = 0 then '' else o_orderstatus end as k, case when o_orderkey % 5 = 0 then '' else o_orderpriority end as v from orders)) where rn = 1")
def full_load_string_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Null and empty keys are one key once they are normalised."""
    df = read_table(spark, sf, "orders")
    key = F.when(F.col("o_orderkey") % 14 == 0, F.lit(None)).when(F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.col("o_orderstatus"))
    df = df.select(key.alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("v"))
    return X.with_timestamp(X.dedup(X.normalised(df, ImportOptions()), ["k"]), ImportOptions(), STAMP)


# --- incremental loads ---

_DEST = f"select *, timestamp '2021-01-01 00:00:00' as _timestamp from orders where o_orderkey % 3 <> 0"
_SRC = "select o_orderkey, o_custkey, case when o_orderkey % 4 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_orderkey % 2 = 0"


def _slices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    destination = orders.where(k % 3 != 0).withColumn("_timestamp", F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"))
    source = orders.where(k % 2 == 0).withColumn("o_orderstatus", F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus")))
    return destination, source


def _merge_sql(destination: str, source: str, key: list[str], columns: list[str], differs: str, match: str, new: dict[str, str] | None = None) -> str:
    """Update, delete matched, insert: three phases, written apart from the one-join form."""
    value = lambda c: (new or {}).get(c, f"s.{c}")
    rest = f"timestamp '{STAMP}' as _timestamp"
    return f"""with d as ({destination}), s as ({source}),
        updated as (select {", ".join(f"{value(c)} as {c}" for c in columns)}, {rest} from d join s on {match} where {differs}),
        kept as (select d.* from d where not exists (select 1 from s where {match} and {differs})),
        inserted as (select {", ".join(f"{value(c)} as {c}" for c in columns)}, {rest} from s where not exists (select 1 from d where {match}))
        select {", ".join(columns)}, _timestamp from updated union all select {", ".join(columns)}, _timestamp from kept union all select {", ".join(columns)}, _timestamp from inserted"""


_DISTINCT = "(" + " or ".join(f"d.{c} is distinct from s.{c}" for c in ORDERS) + ")"


@query(_merge_sql(_DEST, _SRC, ["o_orderkey"], ORDERS, _DISTINCT, "d.o_orderkey = s.o_orderkey"))
def incremental_upsert_distinct(spark: SparkSession, sf: str) -> DataFrame:
    destination, source = _slices(spark, sf)
    return X.upsert(destination, X.dedup(source, ["o_orderkey"]), ["o_orderkey"], timestamp=_stamp())


@query(ORACLE["incremental_upsert_distinct"])
def incremental_upsert_small_source(spark: SparkSession, sf: str) -> DataFrame:
    """The same merge in the form that does not shuffle the destination; the source's estimated size decides whether it is taken."""
    destination, source = _slices(spark, sf)
    return X.upsert(destination, X.dedup(source, ["o_orderkey"]), ["o_orderkey"], timestamp=_stamp(), small_source=True)


_LKEY = ["l_orderkey", "l_linenumber"]
_LALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINES[2:]]
_LDEST = f"select *, timestamp '2021-01-01 00:00:00' as _timestamp from ({_first_sql(_LKEY, LINES)}) where l_orderkey % 3 <> 0"
_LSRC = f"select * replace (case when l_orderkey % 4 = 0 then l_quantity + 1 else l_quantity end as l_quantity) from ({_first_sql(_LKEY, LINES)}) where l_orderkey % 2 = 0"


@query(_merge_sql(_LDEST, _LSRC, _LKEY, _LALL, "(" + " or ".join(f"d.{c} is distinct from s.{c}" for c in _LALL) + ")", "d.l_orderkey = s.l_orderkey and d.l_linenumber = s.l_linenumber"))
def incremental_upsert_multi_pk(spark: SparkSession, sf: str) -> DataFrame:
    lines, k = X.dedup(read_table(spark, sf, "lineitem"), _LKEY), F.col("l_orderkey")
    destination = lines.where(k % 3 != 0).withColumn("_timestamp", F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"))
    source = lines.where(k % 2 == 0).withColumn("l_quantity", F.when(k % 4 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return X.upsert(destination, source, _LKEY, timestamp=_stamp())


_SDEST = "select cast(o_orderkey as varchar) as k, case when o_orderkey % 5 = 0 then null else o_orderstatus end as v, o_orderpriority as w, timestamp '2021-01-01 00:00:00' as _timestamp from orders where o_orderkey % 3 <> 0"
_SSRC = "select cast(o_orderkey as varchar) as k, case when o_orderkey % 10 = 0 then '' when o_orderkey % 4 = 0 then 'X' when o_orderkey % 22 = 0 then null else o_orderstatus end as v, o_orderpriority as w from orders where o_orderkey % 2 = 0"


def _string_slices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    destination = orders.where(k % 3 != 0).select(k.cast("string").alias("k"), F.when(k % 5 != 0, F.col("o_orderstatus")).alias("v"), F.col("o_orderpriority").alias("w"), F.lit("2021-01-01 00:00:00").cast("timestamp_ntz").alias("_timestamp"))
    value = F.when(k % 10 == 0, "").when(k % 4 == 0, "X").when(k % 22 != 0, F.col("o_orderstatus"))
    source = orders.where(k % 2 == 0).select(k.cast("string").alias("k"), value.alias("v"), F.col("o_orderpriority").alias("w"))
    return destination, source


_SMATCH = "d.k = coalesce(s.k, '')"
_SNEW = {c: f"coalesce(s.{c}, '')" for c in "kvw"}


@query(_merge_sql(_SDEST, _SSRC, ["k"], ["k", "v", "w"], "(" + " or ".join(f"coalesce(d.{c}, '') <> coalesce(s.{c}, '')" for c in "kvw") + ")", _SMATCH, _SNEW))
def incremental_upsert_empty_eq_null(spark: SparkSession, sf: str) -> DataFrame:
    destination, source = _string_slices(spark, sf)
    return X.upsert(destination, X.normalised(source, ImportOptions()), ["k"], MatchPolicy.SOURCE_EMPTY, ChangePolicy.EMPTY_EQ_NULL, _stamp())


@query(_merge_sql(_SDEST, _SSRC, ["k"], ["k", "v", "w"], "coalesce(" + " or ".join(f"coalesce(d.{c} <> coalesce(s.{c}, ''), false)" for c in "kvw") + ", false)", _SMATCH, _SNEW))
def incremental_upsert_string_ne(spark: SparkSession, sf: str) -> DataFrame:
    destination, source = _string_slices(spark, sf)
    return X.upsert(destination, X.normalised(source, ImportOptions()), ["k"], MatchPolicy.SOURCE_EMPTY, ChangePolicy.STRING_NE, _stamp())


@query(_merge_sql("select o_orderkey as k, o_orderstatus as v, timestamp '2021-01-01 00:00:00' as _timestamp from orders where o_orderkey % 3 <> 0", "select cast(o_orderkey as varchar) as k, case when o_orderkey % 4 = 0 then 'X' else o_orderstatus end as v from orders where o_orderkey % 2 = 0", ["k"], ["k", "v"], "(cast(d.k as varchar) <> coalesce(s.k, '') or d.v <> coalesce(s.v, ''))", "cast(d.k as varchar) = coalesce(s.k, '')", {"k": "cast(s.k as bigint)"}))
def incremental_upsert_typed_destination(spark: SparkSession, sf: str) -> DataFrame:
    """String staging into a typed key: keys match as text and are cast on the way in."""
    orders, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    destination = orders.where(k % 3 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("v"), F.lit("2021-01-01 00:00:00").cast("timestamp_ntz").alias("_timestamp"))
    source = orders.where(k % 2 == 0).select(k.cast("string").alias("k"), F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return X.upsert(destination, source, ["k"], MatchPolicy.SOURCE_EMPTY_AS_TEXT, ChangePolicy.STRING_NE, _stamp())


@query("select * from events where event_id % 2 = 0 union all select * from events where event_id % 2 <> 0 union all select * from events where event_id % 10 = 0")
def incremental_append_no_pk(spark: SparkSession, sf: str) -> DataFrame:
    events, k = read_table(spark, sf, "events"), F.col("event_id")
    return events.where(k % 2 == 0).unionByName(X.aligned(events.where((k % 2 != 0)), events.schema)).unionByName(events.where(k % 10 == 0))


@query("select o_orderkey, o_orderstatus, o_orderdate as _timestamp from orders")
def incremental_timestamp_from_source(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").alias("_timestamp"))
    return X.with_timestamp(df, ImportOptions(timestamp_mode=TimestampMode.FROM_SOURCE), STAMP)


@query(f"with d as ({_DEST}), s as ({_SRC}) select s.* from s where not exists (select 1 from d where d.o_orderkey = s.o_orderkey)")
def staging_delete_matched(spark: SparkSession, sf: str) -> DataFrame:
    destination, source = _slices(spark, sf)
    return X.delete_matched(source, destination, ["o_orderkey"])


@query(f"with d as ({_DEST}), s as ({_SRC}) select s.* from d join s on d.o_orderkey = s.o_orderkey where {_DISTINCT}")
def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    destination, source = _slices(spark, sf)
    return X.update_candidates(destination, source, ["o_orderkey"], MatchPolicy.EXACT, ChangePolicy.DISTINCT)


@query(f"with d as ({_DEST}), s as ({_SRC}) select s.* from d join s on d.o_orderkey = s.o_orderkey where not {_DISTINCT}")
def unchanged_rows(spark: SparkSession, sf: str) -> DataFrame:
    destination, source = _slices(spark, sf)
    return X.update_candidates(destination, source, ["o_orderkey"], MatchPolicy.EXACT, ChangePolicy.DISTINCT, False)


@query("select count(*) as n from (select l_orderkey, l_linenumber from lineitem group by 1, 2)")
def unique_pk_count(spark: SparkSession, sf: str) -> DataFrame:
    return X.unique_keys(read_table(spark, sf, "lineitem"), _LKEY).agg(F.count("*").alias("n"))


@query("select count(*) as n from lineitem")
def row_count(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


# --- projections ---


@query("select event_id, coalesce(case when event_id % 3 = 0 then null else props end, '') as props from events")
def null_to_empty(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"))
    return X.normalised(df, ImportOptions())


@query("select event_id, nullif(case when event_id % 3 = 0 then '' else props end, '') as props from events")
def empty_to_null(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("props")).alias("props"))
    return X.normalised(df, ImportOptions(convert_empty_to_null=("props",)))


@query("select event_id, case when event_type in ('click', 'view') then null else event_type end as event_type from events")
def null_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", E.tokens_to_null(F.col("event_type"), ["click", "view"]).alias("event_type"))


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def string_cast_table(spark: SparkSession, sf: str) -> DataFrame:
    return X.as_strings(read_table(spark, sf, "nation"))


@query("select cast(p_partkey as varchar) as p_partkey, p_name, p_brand, p_type, cast(p_size as varchar) as p_size from part")
def string_cast_projection(spark: SparkSession, sf: str) -> DataFrame:
    return X.as_strings(read_table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


def _typed() -> TableDef:
    t = lambda name, kind, length=None: ColumnDef(name, TypeDef("bigquery", kind, length))
    return TableDef("typed", (t("k", "INT64"), t("price", "NUMERIC", "12,2"), t("day", "DATE"), t("note", "STRING")))


@query("select o_orderkey as k, cast(round(o_totalprice, 2) as decimal(12, 2)) as price, cast(o_orderdate as date) as day, o_orderpriority as note from orders")
def typed_cast_from_string(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "orders")
    text = df.select(F.col("o_orderkey").cast("string").alias("k"), F.round("o_totalprice", 2).cast("decimal(12,2)").cast("string").alias("price"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderpriority").alias("note"))
    return X.normalised(text, ImportOptions(), _typed())


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def variant_from_json(spark: SparkSession, sf: str) -> DataFrame:
    df = read_table(spark, sf, "events").select("event_id", E.as_object(F.col("props")).alias("v"))
    return df.select("event_id", F.variant_get("v", "$.k", "bigint").alias("k"))


@query("select vec_id, len(embedding) as dim, label from embeddings")
def vector_size_check(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors pass through their text form, and each has the declared size."""
    df = read_table(spark, sf, "embeddings")
    dim = F.size("embedding").cast("long")
    parsed = df.select("vec_id", dim.alias("dim"), "label", E.as_vector(F.to_json("embedding"), VECTOR_SIZE).alias("v"))
    return parsed.select("vec_id", F.size("v").cast("long").alias("dim"), "label")


@query("select event_id, string_split(event_type, 'i') as parts from events")
def array_from_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.to_json(F.split("event_type", "i"))
    return read_table(spark, sf, "events").select("event_id", F.transform(E.as_array(text), lambda x: x.cast("string")).alias("parts"))


@query("select o_custkey as a, o_orderkey as b, o_orderstatus as c from orders")
def column_map_by_order(spark: SparkSession, sf: str) -> DataFrame:
    source = ["o_custkey", "o_orderkey", "o_orderstatus"]
    mapping = checks.column_map(source, ["a", "b", "c"], by_order=True)
    return read_table(spark, sf, "orders").select(*[F.col(k).alias(v) for k, v in mapping.items()])


@query("select o_orderstatus, o_orderkey from orders")
def column_map_by_name(spark: SparkSession, sf: str) -> DataFrame:
    mapping = checks.column_map(["o_orderstatus", "o_orderkey"], ORDERS)
    return read_table(spark, sf, "orders").select(*[F.col(k).alias(v) for k, v in mapping.items()])


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000.0")
def select_source_bindings(spark: SparkSession, sf: str) -> DataFrame:
    source = QuerySource("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least", {"status": "F", "least": 100000.0}, views={"orders": read_table(spark, sf, "orders")})
    return source.read(spark)


@query("select o_orderkey, 'NOT_NULL: column s' as broken from orders where o_orderkey % 6 = 0 union all select o_orderkey, 'EXCEED_LIMIT_LENGTH: column p' from orders where o_orderkey % 6 <> 0 and length(o_orderpriority) > 6")
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    definition = TableDef("t", (ColumnDef("s", TypeDef("snowflake", "VARCHAR", "1", False)), ColumnDef("p", TypeDef("snowflake", "VARCHAR", "6"))))
    df = read_table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("s"), F.col("o_orderpriority").alias("p"))
    return df.select("o_orderkey", checks.violations(definition, df.columns).alias("broken")).where("broken is not null")


@query("""select o_orderkey || ',"' || o_orderstatus || '",' || case when o_orderkey % 3 = 0 then '' when o_orderkey % 5 = 0 then '""' else '"' || replace(o_orderpriority, '"', '""') || '"' end as value from orders""")
def export_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    df = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(k % 5 == 0, F.when(k % 3 != 0, "")).when(k % 3 != 0, F.col("o_orderpriority")).alias("p"))
    return csv_lines(df, ExportOptions())


@query("select l_returnflag as f, count(*) as n from lineitem group by 1")
def export_slice_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each slice, a slice here being a value: the same partial sums that an export's report runs by file."""
    return read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"))


# --- through the engine: files, staging, stored tables, exports ---


def _home(spark: SparkSession) -> str:
    """A fresh folder under the warehouse, which all machines share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/millrace_queries/{uuid.uuid4().hex}"


def _store(spark: SparkSession, *definitions: TableDef) -> TableStore:
    store = TableStore(spark, _home(spark), "millrace_queries")
    for definition in definitions:
        if store.exists(definition.name):
            store.drop(definition.name)
        store.create(definition)
    return store


def _varchar(*names: str) -> tuple[ColumnDef, ...]:
    return tuple(ColumnDef(n, TypeDef("snowflake", "VARCHAR")) for n in names)


def _options(**more) -> ImportOptions:
    return ImportOptions(import_time=datetime.fromisoformat(STAMP), **more)


_TEXTS = "select cast(o_orderkey as varchar) as k, case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then '' when o_orderkey % 11 = 0 then 'a \"b\"\n' || o_orderpriority else o_orderpriority end as v, o_orderstatus as w from orders"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, None).when(k % 7 == 0, "").when(k % 11 == 0, F.concat(F.lit('a "b"\n'), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return read_table(spark, sf, "orders").select(k.cast("string").alias("k"), value.alias("v"), F.col("o_orderstatus").alias("w"))


@query(f"select k, coalesce(v, '') as v, w from ({_TEXTS})")
def engine_export_and_file_load(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with quotes, line breaks, nulls and empty texts: out as CSV slices with a manifest, back in by the manifest, into a stored table."""
    store = _store(spark, TableDef("from_files", _varchar("k", "v", "w")))
    folder = _home(spark)
    export(_texts(spark, sf), folder, ExportOptions(compressed=True))
    Loader(store).load(FileSource(folder + "manifest", ("k", "v", "w"), sliced=True), "from_files", _options())
    return store.read("from_files")


@query("select count(*) as n from orders")
def engine_export_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by the export's own report, over all slices."""
    report = export(_texts(spark, sf), _home(spark), ExportOptions())
    return spark.createDataFrame([(sum(int(r["ROW_COUNT"]) for r in report),)], "n long")


@query(f"select * exclude (rn), timestamp '{STAMP}' as _timestamp from (select k, v, w, row_number() over (partition by w order by k, v) as rn from (select k, coalesce(v, '') as v, w from ({_TEXTS}))) where rn = 1")
def engine_full_load(spark: SparkSession, sf: str) -> DataFrame:
    """A full load with dedup by key through staging and a commit."""
    store = _store(spark, TableDef("full_keyed", (*_varchar("k", "v", "w"), ColumnDef.timestamp()), ("w",)))
    Loader(store).load(FrameSource(_texts(spark, sf)), "full_keyed", _options())
    return store.read("full_keyed")


@query(f"""with a as (select k, coalesce(v, '') as v, w from ({_TEXTS}) where cast(k as bigint) % 3 <> 0), s as (select k, case when cast(k as bigint) % 4 = 0 then 'X' else coalesce(v, '') end as v, w from ({_TEXTS}) where cast(k as bigint) % 2 = 0)
    select coalesce(s.k, a.k) as k, coalesce(s.v, a.v) as v, coalesce(s.w, a.w) as w, case when a.k is null or s.v <> a.v then timestamp '{STAMP}' else timestamp '2021-01-01 00:00:00' end as _timestamp from a full outer join s on a.k = s.k""")
def engine_incremental_load(spark: SparkSession, sf: str) -> DataFrame:
    """A full load and then an incremental one: changed and new rows get the new time, unchanged rows keep theirs."""
    store = _store(spark, TableDef("incremental", (*_varchar("k", "v", "w"), ColumnDef.timestamp()), ("k",)))
    rows, k = _texts(spark, sf), F.col("k").cast("long")
    Loader(store).load(FrameSource(rows.where(k % 3 != 0)), "incremental", ImportOptions(import_time=datetime(2021, 1, 1)))
    changed = rows.where(k % 2 == 0).withColumn("v", F.when(k % 4 == 0, "X").otherwise(F.col("v")))
    Loader(store).load(FrameSource(changed), "incremental", _options(incremental=True))
    return store.read("incremental")


@query(f"select k, coalesce(v, '') as v, w, timestamp '{STAMP}' as _timestamp from ({_TEXTS}) union all select k, coalesce(v, '') as v, w, timestamp '{STAMP}' as _timestamp from ({_TEXTS}) where w = 'F'")
def engine_append_load(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental loads without a key add rows."""
    store = _store(spark, TableDef("appended", (*_varchar("k", "v", "w"), ColumnDef.timestamp())))
    rows = _texts(spark, sf)
    Loader(store).load(FrameSource(rows), "appended", _options(incremental=True))
    Loader(store).load(FrameSource(rows.where("w = 'F'")), "appended", _options(incremental=True))
    return store.read("appended")


@query(f"select k, v, w, timestamp '{STAMP}' as _timestamp from ({_TEXTS})")
def engine_create_as_select(spark: SparkSession, sf: str) -> DataFrame:
    """A load that replaces the table as it is: no dedup, nulls stay."""
    store = _store(spark, TableDef("as_select", (*_varchar("k", "v", "w"), ColumnDef.timestamp())))
    Loader(store).load(FrameSource(_texts(spark, sf)), "as_select", _options(), create_as_select=True)
    return store.read("as_select")


_LOOSE = "select case when o_orderkey % 50 = 0 then 'x' || cast(o_orderkey as varchar) when o_orderkey % 70 = 0 then null else cast(o_orderkey as varchar) end as id, case when o_orderkey % 30 = 0 then o_orderstatus || '1' else o_orderstatus end as st, case when o_orderkey % 40 = 0 then 'n/a' else cast(o_custkey as varchar) end as cust from orders"


def _strict(name: str) -> TableDef:
    return TableDef(name, (ColumnDef("id", TypeDef("snowflake", "INTEGER", None, False)), ColumnDef("st", TypeDef("snowflake", "VARCHAR", "1")), ColumnDef("cust", TypeDef("snowflake", "INTEGER"))))


@query(f"""select 'id' as "column", case when id is null then 'NOT_NULL' else 'VALUE_CONVERSION' end as problem, id as "value" from ({_LOOSE}) where try_cast(id as bigint) is null
    union all select 'st', 'EXCEED_LIMIT_LENGTH', st from ({_LOOSE}) where length(st) > 1
    union all select 'cust', 'VALUE_CONVERSION', cust from ({_LOOSE}) where try_cast(cust as bigint) is null""")
def bad_row_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every value that a typed table would not take."""
    k, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    key = F.when(k % 50 == 0, F.concat(F.lit("x"), text)).when(k % 70 == 0, None).otherwise(text)
    status = F.when(k % 30 == 0, F.concat("o_orderstatus", F.lit("1"))).otherwise(F.col("o_orderstatus"))
    customer = F.when(k % 40 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return checks.bad_rows(read_table(spark, sf, "orders").select(key.alias("id"), status.alias("st"), customer.alias("cust")), _strict("strict"))


@query("select o_orderkey as id, o_orderstatus as st, o_custkey as cust from orders")
def engine_load_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """A typed load from a stored table with other names, column by column, after a check of its types and lengths."""
    given = TableDef("given", tuple(ColumnDef(f"c{i}", c.type) for i, c in enumerate(_strict("given").columns)))
    store = _store(spark, given, _strict("by_position"))
    orders = read_table(spark, sf, "orders")
    store.commit("given", orders.select(F.col("o_orderkey").alias("c0"), F.col("o_orderstatus").alias("c1"), F.col("o_custkey").alias("c2")), 0)
    Loader(store).load(TableSource("given", schema=store.schema, by_position=True), "by_position", ImportOptions(type_mode=TypeMode.USER))
    return store.read("by_position")
