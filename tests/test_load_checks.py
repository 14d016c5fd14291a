from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.types import TypeDef
from millrace.model import ColumnDef, ImportOptions, TableDef, TypeMode
from millrace.operators import checks
from millrace.operators import transforms as X
from millrace.plans import retry
from millrace.plans.errors import ColumnsMismatch, NotNullViolation, RowTooLarge, ValueConversion
from millrace.plans.loads import Loader
from millrace.plans.store import TableStore
from millrace.sources.tables import FrameSource, QuerySource, TableSource

TYPED = ImportOptions(type_mode=TypeMode.USER)


def snow(name, type_name, length=None, nullable=True):
    return ColumnDef(name, TypeDef("snowflake", type_name, length, nullable))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    name = f"c{abs(hash(str(tmp_path)))}"
    yield TableStore(spark, str(tmp_path / "tables"), name)
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")


def test_transient_errors():
    for text in ("Status Code: 503, slow", "HTTP 429", '{"reason": "rateLimitExceeded"}', "java.net.SocketTimeoutException: read"):
        assert retry.transient(RuntimeError(text))
    for text in ("Status Code: 404", "row 503 is bad", "no such table", "Status Code: 401"):
        assert not retry.transient(RuntimeError(text))
    assert retry.transient(RuntimeError("Status Code: 401"), include_unauthorized=True)


def test_retries(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(retry.time, "sleep", waits.append)

    def action(failures, text):
        calls.append(1)
        if len(calls) <= failures:
            raise RuntimeError(text)
        return "done"

    assert retry.Retries(5, 1, 3).call(lambda: action(4, "HTTP 500")) == "done"
    assert waits == [1, 2, 3, 3]
    calls.clear()
    with pytest.raises(RuntimeError):
        retry.Retries(3, 1, 3).call(lambda: action(9, "HTTP 500"))
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(RuntimeError):
        retry.Retries(3, 1, 3).call(lambda: action(9, "no such table"))
    assert len(calls) == 1
    with pytest.raises(ValueError):
        retry.Retries(0).call(lambda: 1)


def test_lengths_and_types_of_stored_sources(spark, store):
    store.create(TableDef("to", (snow("a", "VARCHAR", "10"), snow("n", "NUMBER", "10,2"))))
    for k, (a, n, fits) in enumerate([("VARCHAR", "NUMBER", ("5", "10,1")), ("VARCHAR", "NUMBER", ("11", "10,2")), ("VARCHAR", "NUMBER", ("10", "10,3")), ("CHAR", "NUMBER", ("10", "10,2"))]):
        store.create(TableDef(f"from{k}", (snow("a", a, fits[0]), snow("n", n, fits[1]))))
    loader = Loader(store)
    loader.load(TableSource("from0", schema=store.schema), "to", TYPED)
    for k in (1, 2, 3):
        with pytest.raises(ColumnsMismatch):
            loader.load(TableSource(f"from{k}", schema=store.schema), "to", TYPED)
    # Other types and lengths are no matter where all is text.
    loader.load(TableSource("from1", schema=store.schema, cast_to_string=True), "to")
    assert checks.load_rule(ColumnDef("x", TypeDef("bigquery", "STRING", "5"))) == checks.MINIMAL
    assert checks.load_rule(snow("x", "INTEGER")) == checks.STRICT


def test_by_position(spark, store):
    store.create(TableDef("t", (snow("a", "VARCHAR"), snow("b", "VARCHAR"), ColumnDef.timestamp())))
    loader, now = Loader(store), datetime(2022, 2, 2)
    loader.load(QuerySource("SELECT 'x' AS b, 'y' AS b", by_position=True), "t", ImportOptions(import_time=now))
    assert rows(store.read("t")) == [("x", "y", now)]
    loader.load(QuerySource("SELECT 'x' AS b, 'y' AS a"), "t", ImportOptions(import_time=now))
    assert rows(store.read("t")) == [("y", "x", now)]
    with pytest.raises(ColumnsMismatch):
        loader.load(QuerySource("SELECT 'x' AS a", by_position=True), "t")


def test_failed_loads_tell_their_rows(spark, store):
    store.create(TableDef("t", (snow("k", "INTEGER", None, False), snow("v", "VARCHAR", "3")), ("k",)))
    loader = Loader(store)
    frame = lambda *data: FrameSource(spark.createDataFrame(list(data), "k string, v string"))
    with pytest.raises(ValueConversion) as e:
        loader.load(frame(("1", "a"), ("x", "a"), ("2", "a"), ("y", "a")), "t", TYPED)
    assert sorted(e.value.rows) == ["VALUE_CONVERSION: column k: x", "VALUE_CONVERSION: column k: y"]
    assert "column k: y" in str(e.value)
    with pytest.raises(RowTooLarge) as e:
        loader.load(frame(*[(str(n), "long") for n in range(30)]), "t", TYPED)
    assert len(e.value.rows) == 10 and "there are more" in str(e.value)
    with pytest.raises(NotNullViolation) as e:
        loader.load(frame((None, "a")), "t", TYPED)
    assert e.value.rows == ("NOT_NULL: column k",)


def test_bad_rows_without_any(spark):
    definition = TableDef("t", (snow("k", "INTEGER"), snow("o", "OBJECT")))
    assert checks.bad_rows(spark.createDataFrame([(None, "{"), ("1", None)], "k string, o string"), definition).count() == 0
    assert checks.bad_rows(spark.createDataFrame([(1,)], "other int"), definition).count() == 0
    assert checks.bad_rows(spark.createDataFrame([], "k string, o string"), definition).count() == 0


def test_broadcast_only_below_the_limit(spark, monkeypatch):
    destination = spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], "id int, v string")
    source = spark.createDataFrame([(1, "A"), (None, "N"), (3, "c")], "id int, v string")
    merge = lambda: X.upsert(destination, source, ["id"], small_source=True)
    shuffled = lambda df: "FullOuter" in df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(X, "BROADCAST_BYTES", 1 << 70)
    small = merge()
    monkeypatch.setattr(X, "BROADCAST_BYTES", 0)
    large = merge()
    assert (shuffled(small), shuffled(large)) == (False, True)
    assert rows(small) == rows(large) == rows(X.upsert(destination, source, ["id"]))
    assert X.estimated_bytes(spark.range(10).select(F.col("id"))) == 80
