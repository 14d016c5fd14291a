import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions.types import TypeDef
from millrace.model import ColumnDef, ExportOptions, ImportOptions, TableDef, TimestampMode, TypeMode
from millrace.plans import catalog as C
from millrace.plans.errors import ColumnsMismatch, FileNotFound, MalformedInput, NotNullViolation, RowTooLarge, ValueConversion
from millrace.plans.loads import Loader
from millrace.plans.store import ConcurrentCommit, TableStore
from millrace.plans.tags import check_tag, tagged
from millrace.sources import export as X
from millrace.sources import paths
from millrace.sources.files import CsvFormat, FileSource
from millrace.sources.tables import FrameSource, QuerySource, TableSource
from millrace.streaming.incremental import load_stream

NOW = datetime(2022, 2, 2)


def text(name, length=None):
    return ColumnDef(name, TypeDef("snowflake", "VARCHAR", length))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    name = f"s{abs(hash(str(tmp_path)))}"
    yield TableStore(spark, str(tmp_path / "tables"), name)
    spark.sql(f"DROP SCHEMA IF EXISTS {name} CASCADE")


def write(path, body):
    path.write_text(body, encoding="utf-8", newline="")
    return str(path)


# --- files ---


def test_csv_enclosures_and_null_tokens(spark, tmp_path):
    body = 'col1,col2\nplain,"a ""quoted"" one"\n"two\nlines",ščř\n,""\n"trailing \\",\x00nul\n'
    source = FileSource(write(tmp_path / "a.csv", body), ("c1", "c2"))
    got = rows(source.read(spark, ImportOptions(skip_lines=1)))
    assert got == sorted([("plain", 'a "quoted" one'), ("two\nlines", "ščř"), (None, None), ("trailing \\", "\x00nul")], key=str)
    keep = rows(source.read(spark, ImportOptions(skip_lines=1, import_as_null=())))
    assert ("", "") in keep
    one = FileSource(write(tmp_path / "b.csv", "1,2,3\n"), ("a", "b", "c"))
    assert rows(one.read(spark, ImportOptions(import_as_null=("3", "2")))) == [("1", None, None)]
    assert rows(one.read(spark, ImportOptions(import_as_null=("3", "2"), only_first_null_token=True))) == [("1", "2", None)]


def test_csv_lines_skipped_in_each_file(spark, tmp_path):
    for k in range(3):
        write(tmp_path / f"s{k}", f'first\n"a","b"\n{k},"x\ny"\n')
    manifest = write(tmp_path / "m", json.dumps({"entries": [{"url": str(tmp_path / f"s{k}"), "mandatory": True} for k in range(3)]}))
    source = FileSource(manifest, ("a", "b"), sliced=True)
    assert rows(source.read(spark, ImportOptions(skip_lines=2))) == [(str(k), "x\ny") for k in range(3)]
    with pytest.raises(ValueError, match="sliced"):
        source.file_name()


def test_manifests(spark, tmp_path):
    assert FileSource(write(tmp_path / "e", '{"entries": []}'), ("a",), sliced=True).read(spark).count() == 0
    with pytest.raises(FileNotFound):
        FileSource(str(tmp_path / "none"), ("a",), sliced=True).read(spark)
    with pytest.raises(MalformedInput):
        FileSource(write(tmp_path / "w", "[1"), ("a",), sliced=True).read(spark)


def test_escaped_fields_gzip_and_folders(spark, tmp_path):
    source = FileSource(write(tmp_path / "raw", "a\\\tb\tc\\\\\nd\\\\\\\te\tf\n"), ("x", "y"), format=CsvFormat("\t", "", "\\"))
    assert rows(source.read(spark)) == [("a\tb", "c\\"), ("d\\\te", "f")]
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("1,2\r\n3,4\r\n")
    assert rows(FileSource(str(tmp_path / "z.csv.gz"), ("a", "b")).read(spark)) == [("1", "2"), ("3", "4")]
    (tmp_path / "d" / "sub").mkdir(parents=True)
    write(tmp_path / "d" / "1", "1\n"), write(tmp_path / "d" / "sub" / "2", "2\n")
    assert rows(FileSource(str(tmp_path / "d"), ("a",), directory=True).read(spark)) == [("1",), ("2",)]
    with pytest.raises(ValueError, match="exclude"):
        CsvFormat(",", '"', "\\")


def test_malformed_rows(spark, tmp_path, store):
    store.create(TableDef("t", (text("a"), text("b"))))
    for body in ("1,2,3\n", "1\n"):
        with pytest.raises(MalformedInput):
            Loader(store).load(FileSource(write(tmp_path / "bad.csv", body), ("a", "b")), "t")


def test_addresses():
    assert paths.normalised("s3://b/k") == "s3a://b/k"
    assert paths.normalised("azure://acc.blob.core.windows.net/box/a/b") == "abfss://box@acc.dfs.core.windows.net/a/b"
    assert paths.file_name("s3://b/x/y.csv") == "y.csv" and paths.prefix("s3://b/x/y.csv") == "s3://b/x/"


# --- load modes ---


def test_full_load_with_key(spark, store, tmp_path):
    store.create(TableDef("multi", (text("VisitID"), text("Value"), text("Something"), ColumnDef.timestamp()), ("VisitID",)))
    body = "VisitID,Value,Something\n1,a,x\n1,b,x\n,c,y\n\"\",d,z\n2,,q\n"
    state = Loader(store).load(FileSource(write(tmp_path / "m.csv", body), ("VisitID", "Value", "Something")), "multi", ImportOptions(skip_lines=1, import_time=NOW))
    assert rows(store.read("multi")) == [("", "c", "y", NOW), ("1", "a", "x", NOW), ("2", "", "q", NOW)]
    assert state.imported_rows == 5 and state.imported_columns == ["VisitID", "Value", "Something"]
    assert state.timers[0]["name"] == "fromStagingToTargetWithDedup"
    assert store.vacuum("multi") == 1 and store.read("multi").count() == 3


def test_incremental_load(spark, store):
    store.create(TableDef("acc", (text("id"), text("name"), ColumnDef.timestamp()), ("id",)))
    loader = Loader(store)
    frame = lambda *data: FrameSource(spark.createDataFrame(list(data), "id string, name string"))
    old = datetime(2021, 1, 1)
    loader.load(frame(("15", "a"), ("18", "b"), ("60", "c")), "acc", ImportOptions(import_time=old))
    options = ImportOptions(incremental=True, import_time=NOW)
    state = loader.load(frame(("15", "A"), ("18", "B"), ("18", "B2"), ("24", None), ("60", "c")), "acc", options)
    assert state.imported_rows == 4
    assert rows(store.read("acc")) == [("15", "A", NOW), ("18", "B", NOW), ("24", "", NOW), ("60", "c", old)]
    before = rows(store.read("acc"))
    loader.load(FrameSource(store.read("acc").drop("_timestamp")), "acc", ImportOptions(incremental=True))
    assert rows(store.read("acc")) == before


def test_append_create_as_select_and_source_timestamp(spark, store):
    store.create(TableDef("t", (text("a", "5"), ColumnDef.timestamp())))
    loader, frame = Loader(store), spark.createDataFrame([("x",), ("x",)], "a string")
    loader.load(FrameSource(frame), "t", ImportOptions(incremental=True, import_time=NOW))
    loader.load(FrameSource(frame), "t", ImportOptions(incremental=True, import_time=NOW))
    assert store.read("t").count() == 4
    loader.load(FrameSource(frame), "t", ImportOptions(import_time=NOW), create_as_select=True)
    assert rows(store.read("t")) == [("x", NOW)] * 2
    with pytest.raises(ColumnsMismatch):
        loader.load(FrameSource(spark.createDataFrame([(1,)], "b int")), "t", create_as_select=True)
    stamped = frame.withColumn("_timestamp", F.lit("2020-05-05").cast("timestamp_ntz"))
    loader.load(FrameSource(stamped), "t", ImportOptions(timestamp_mode=TimestampMode.FROM_SOURCE))
    assert rows(store.read("t"))[0][1] == datetime(2020, 5, 5)


def test_failed_loads_leave_the_table(spark, store):
    store.create(TableDef("t", (ColumnDef("k", TypeDef("snowflake", "INTEGER", None, False)), text("v", "3")), ("k",)))
    loader, typed = Loader(store), ImportOptions(type_mode=TypeMode.USER)
    frame = lambda *data: FrameSource(spark.createDataFrame(list(data), "k string, v string"))
    loader.load(frame(("1", "a")), "t", typed)
    for bad, error in ((("x", "a"), ValueConversion), ((None, "a"), NotNullViolation), (("2", "long"), RowTooLarge)):
        with pytest.raises(error):
            loader.load(frame(bad), "t", typed)
    with pytest.raises(ColumnsMismatch):
        loader.load(FrameSource(spark.createDataFrame([(1,)], "zzz int")), "t", typed)
    assert rows(store.read("t")) == [(1, "a")]
    with pytest.raises(ConcurrentCommit):
        store.commit("t", store.read("t"), 0)


def test_table_and_query_sources(spark, store):
    store.create(TableDef("t", (text("a"), text("b"))))
    store.commit("t", spark.createDataFrame([("1", "2")], "a string, b string"), 0)
    assert TableSource(store.name("t"), ("b",)).read(spark).columns == ["b"]
    assert rows(QuerySource(f"SELECT a FROM {store.name('t')} WHERE b = :b", {"b": "2"}).read(spark)) == [("1",)]
    assert rows(QuerySource("SELECT ? + 1 AS x", [41]).read(spark)) == [(42,)]


# --- export ---


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(True, "0"), (None, "1"), (False, ""), (None, None), (True, 'q"u\no,te')], "col boolean, str string")
    assert [r["value"] for r in X.csv_lines(df, ExportOptions()).collect()] == ['true,"0"', ',"1"', 'false,""', ",", 'true,"q""u\no,te"']
    for compressed in (False, True):
        where = str(tmp_path / f"out{compressed}")
        report = X.export(df, where, ExportOptions(compressed=compressed))
        assert sum(r["ROW_COUNT"] for r in report) == 5
        back = FileSource(where + "manifest", ("col", "str"), sliced=True).read(spark, ImportOptions(import_as_null=()))
        assert rows(back) == rows(df.select(F.coalesce(F.col("col").cast("string"), F.lit("")), F.coalesce("str", F.lit(""))))
    report = X.export(df, str(tmp_path / "p"), ExportOptions("parquet", True))
    assert rows(spark.read.parquet(str(tmp_path / "p"))) == rows(df) and sum(r["ROW_COUNT"] for r in report) == 5
    assert json.loads(open(X.manifest_from_folder(spark, str(tmp_path / "p"), str(tmp_path / "pm"))).read())["entries"]
    with pytest.raises(ValueError, match="time zone"):
        ExportOptions("parquet", timezone="UTC")
    zone = spark.sql("SELECT timestamp '2022-01-01 12:00:00' AS t")
    assert X.csv_lines(zone, ExportOptions(timezone="America/Los_Angeles")).first()[0] == '"2022-01-01 04:00:00"'


# --- catalog ---


def test_catalog(spark, store):
    definition = TableDef("t", (ColumnDef("n", TypeDef("snowflake", "NUMBER", "10,2")), text("v", "3")), ("v",))
    store.create(definition)
    store.commit("t", spark.createDataFrame([(1, "a")], "n int, v string"), 0)
    assert store.definition("t") == definition
    look = C.TableReflection(spark, store.schema, "t")
    assert look.exists() and not look.is_view() and look.primary_key() == ["v"] and look.row_count() == 1 and look.stats().rows == 1 and not look.is_temporary()
    spark.sql(f"CREATE VIEW {store.schema}.w AS SELECT v FROM {store.name('t')}")
    assert look.dependent_views() == ["w"] and C.list_views(spark, store.schema) == ["w"] and C.list_tables(spark, store.schema) == ["t"]
    C.refresh_view(spark, store.schema, "w")
    assert rows(spark.table(f"{store.schema}.w")) == [("a",)]
    assert C.alter_column(store, "t", "n", TypeDef("snowflake", "NUMBER", "12,2")) == ["SET DATA TYPE NUMBER(12, 2)"]
    C.add_column(store, "t", text("extra"))
    C.drop_column(store, "t", "n")
    assert store.read("t").columns == ["v", "extra"] and C.schema_definitions(spark, store.schema)["t"].names == ["v", "extra"]
    store.truncate("t")
    assert store.read("t").count() == 0


@pytest.mark.parametrize(("old", "new"), [("10,2", "10,3"), ("10,2", "9,2"), ("10,2", None)])
def test_forbidden_changes(old, new):
    with pytest.raises(C.AlterError):
        C.checked_change("c", TypeDef("snowflake", "NUMBER", old), TypeDef("snowflake", "NUMBER" if new else "VARCHAR", new))


def test_definitions_as_sql():
    table = TableDef("t", (ColumnDef.generic("a"), text('b"c', "3")), ("a",))
    assert C.create_table_sql(table, "s", "snowflake") == 'CREATE TABLE "s"."t"\n(\n"a" VARCHAR NOT NULL DEFAULT \'\',\n"b""c" VARCHAR(3),\nPRIMARY KEY ("a")\n);'
    change = C.alter_column_sql("s", "t", "a", TypeDef("snowflake", "VARCHAR", "3", False, "x"), TypeDef("snowflake", "VARCHAR", "5"))
    assert change == 'ALTER TABLE "s"."t" MODIFY COLUMN "a" DROP DEFAULT, COLUMN "a" DROP NOT NULL, COLUMN "a" SET DATA TYPE VARCHAR(5)'
    new = TypeDef("bigquery", "BOOL", None, True, "1")
    assert C.change_by_key_sql("s", "t", "a", new, ["nullable", "default"])["default"].endswith("SET DEFAULT TRUE;")
    for kind, default in (("BOOL", "maybe"), ("INT64", "x")):
        with pytest.raises(C.AlterError):
            C.default_sql("a", TypeDef("bigquery", kind, None, True, default))
    for wrong in (lambda: TableDef("a b", ()), lambda: TableDef("t", (), ("k",)), lambda: TableDef("x", (), temporary=True)):
        with pytest.raises(ValueError):
            wrong()


def test_tags(spark):
    with tagged(spark, branch_id="12-a_b"):
        assert spark.range(3).count() == 3
    for key, value in (("other", "a"), ("run_id", "UP"), ("run_id", "a" * 64), ("run_id", "a b")):
        with pytest.raises(ValueError):
            check_tag(key, value)


def test_stream_equals_batch(spark, store, tmp_path):
    store.create(TableDef("t", (ColumnDef("k", TypeDef("snowflake", "INTEGER")), text("v")), ("k",)))
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(folder)
    stream = spark.readStream.schema("k long, v string").parquet(folder)
    for k in range(2):
        load_stream(stream, Loader(store), "t", ImportOptions(incremental=True, type_mode=TypeMode.USER), str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string").write.mode("append").parquet(folder)
    assert rows(store.read("t")) == [(1, "a"), (2, "B"), (3, "c")]


# --- what must not get lost ---


def test_many_enclosed_rows_after_skipped_lines(spark, tmp_path):
    body = "title\nmore\n" + '"a","b"\n' + "".join(f'"{k}","x ""{k}""\ny"\n' for k in range(100_000))
    df = FileSource(write(tmp_path / "big.csv", body), ("a", "b")).read(spark, ImportOptions(skip_lines=3))
    assert df.count() == 100_000 and df.where("a = '99999'").first()["b"] == 'x "99999"\ny'


@pytest.mark.parametrize("enclosure", ['"', "'"])
def test_export_loses_no_row(spark, tmp_path, enclosure):
    df = spark.createDataFrame([("a",), (None,), (None,), ("",), ("b\nc",), ("it's",)], "v string").coalesce(1)
    report = X.export(df, str(tmp_path / "out"), ExportOptions(enclosure=enclosure))
    assert sum(r["ROW_COUNT"] for r in report) == 6
    back = FileSource(str(tmp_path / "outmanifest"), ("v",), format=CsvFormat(",", enclosure), sliced=True).read(spark, ImportOptions(import_as_null=()))
    assert rows(back) == sorted([("a",), ("",), ("",), ("",), ("b\nc",), ("it's",)], key=str)


def test_partitioned_table(spark, store):
    definition = TableDef("p", (text("v"), text("day")), ())
    store.create(definition, partition_by=("day",))
    frame = lambda *data: spark.createDataFrame(list(data), "v string, day string")
    Loader(store).load(FrameSource(frame(("1", "2020-01-01"), ("2", "2020/01 02"))), "p")
    assert rows(store.read("p")) == rows(spark.table(store.name("p"))) == [("1", "2020-01-01"), ("2", "2020/01 02")]
    Loader(store).load(FrameSource(frame(("3", "2020-01-03"))), "p", ImportOptions(incremental=True))
    assert spark.table(store.name("p")).count() == C.TableReflection(spark, store.schema, "p").row_count() == 3
    Loader(store).load(FrameSource(frame(("4", "2020-01-03"))), "p")
    assert rows(spark.table(store.name("p"))) == [("4", "2020-01-03")] and store.version("p") == 2
    with pytest.raises(ConcurrentCommit):
        store.append("p", frame(("5", "x")), read_version=1)
