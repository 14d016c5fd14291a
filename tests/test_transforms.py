from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import expressions as E
from millrace.functions.types import TypeDef
from millrace.model import ChangePolicy, ColumnDef, ImportOptions, MatchPolicy, TableDef, TimestampMode
from millrace.operators import checks
from millrace.operators import transforms as X
from millrace.plans.errors import ColumnsMismatch


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_dedup_is_repeatable_and_keeps_null_groups(spark):
    data = [(1, "Alice", "value1"), (2, "Bob", "value2"), (1, "Alice", "value1_duplicate"), (2, "Bob", None), (None, "x", "a"), (None, "x", "b")]
    df = spark.createDataFrame(data, "id int, name string, v string")
    expected = [(1, "Alice", "value1"), (2, "Bob", None), (None, "x", "a")]
    assert rows(X.dedup(df, ["id", "name"])) == sorted(expected, key=str)
    assert rows(X.dedup(df.repartition(5).orderBy(F.desc("v")), ["id", "name"])) == sorted(expected, key=str)
    assert rows(X.dedup(X.dedup(df, ["id"]), ["id"])) == rows(X.dedup(df, ["id"]))
    assert X.dedup(df, []).count() == 6
    assert X.dedup(df.where("false"), ["id"]).count() == 0
    assert X.unique_keys(df, ["id"]).count() == 3


def test_timestamp_on_change(spark):
    old, now = datetime(2021, 1, 1), datetime(2022, 2, 2)
    destination = spark.createDataFrame([(1, "test", 100, 0, old), (2, "test2", 200, 0, old), (3, "test3", 300, 0, old)], "id int, name string, price int, isDeleted int, _timestamp timestamp_ntz")
    source = spark.createDataFrame([(1, "change", 100, 0), (3, "test3", 300, 0), (4, "test4", 400, 0)], "id int, name string, price int, isDeleted int")
    expected = [(1, "change", 100, 0, now), (2, "test2", 200, 0, old), (3, "test3", 300, 0, old), (4, "test4", 400, 0, now)]
    for small in (False, True):
        merged = X.upsert(destination, source, ["id"], timestamp=F.lit("2022-02-02").cast("timestamp_ntz"), small_source=small)
        assert rows(merged) == expected
        again = X.upsert(merged, source, ["id"], timestamp=F.lit("2023-01-01").cast("timestamp_ntz"))
        assert rows(again) == expected  # nothing changed, so nothing is touched


@pytest.mark.parametrize(
    ("policy", "changed"),
    [
        (ChangePolicy.EMPTY_EQ_NULL, {"a": False, "b": True, "c": True, "d": False}),
        (ChangePolicy.DISTINCT, {"a": True, "b": True, "c": True, "d": False}),
        (ChangePolicy.STRING_NE, {"a": False, "b": True, "c": False, "d": False}),
    ],
)
def test_change_policies(spark, policy, changed):
    # a: null against empty, b: text against null, c: null against text, d: equal
    destination = spark.createDataFrame([("a", None), ("b", "x"), ("c", None), ("d", "y")], "k string, v string")
    source = spark.createDataFrame([("a", ""), ("b", None), ("c", "500"), ("d", "y")], "k string, v string")
    found = {r["k"] for r in X.update_candidates(destination, source, ["k"], MatchPolicy.EXACT, policy).collect()}
    assert found == {k for k, v in changed.items() if v}


def test_match_policies(spark):
    destination = spark.createDataFrame([("", 1), (None, 2), ("5", 3)], "k string, v int")
    source = spark.createDataFrame([(None, 9), ("5", 9)], "k string, v int")
    left = lambda policy: X.delete_matched(source, destination, ["k"], policy).count()
    assert (left(MatchPolicy.EXACT), left(MatchPolicy.SOURCE_EMPTY)) == (1, 0)
    typed = spark.createDataFrame([(5, 3)], "k int, v int")
    assert X.delete_matched(source, typed, ["k"], MatchPolicy.SOURCE_EMPTY_AS_TEXT).count() == 1


def test_null_normalisation_and_reserved_names(spark):
    df = spark.createDataFrame([(1, None, ""), (2, "", None)], "`table` int, `column` string, `a.b` string")
    out = X.normalised(df, ImportOptions(convert_empty_to_null=("a.b",)))
    assert rows(out) == [(1, "", None), (2, "", None)]
    assert rows(X.normalised(df, ImportOptions(type_mode=ImportOptions().type_mode.USER))) == rows(df)


def test_semi_structured_casts(spark):
    df = spark.createDataFrame([('{"a": 1}', "[1, 2]", "[1.5, 2]")], "o string, a string, v string")
    out = df.select(F.to_json(E.as_object(F.col("o"))).alias("o"), F.size(E.as_array(F.col("a"))).alias("a"), E.as_vector(F.col("v"), 2).alias("v"), F.schema_of_variant(E.as_variant(F.col("o"))).alias("s")).first()
    assert tuple(out) == ('{"a":1}', 2, [1.5, 2.0], "STRING")
    for wrong in (E.as_object(F.lit("[1]")), E.as_array(F.lit("{")), E.as_vector(F.lit("[1]"), 2)):
        with pytest.raises(Exception, match="VALUE_CONVERSION"):
            df.select(wrong.cast("string") if wrong is None else wrong.alias("x")).collect()


def test_timestamps(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert X.with_timestamp(df, ImportOptions(import_time=datetime(2020, 1, 2))).first()[1] == datetime(2020, 1, 2)
    assert X.with_timestamp(df, ImportOptions(timestamp_mode=TimestampMode.NONE)).columns == ["a"]


def test_checks():
    v = lambda name, length, type_="VARCHAR": ColumnDef(name, TypeDef("snowflake", type_, length))
    a, b = TableDef("a", (v("x", "5"), v("i", None), v("j", None), v("y", "5"))), TableDef("b", (v("x", "9"), v("y", "9")))
    checks.same_columns_ordered(a, b, checks.LENGTH, ["i", "j"])  # neighbours are ignored too
    with pytest.raises(ColumnsMismatch):
        checks.same_columns_ordered(a, b, checks.STRICT, ["i", "j"])
    with pytest.raises(ColumnsMismatch):
        checks.same_columns_ordered(b, a, checks.LENGTH, ["i", "j"])
    checks.same_columns_unordered(TableDef("c", (v("y", "1"), v("x", "1"))), b, checks.LENGTH)
    n = lambda length: v("n", length, "NUMBER")
    assert checks.same_length(n("10,2"), n("12,2"), checks.LENGTH) and not checks.same_length(n("10,3"), n("12,2"), checks.LENGTH)
    assert checks.same_length(n("10"), n("12,2"), checks.LENGTH) and not checks.same_length(n(None), n("1"), checks.LENGTH)
    checks.same_primary_keys(["a", "b"], ["b", "a"])
    with pytest.raises(ColumnsMismatch):
        checks.same_primary_keys(["a"], ["b"])
    with pytest.raises(ColumnsMismatch):
        checks.require_columns([], ["a"])
    with pytest.raises(ColumnsMismatch):
        checks.require_columns(["A"], ["a"])
    assert checks.column_map(["a", "b"], ["x", "y"], by_order=True) == {"a": "x", "b": "y"}
    assert checks.in_ignoring_case("A", ["a"]) and checks.equal_ignoring_case("A", "a")
