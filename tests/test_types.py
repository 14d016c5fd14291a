import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from millrace.functions import nested as N
from millrace.functions.types import RULES, InvalidCompression, InvalidLength, InvalidOption, InvalidType, TypeDef, definition_for_base, parse_type_text, type_for_base


@pytest.mark.parametrize(
    ("dialect", "type_", "length", "base"),
    [
        ("snowflake", "number", "38,0", "INTEGER"), ("snowflake", "NUMBER", "38,2", "NUMERIC"), ("snowflake", "NUMERIC", "38,0", "NUMERIC"), ("snowflake", "TIME", None, "STRING"),
        ("bigquery", "TIME", None, "TIMESTAMP"), ("oracle", "DATE", None, "TIMESTAMP"), ("oracle", "BINARY_FLOAT", None, "NUMERIC"), ("mysql", "BIT", None, "STRING"), ("mysql", "YEAR", None, "STRING"),
        ("generic", "timestamp_ntz", None, "TIMESTAMP"), ("generic", "whatever", "7", "STRING"), ("redshift", "timestamp with time zone", None, "TIMESTAMP"),
    ],
)
def test_base_types(dialect, type_, length, base):
    assert TypeDef(dialect, type_, length).base_type == base


@pytest.mark.parametrize(
    ("dialect", "type_", "length"),
    [
        ("snowflake", "NUMBER", "39"), ("snowflake", "NUMBER", "10,11"), ("snowflake", "NUMBER", "a"), ("snowflake", "NUMBER", "1,2,3"), ("snowflake", "VARCHAR", "134217729"), ("snowflake", "TIME", "10"),
        ("snowflake", "VECTOR", None), ("snowflake", "VECTOR", "FLOAT,4097"), ("snowflake", "DATE", "1"), ("snowflake", "BINARY", "8388609"), ("bigquery", "NUMERIC", "38,10"), ("bigquery", "NUMERIC", "31,1"),
        ("bigquery", "BIGNUMERIC", "77"), ("bigquery", "STRING", "0"), ("redshift", "DECIMAL", "38"), ("redshift", "CHAR", "4097"), ("mysql", "VARCHAR", None), ("mysql", "FLOAT", "10,10"), ("mysql", "DECIMAL", "66"), ("mysql", "TIME", "7"),
    ],
)
def test_invalid_lengths(dialect, type_, length):
    with pytest.raises(InvalidLength):
        TypeDef(dialect, type_, length)


def test_invalid_types_and_options():
    with pytest.raises(InvalidType):
        TypeDef("snowflake", "INT128")
    with pytest.raises(InvalidOption):
        TypeDef("mysql", "INT", compression="ZSTD")
    for compression, type_ in (("BYTEDICT", "BOOL"), ("MOSTLY8", "DATE"), ("TEXT255", "CHAR"), ("SNAPPY", "INT")):
        with pytest.raises(InvalidCompression):
            TypeDef("redshift", type_, compression=compression)
    assert TypeDef("redshift", "int", compression="mostly16").sql() == "int ENCODE mostly16"


@pytest.mark.parametrize(
    ("definition", "sql"),
    [
        (TypeDef("snowflake", "VARCHAR", "10", False, "'x'"), "VARCHAR(10) NOT NULL DEFAULT 'x'"),
        (TypeDef("snowflake", "VARCHAR", "10", True, ""), "VARCHAR(10)"),
        (TypeDef("bigquery", "STRING", "10", False, "'x'"), "STRING(10) DEFAULT 'x' NOT NULL"),
        (TypeDef("bigquery", "ARRAY", "INT64", False, "x"), "ARRAY<INT64>"),
        (TypeDef("generic", "VARCHAR", "5"), "VARCHAR(5) NULL DEFAULT NULL"),
        (TypeDef("generic", "VARCHAR", "5", False, ""), "VARCHAR(5) NOT NULL DEFAULT ''"),
        (TypeDef("oracle", "NUMBER", "10", False), "NUMBER NOT NULL"),
        (TypeDef("oracle", "VARCHAR2", "10"), "VARCHAR2(10)"),
    ],
)
def test_rendering(definition, sql):
    assert definition.sql() == sql


def test_names_by_base_type():
    assert type_for_base("snowflake", "numeric") == "NUMBER"
    assert definition_for_base("snowflake", "NUMERIC").sql() == "NUMERIC(38,9)"
    assert type_for_base("oracle", "BOOLEAN") == "NUMBER"
    assert TypeDef("snowflake", "DOUBLE PRECISION").canonical == "FLOAT"
    assert TypeDef("bigquery", "INT64").canonical == "INTEGER"
    with pytest.raises(NotImplementedError):
        type_for_base("mysql", "STRING")
    with pytest.raises(InvalidType):
        type_for_base("snowflake", "THING")


def test_spark_types():
    assert TypeDef("snowflake", "NUMBER", "10,2").spark() == T.DecimalType(10, 2)
    assert TypeDef("bigquery", "NUMERIC").spark() == T.DecimalType(38, 9)
    assert TypeDef("bigquery", "BIGNUMERIC", "58,20").spark() == T.StringType()
    assert TypeDef("snowflake", "VECTOR", "FLOAT,3").spark() == T.ArrayType(T.FloatType())
    assert TypeDef("snowflake", "VARIANT").spark() == T.VariantType()
    assert TypeDef("snowflake", "TIMESTAMP").spark() == T.TimestampNTZType()
    assert TypeDef("bigquery", "TIMESTAMP").spark() == T.TimestampType()
    for dialect, rules in RULES.items():
        for name in rules:
            length = "FLOAT,3" if name == "VECTOR" else "9" if (dialect, name) == ("mysql", "VARCHAR") else None
            assert isinstance(TypeDef(dialect, name, length).spark(), T.DataType)


def test_catalog_text_and_length_parts():
    assert parse_type_text("snowflake", "NUMBER(38, 0)").length == "38,0"
    assert parse_type_text("redshift", "character varying(5)").type == "character varying"
    assert TypeDef("snowflake", "NUMBER", {"numeric_precision": 10, "numeric_scale": 2}).length == "10,2"
    assert TypeDef("snowflake", "NUMBER").precision_scale() == (38, 0)
    with pytest.raises(InvalidOption):
        TypeDef("snowflake", "NUMBER", {"width": 1})


def test_nested_types():
    text = "ARRAY<STRUCT<a INT64,b STRING(10),c ARRAY<NUMERIC(10,2)>>>"
    node = N.parse_type(" array < struct<a int64 , b STRING( 10 ), c ARRAY<NUMERIC(10, 2)>>>")
    assert N.to_text(node) == text
    schema = N.to_field("x", node)
    assert schema["mode"] == "REPEATED" and schema["fields"][1] == {"name": "b", "type": "STRING", "maxLength": "10"}
    assert N.to_field("x", N.from_field(schema)) == schema
    assert N.to_spark(node).simpleString() == "array<struct<a:bigint,b:string,c:array<decimal(10,2)>>>"
    for wrong in ("ARRAY<", "STRUCT<a>", "ARRAY<INT64> x", "STRUCT<a INT64 b INT64>", "STRING(10", ""):
        with pytest.raises(InvalidLength):
            N.parse_type(wrong)


@st.composite
def _node(draw, depth=3):
    kind = draw(st.sampled_from(["INT64", "STRING", "NUMERIC", *(["ARRAY", "STRUCT"] if depth else [])]))
    if kind == "ARRAY":
        return N.Nested("ARRAY", element=draw(_node(depth=0)))
    if kind == "STRUCT":
        return N.Nested("STRUCT", fields=[(f"f{k}", draw(_node(depth=depth - 1))) for k in range(draw(st.integers(1, 3)))])
    return N.Nested(kind, draw(st.sampled_from([None, "9"])) if kind != "INT64" else None)


@given(_node())
def test_nested_round_trip(node):
    assert N.to_text(N.parse_type(N.to_text(node))) == N.to_text(node)
