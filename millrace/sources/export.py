"""Export to CSV or Parquet slices with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import column, csv_field
from millrace.model import ExportOptions
from millrace.sources import paths

Writer = Callable[[DataFrame, str, ExportOptions], None]
WRITERS: dict[str, Writer] = {}


def writer(kind: str) -> Callable[[Writer], Writer]:
    """Register the writer of a file type; there is exactly one for each."""

    def register(function: Writer) -> Writer:
        if kind in WRITERS:
            raise ValueError(f"{kind} has a writer already")
        WRITERS[kind] = function
        return function

    return register


def _csv_value(field: T.StructField, options: ExportOptions) -> Column:
    value, kind = column(field.name), field.dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if options.timezone and isinstance(kind, T.TimestampType):
            value = F.convert_timezone(F.current_timezone(), F.lit(options.timezone), value.cast("timestamp_ntz"))
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss" + (".SSSSSSSSS" if options.fraction else ""))
        return csv_field(text, True, options.enclosure)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return csv_field(F.to_json(value), True, options.enclosure)
    if isinstance(kind, T.BinaryType):
        return csv_field(F.hex(value), True, options.enclosure)
    return csv_field(value, isinstance(kind, (T.StringType, T.DateType)), options.enclosure)


def csv_lines(df: DataFrame, options: ExportOptions) -> DataFrame:
    """One line for each row; quoting goes by type, so nulls and empty strings stay apart.

    No line is empty, since readers skip such lines: a row whose only column is null is written as an empty string, and
    without an enclosure, where that cannot be told from no row, it is an error.
    """
    line = F.concat_ws(",", *[_csv_value(f, options) for f in df.schema])
    if len(df.columns) == 1:
        blank = F.lit(options.enclosure * 2) if options.enclosure else F.raise_error(F.lit("VALUE_CONVERSION: a row of one empty column needs an enclosure")).cast("string")
        line = F.when(line == "", blank).otherwise(line)
    return df.select(line.alias("value"))


def _records_per_file(df: DataFrame, options: ExportOptions) -> int:
    """About as many rows as a slice holds, by the types' sizes; an estimate without a pass over the data."""
    width = sum(8 if f.dataType.simpleString() in ("bigint", "double", "timestamp", "timestamp_ntz") else 4 if f.dataType.simpleString() in ("int", "date", "float") else 24 for f in df.schema)
    return max(1, options.slice_bytes // max(1, width))


@writer("csv")
def _write_csv(df: DataFrame, path: str, options: ExportOptions) -> None:
    compression = "gzip" if options.compressed else "none"
    csv_lines(df, options).write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", _records_per_file(df, options)).text(path)


@writer("parquet")
def _write_parquet(df: DataFrame, path: str, options: ExportOptions) -> None:
    compression = "snappy" if options.compressed else "none"
    df.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", _records_per_file(df, options)).parquet(path)


def export(df: DataFrame, path: str, options: ExportOptions = ExportOptions()) -> list[dict[str, str | int]]:
    """Write slices and return name, size and rows of each; the manifest stands beside the folder as ``<path>manifest``."""
    spark, path = df.sparkSession, paths.normalised(path)
    WRITERS[options.file_type](df, path, options)
    counts = {r["f"]: r["n"] for r in slice_counts(spark, path, options.file_type, options.enclosure).collect()}
    out = []
    for url, size in paths.listing(spark, path):
        out.append({"FILE_NAME": paths.file_name(url), "FILE_SIZE": size, "ROW_COUNT": counts.get(paths.file_name(url), 0), "URL": url})
    if options.manifest:
        write_manifest(spark, path + "manifest", [str(o["URL"]) for o in out])
    return out


def slice_counts(spark: SparkSession, path: str, file_type: str, enclosure: str = '"') -> DataFrame:
    """Rows of each slice. A Parquet scan reads no columns for it. A CSV row may span lines, so rows are parsed."""
    quote = enclosure or "\u0000"
    reader = spark.read.option("multiLine", bool(enclosure)).option("quote", quote).option("escape", quote).option("maxCharsPerColumn", -1)
    df = spark.read.parquet(path) if file_type == "parquet" else reader.schema("v string").csv(path)
    return df.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).agg(F.count("*").alias("n"))


def write_manifest(spark: SparkSession, path: str, urls: list[str]) -> None:
    paths.write_text(spark, path, json.dumps({"entries": [{"url": u, "mandatory": True} for u in urls]}))


def manifest_from_folder(spark: SparkSession, folder: str, manifest: str | None = None) -> str:
    """A manifest of all files that a folder holds."""
    where = manifest or folder.rstrip("/") + "manifest"
    write_manifest(spark, where, [url for url, _ in paths.listing(spark, folder)])
    return where
