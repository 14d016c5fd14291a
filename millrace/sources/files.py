"""Delimited files: one object, slices by manifest, or a folder."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import column, quoted, tokens_to_null
from millrace.model import ImportOptions
from millrace.plans.errors import ColumnsMismatch, FileNotFound, MalformedInput
from millrace.sources import paths

_ABSENT = "\u0000\u0001absent"


@dataclass(frozen=True)
class CsvFormat:
    delimiter: str = ","
    enclosure: str = '"'
    escaped_by: str = ""

    def __post_init__(self) -> None:
        if len(self.delimiter) != 1 or len(self.enclosure) > 1 or len(self.escaped_by) > 1:
            raise ValueError("delimiter, enclosure and escape are single characters")
        if self.enclosure and self.escaped_by:
            raise ValueError("enclosure and escape exclude each other")


@dataclass(frozen=True)
class FileSource:
    """A file, a manifest of slices (``sliced``) or a folder (``directory``) with the given columns, all strings."""

    path: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...] = ()
    format: CsvFormat = CsvFormat()
    sliced: bool = False
    directory: bool = False
    recursive: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "primary_key", tuple(self.primary_key))

    def file_name(self) -> str:
        if self.sliced or self.directory:
            raise ValueError("a sliced source has no single file name")
        return paths.file_name(self.path)

    def entries(self, spark: SparkSession) -> list[str]:
        """Paths to read. A manifest that is missing or is none is an error; an empty one is no files."""
        where = paths.normalised(self.path)
        if not self.sliced:
            return [where.rstrip("/") + "/" if self.directory else where]
        if not paths.exists(spark, where):
            raise FileNotFound(f"manifest {where} was not found")
        try:
            entries = json.loads(paths.read_text(spark, where))["entries"]
            return [paths.normalised(e["url"]) for e in entries]
        except (ValueError, KeyError, TypeError) as e:
            raise MalformedInput(f"{where} is no manifest") from e

    def read(self, spark: SparkSession, options: ImportOptions = ImportOptions()) -> DataFrame:
        """All columns as strings with null tokens applied; lazily, in one scan."""
        schema = T.StructType([T.StructField(c, T.StringType()) for c in self.columns])
        if not self.columns:
            raise ColumnsMismatch("no columns found in the source", [], [])
        files = self.entries(spark)
        if not files:
            return spark.createDataFrame([], schema)
        # A long list is resolved by the driver's threads; a job with one task for each path takes far longer.
        spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", max(len(files) + 1, 32))
        raw = self._escaped(spark, files, options.skip_lines) if self.format.escaped_by else self._enclosed(spark, files, schema, options.skip_lines)
        tokens = list(options.import_as_null[:1] if options.only_first_null_token else options.import_as_null)
        return raw.select(*[tokens_to_null(column(c), tokens).alias(c) for c in self.columns])

    def _enclosed(self, spark: SparkSession, files: Sequence[str], schema: T.StructType, skip: int) -> DataFrame:
        f = self.format
        quote = f.enclosure or "\u0000"
        reader = spark.read.schema(schema).option("sep", f.delimiter).option("quote", quote).option("escape", quote)
        reader = reader.option("nullValue", _ABSENT).option("emptyValue", "").option("mode", "FAILFAST").option("enforceSchema", True)
        reader = reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("maxCharsPerColumn", -1)
        # Only records within enclosures can span lines; files without enclosure stay splittable.
        reader = reader.option("multiLine", bool(f.enclosure)).option("recursiveFileLookup", self.directory and self.recursive)
        if skip <= 1:
            return reader.option("header", skip == 1).csv(list(files))
        # More leading lines than one: cut them off each file's text, then let the same parser read the records.
        texts = self._whole_files(spark, files)
        lines = texts.select(F.regexp_replace("text", rf"^(?:[^\n]*+\n){{{skip - 1}}}+", "").alias("text"))
        parts = lines.select(F.explode(self._records("text")).alias("record")).where(F.col("record").rlike("[^\r\n]"))
        ddl = ", ".join(f"{quoted(c)} string" for c in self.columns)
        options = {"sep": f.delimiter, "quote": quote, "escape": quote, "nullValue": _ABSENT, "emptyValue": "", "mode": "FAILFAST", "multiLine": "true"}
        return parts.select(F.from_csv("record", F.lit(ddl), options).alias("r")).select("r.*")

    def _whole_files(self, spark: SparkSession, files: Sequence[str]) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", self.directory and self.recursive)
        return read.text(list(files), wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("text"))

    def _records(self, name: str):
        """Records of a text: line breaks outside of enclosures part them. The first one, a header line, is left out.

        Possessive runs, so that no text is scanned twice and no stack grows with it.
        """
        if not self.format.enclosure:
            return F.slice(F.split(name, r"\n"), 2, 1 << 30)
        q = f"\\x{ord(self.format.enclosure):02x}"
        return F.slice(F.regexp_extract_all(name, F.lit(rf"(?:[^{q}\n]++|{q}[^{q}]*+(?:{q}|\z))++"), F.lit(0)), 2, 1 << 30)

    def _escaped(self, spark: SparkSession, files: Sequence[str], skip: int) -> DataFrame:
        """Unenclosed fields with an escape character: a delimiter or line break after it belongs to the field."""
        sep, esc = (f"\\x{ord(c):02x}" for c in (self.format.delimiter, self.format.escaped_by))
        if skip:
            # Leading lines are those of a whole file; without any, files are read line by line and can be split.
            text = self._whole_files(spark, files).select(F.regexp_replace("text", rf"^(?:[^\n]*\n){{{skip}}}", "").alias("text"))
            # A field is a run of escaped pairs and plain characters, so any number of escapes in a row is read right.
            lines = text.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?:{esc}[\s\S]|[^{esc}\n])+"), F.lit(0))).alias("line"))
        else:
            lines = spark.read.option("recursiveFileLookup", self.directory and self.recursive).text(list(files)).where("value <> ''")
            cut = F.raise_error(F.lit("MALFORMED_RECORD: an escaped line break needs a header line to be skipped, which reads whole files"))
            lines = lines.select(F.when(F.col("value").rlike(rf"^(?:{esc}[\s\S]|[^{esc}])*$"), F.col("value")).otherwise(cut.cast("string")).alias("line"))
        fields = F.regexp_extract_all(F.concat(F.lit(self.format.delimiter), "line"), F.lit(rf"{sep}((?:{esc}[\s\S]|[^{esc}{sep}])*)"), F.lit(1))
        rows = lines.select(F.transform(fields, lambda x: F.regexp_replace(x, rf"{esc}([\s\S])", "$1")).alias("f"))
        wrong = F.raise_error(F.concat(F.lit(f"MALFORMED_RECORD: {len(self.columns)} fields expected, found "), F.size("f").cast("string")))
        rows = rows.select(F.when(F.size("f") == len(self.columns), F.col("f")).otherwise(wrong.cast("array<string>")).alias("f"))
        return rows.select(*[F.col("f")[i].alias(c) for i, c in enumerate(self.columns)])
