"""Versioned Parquet tables: each commit writes a new folder and then moves the table to it in one step."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.expressions import quoted, sql_literal
from millrace.functions.types import TypeDef
from millrace.model import ColumnDef, TableDef
from millrace.operators.transforms import aligned
from millrace.plans.errors import LoadError
from millrace.plans.retry import DEFAULT
from millrace.sources import paths

KEY, COLUMNS = "millrace.primary_key", "millrace.columns"


class ConcurrentCommit(LoadError):
    pass


class TableStore:
    """Tables of one catalog schema under one root folder.

    A reader sees the old version or the new one, never a part: files are complete before the location changes, and the
    version is part of the folder's name, so both change in one step. A failed write leaves the table as it was. A
    commit that finds another version than the one it read from fails. New types need a new catalog entry; it is made
    under another name first, so an entry with the table's files exists at every moment. Partitions are those of the
    catalog; they are registered right after the location has moved.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str = "default"):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def name(self, table: str) -> str:
        return f"{quoted(self.schema)}.{quoted(table)}"

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def create(self, definition: TableDef, partition_by: tuple[str, ...] = (), cluster_by: tuple[str, ...] = ()) -> None:
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {quoted(self.schema)}")
        where = self._new_folder(definition.name, 0)
        empty = self.spark.createDataFrame([], definition.schema())
        empty.write.parquet(where)
        self._enter(definition.name, definition, partition_by, cluster_by, where)

    def _enter(self, name: str, definition: TableDef, partition_by: tuple[str, ...], cluster_by: tuple[str, ...], where: str) -> None:
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in definition.schema())
        layout = f" PARTITIONED BY ({', '.join(map(quoted, partition_by))})" if partition_by else ""
        layout += f" CLUSTER BY ({', '.join(map(quoted, cluster_by))})" if cluster_by else ""
        self.spark.sql(f"CREATE TABLE {self.name(name)} ({columns}) USING parquet{layout} TBLPROPERTIES ({self._properties(definition)}) LOCATION {sql_literal(where)}")

    def layout(self, table: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Columns that the table is partitioned by, and clustered by."""
        entries = self.spark.catalog.listColumns(self.name(table))
        return tuple(c.name for c in entries if c.isPartition), tuple(c.name for c in entries if getattr(c, "isCluster", False))

    def _properties(self, definition: TableDef) -> str:
        columns = json.dumps([{"name": c.name, "dialect": c.type.dialect, **c.type.as_dict()} for c in definition.columns])
        values = {KEY: json.dumps(list(definition.primary_key)), COLUMNS: columns}
        return ", ".join(f"{sql_literal(k)} = {sql_literal(v)}" for k, v in values.items())

    def properties(self, table: str) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)}").collect()}

    def version(self, table: str) -> int:
        return int(paths.file_name(self.location(table)).split("-")[1])

    def definition(self, table: str) -> TableDef:
        found = self.properties(table)
        columns = []
        for c in json.loads(found[COLUMNS]):
            columns.append(ColumnDef(c.pop("name"), TypeDef(c.pop("dialect"), **c)))
        return TableDef(table, tuple(columns), tuple(json.loads(found[KEY])))

    def location(self, table: str) -> str:
        rows = self.spark.sql(f"DESCRIBE FORMATTED {self.name(table)}").where("col_name = 'Location'").collect()
        return rows[0]["data_type"]

    def read(self, table: str) -> DataFrame:
        """The current version, with the columns' definitions in the fields' metadata."""
        definition = self.definition(table)
        df = self.spark.read.schema(definition.schema()).parquet(self.location(table))
        return df.select(*[df[quoted(c.name)].alias(c.name, metadata=c.type.metadata()) for c in definition.columns])

    def _new_folder(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v-{version}-{uuid.uuid4().hex}"

    def commit(self, table: str, df: DataFrame, read_version: int, definition: TableDef | None = None) -> int:
        """Replace the table's rows; with ``definition``, its columns and key as well."""
        target, (partitions, clusters) = definition or self.definition(table), self.layout(table)
        where = self._new_folder(table, read_version + 1)
        partitions, clusters = (tuple(c for c in x if c in target.names) for x in (partitions, clusters))
        writer = aligned(df, target.schema()).write
        (writer.partitionBy(*partitions) if partitions else writer).parquet(where)
        if self.version(table) != read_version:
            raise ConcurrentCommit(f"{table} changed since version {read_version} was read")
        if definition is not None:
            # Types cannot be altered in place. The files of both versions stay.
            fresh, old = f"{table}__new", f"{table}__old"
            for leftover in (fresh, old):
                self.spark.sql(f"DROP TABLE IF EXISTS {self.name(leftover)}")
            self._enter(fresh, target, partitions, clusters, where)
            self.spark.sql(f"ALTER TABLE {self.name(table)} RENAME TO {self.name(old)}")
            self.spark.sql(f"ALTER TABLE {self.name(fresh)} RENAME TO {self.name(table)}")
            self.spark.sql(f"DROP TABLE {self.name(old)}")
        else:
            DEFAULT.call(lambda: self.spark.sql(f"ALTER TABLE {self.name(table)} SET LOCATION {sql_literal(where)}"))
        self._register_partitions(table, partitions)
        self.spark.catalog.refreshTable(self.name(table))
        return read_version + 1

    def _register_partitions(self, table: str, partitions: tuple[str, ...]) -> None:
        if not partitions:
            return
        # Entries of the last version point to its folders; the table owns no files, so only entries go.
        for row in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect():
            spec = ", ".join(f"{quoted(k)} = {sql_literal(unquote(v))}" for k, _, v in (part.partition("=") for part in row["partition"].split("/")))
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP PARTITION ({spec})")
        self.spark.sql(f"ALTER TABLE {self.name(table)} RECOVER PARTITIONS")

    def append(self, table: str, df: DataFrame, read_version: int | None = None) -> None:
        """Add files to the current version; Spark's commit protocol shows all of them or none.

        If the table has moved on meanwhile, the files went to a version that is no longer read, and the append fails.
        """
        version, where, (partitions, _) = self.version(table), self.location(table), self.layout(table)
        if read_version is not None and version != read_version:
            raise ConcurrentCommit(f"{table} changed since version {read_version} was read")
        writer = aligned(df, self.definition(table).schema()).write.mode("append")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(where)
        if self.location(table) != where:
            raise ConcurrentCommit(f"{table} changed while rows were appended to version {version}")
        self._register_partitions(table, partitions)
        self.spark.catalog.refreshTable(self.name(table))

    def truncate(self, table: str) -> None:
        self.commit(table, self.spark.createDataFrame([], self.definition(table).schema()), self.version(table))

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")

    def vacuum(self, table: str) -> int:
        """Delete the folders of versions that are no longer current."""
        jvm = self.spark.sparkContext._jvm
        home = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = home.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        current, gone = paths.file_name(self.location(table)), 0
        for status in fs.listStatus(home):
            if status.getPath().getName() != current:
                fs.delete(status.getPath(), True)
                gone += 1
        return gone
