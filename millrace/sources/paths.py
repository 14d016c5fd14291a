"""Addresses of objects and files: schemes, names and existence."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.plans.retry import DEFAULT

# Schemes that Hadoop's file systems know, for the schemes of warehouses and object stores.
SCHEMES = {"s3": "s3a", "s3n": "s3a", "gcs": "gs", "azure": "abfss", "wasb": "wasbs"}


def normalised(url: str) -> str:
    """The address that Spark reads; a plain path stays."""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url
    if scheme == "azure":
        # azure://account.blob.core.windows.net/container/path
        host, _, path = rest.partition("/")
        container, _, path = path.partition("/")
        return f"abfss://{container}@{host.replace('.blob.', '.dfs.')}/{path}"
    return f"{SCHEMES.get(scheme, scheme)}://{rest}"


def file_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def prefix(path: str) -> str:
    """The folder of a path, with its slash."""
    return path[: len(path) - len(file_name(path))]


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return DEFAULT.call(lambda: where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> list[tuple[str, int]]:
    """Files under a folder with their sizes, hidden ones left out; listed page by page by the file system."""
    return DEFAULT.call(lambda: _listed(spark, folder, recursive))


def _listed(spark: SparkSession, folder: str, recursive: bool) -> list[tuple[str, int]]:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    pages, out = fs.listFiles(where, recursive), []
    while pages.hasNext():
        status = pages.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            out.append((status.getPath().toString(), status.getLen()))
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, such as a manifest, through Spark's own file systems."""
    return DEFAULT.call(lambda: _read(spark, path))


def _read(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written whole; one that is there is replaced."""
    DEFAULT.call(lambda: _write(spark, path, text))


def _write(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
