"""Spark data source ``media_archive``: members of archives, read by byte ranges.

Options: ``path``, a folder with ``manifest.json`` ({"archives": [{"name", "size"}]}), and optionally ``rangeBytes`` and
``batchBytes``. Planning only cuts archives into byte ranges, by size; a task reads the archive's own directory and
takes the members that begin within its range. Payloads stream as Arrow batches of bounded size. Each member is read
by its offset and checked; a failed read is tried again for that member alone, and a member that stays unreadable
gives a row with a null payload and an error.
"""

from __future__ import annotations

import json
import struct
import time
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES, BATCH_BYTES, TRIES = 16 << 20, 4 << 20, 3
SCHEMA = "member string, note string, offset long, media binary, error string"
ARROW = pa.schema([("member", pa.string()), ("note", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all machines share."""
    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    elif uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    elif "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def read_member(file, info: zipfile.ZipInfo) -> bytes:
    """One stored member by its offset; checked by length and CRC."""
    file.seek(info.header_offset)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {info.header_offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(info.header_offset + 30 + name + extra)
    data = file.read(info.compress_size)
    if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
        raise OSError(f"damaged member at {info.header_offset}")
    return data


class ByteRange(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class MediaArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch = int(options.get("batchBytes", BATCH_BYTES))

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.path)
        with fs.open_input_file(f"{path}/manifest.json") as file:
            archives = json.loads(file.read())["archives"]
        return [ByteRange(a["name"], s, min(s + self.range, a["size"])) for a in archives for s in range(0, max(1, a["size"]), self.range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.name:
            return
        fs, path = file_system(self.path)
        where = f"{path}/{partition.name}"
        file = fs.open_input_file(where)
        with zipfile.ZipFile(file) as archive:
            members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        file = fs.open_input_file(where)
        rows, held = [], 0
        for info in members:
            data, error = None, None
            for attempt in range(TRIES):
                try:
                    data, error = read_member(file, info), None
                    break
                except OSError as e:
                    error = str(e)
                    time.sleep(0.05 * attempt)
                    file = fs.open_input_file(where)
            rows.append((info.filename, info.comment.decode("utf-8"), info.header_offset, data, error))
            held += len(data or b"")
            if held >= self.batch or len(rows) >= 5000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaArchiveReader:
        return MediaArchiveReader(self.options)
