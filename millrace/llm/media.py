"""Media columns: texts kept as 8-bit images in archives, and read back through the ``media_archive`` data source."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import sys
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import archive_source
from millrace.llm.common import lean, prepare, scratch, slices

WIDTH = 64
ARCHIVE_BYTES = 32 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zero bytes up to a positive multiple of the image's width."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(payload: bytes) -> bytes:
    """Greyscale image of 8-bit samples, ``WIDTH`` wide, each row unfiltered."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> np.ndarray:
    """Samples of an image that ``encode_image`` wrote; chunk checksums are verified."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not an image of this kind")
    at, data, shape = 8, b"", None
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit greyscale without interlacing")
            shape = (height, width)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits and the shares of eight equal bands of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    p = counts[counts > 0] / samples.size
    value = np.arange(256)
    mean = float((counts * value).sum()) / samples.size
    spread = max(0.0, float((counts * value * value).sum()) / samples.size - mean * mean) ** 0.5
    bands = ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(axis=1) / samples.size)
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.4f};sd={spread:.4f};entropy={-(p * np.log2(p)).sum() + 0.0:.4f};bands={bands}"


WRITTEN = pa.schema([("name", pa.string()), ("size", pa.int64())])


def _write(folder: str):
    def run(batches):
        fs, path = archive_source.file_system(folder)
        fs.create_dir(path, recursive=True)
        sink, archive, n = None, None, 0

        def close():
            # Names are unique, so tasks that run twice do not meet; only what a finished task returns is listed.
            archive.close()
            body, name = sink.getvalue(), f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{path}/{name}") as out:
                out.write(body)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)], pa.int64())], schema=WRITTEN)

        for whole in batches:
            for part, data, off in slices(whole, "text"):
                for k, key in enumerate(part.column("key").to_pylist()):
                    if archive is None:
                        sink, n = io.BytesIO(), 0
                        archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                    info = zipfile.ZipInfo(f"{n:08d}.png")
                    info.comment = json.dumps({"key": key, "n": int(off[k + 1] - off[k])}).encode()
                    archive.writestr(info, encode_image(payload_of(data[off[k] : off[k + 1]].tobytes())))
                    n += 1
                    if sink.tell() >= ARCHIVE_BYTES:
                        yield close()
                        archive = None
        if archive is not None:
            yield close()

    return lean(run)


def write_archives(docs: DataFrame, id_col: str, text_col: str, folder: str | None = None) -> str:
    """Store every text as a member of archives in a shared folder; the folder, with its manifest, is returned.

    The manifest lists archives of about ``ARCHIVE_BYTES``, not members, so what comes to the driver is a name and a
    size for each of them.
    """
    spark = prepare(docs)
    folder = folder or scratch(spark, "media")
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_write(folder), "name string, size long").collect()
    fs, path = archive_source.file_system(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"archives": [{"name": r["name"], "size": r["size"]} for r in sorted(found)]}).encode())
    return folder


def read_archives(spark, folder: str, **options: str) -> DataFrame:
    """``(member, note, offset, media, error)`` of all members of a folder's archives."""
    # The reader travels by value: the processes that plan and read need no path to this package.
    cloudpickle.register_pickle_by_value(sys.modules[archive_source.__name__])
    spark.dataSource.register(archive_source.MediaArchive)
    return spark.read.format("media_archive").options(path=folder, **options).load()


FEATURES = pa.schema(
    [("key", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]
)


@lean
def _features(batches):
    for batch in batches:
        rows = []
        for note, media, error in zip(*(batch.column(k).to_pylist() for k in ("note", "media", "error")), strict=True):
            note = json.loads(note)
            row = {"key": note["key"], "n_bytes": note["n"], "error": error}
            if media is not None:
                samples = decode_image(media)
                payload = samples.tobytes()
                row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(samples)}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=FEATURES)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error)``.

    One row for each row of ``docs``, computed from the stored bytes as read back. A null text is stored as an empty
    one: 64 zero bytes. Equal texts give equal values. A null id stays null; repeated ids and rows stay repeated; other
    columns are not read; an empty table gives an empty table. ``error`` is null unless a member could not be read, in
    which case the values are null.
    """
    spark = prepare(docs)
    folder = write_archives(docs, id_col, text_col)
    rows = read_archives(spark, folder).select("note", "media", "error").mapInArrow(_features, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return rows.select(F.col("key").cast(docs.schema[id_col].dataType).alias("doc_id"), *[c for c in rows.columns if c != "key"])
