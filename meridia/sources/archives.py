"""Files inside files: members of zip archives, and shapes with their attributes."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a large-file pointer begins that stands in for an archive (fixed value).
POINTER = b"version https://git-lfs.github.com/spec/v1"
SHAPE_PARTS = (".shp", ".shx", ".dbf", ".prj", ".cpg")


def read_zip(spark: SparkSession, path: str, stems: Sequence[str] | None = None, suffixes: Sequence[str] = SHAPE_PARTS) -> DataFrame:
    """archive, stem, suffix, content: the wanted members, a row each. Pointers and files
    that are no archive give no rows. An archive is read by one task, a member at a time."""
    wanted = None if stems is None else frozenset(stems)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                file = io.BytesIO(content.as_buffer())
                if content.as_buffer()[: len(POINTER)].to_pybytes() == POINTER or not zipfile.is_zipfile(file):
                    continue
                with zipfile.ZipFile(file) as archive:
                    for info in archive.infolist():
                        stem, dot, suffix = info.filename.rsplit("/", 1)[-1].rpartition(".")
                        suffix = (dot + suffix).lower()
                        if suffix in suffixes and (wanted is None or stem in wanted):
                            yield pa.RecordBatch.from_pylist([{"archive": path, "stem": stem, "suffix": suffix, "content": archive.read(info)}], schema=out)

    out = pa.schema([("archive", pa.string()), ("stem", pa.string()), ("suffix", pa.string()), ("content", pa.binary())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(members, "archive string, stem string, suffix string, content binary")


def _attributes(dbf: bytes, encoding: str) -> Iterator[dict[str, str] | None]:
    """Records of an attribute table, in order; None for one marked as deleted."""
    n, start, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while at + 32 <= start and dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("ascii", "replace"), dbf[at + 16]))
        at += 32
    for i in range(n):
        at, row = start + i * width + 1, {}
        for name, size in fields:
            row[name] = dbf[at : at + size].decode(encoding, "replace").strip(" \0")
            at += size
        yield None if dbf[start + i * width : start + i * width + 1] == b"*" else row


def _rings(shp: bytes) -> Iterator[list[list[dict]]]:
    """Rings of each record, in order: a point is one ring of one point, a null shape none.
    Repeated neighbours go, and so do rings that keep under four points with their end."""
    at = 100
    while at + 8 <= len(shp):
        size = struct.unpack_from(">I", shp, at + 4)[0] * 2
        body = shp[at + 8 : at + 8 + size]
        kind = struct.unpack_from("<I", body)[0] % 10 if len(body) >= 4 else 0
        at += 8 + size
        if kind == 1:
            x, y = struct.unpack_from("<2d", body, 4)
            yield [[{"x": x, "y": y}]]
        elif kind in (3, 5):
            parts, points = struct.unpack_from("<2I", body, 36)
            starts = [*struct.unpack_from(f"<{parts}I", body, 44), points]
            flat = struct.unpack_from(f"<{2 * points}d", body, 44 + 4 * parts)
            rings = []
            for a, b in zip(starts, starts[1:], strict=False):
                ring = []
                for p in zip(flat[2 * a : 2 * b : 2], flat[2 * a + 1 : 2 * b : 2], strict=True):
                    if not ring or ring[-1] != p:
                        ring.append(p)
                if kind == 5 and ring and ring[0] != ring[-1]:
                    ring.append(ring[0])
                if len(ring) >= (4 if kind == 5 else 2):
                    rings.append([{"x": x, "y": y} for x, y in ring])
            yield rings
        else:
            yield []


def shapes(members: DataFrame, name_field: str, encoding: str = "utf-8", rows: int = 512) -> DataFrame:
    """archive, stem, name, attributes, rings from read_zip's rows, a row a shape.

    The name is the stated attribute, empty where it is missing. Both halves of a layer
    meet in one row; points, lines and polygons are read, other kinds have no rings."""
    half = lambda s: members.where(F.col("suffix") == s)
    both = half(".shp").select("archive", "stem", F.col("content").alias("shp")).join(half(".dbf").select("archive", "stem", F.col("content").alias("dbf")), ["archive", "stem"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer in range(batch.num_rows):
                archive, stem, shp, dbf = (batch[c][layer].as_py() for c in ("archive", "stem", "shp", "dbf"))
                part = []
                for rings, row in zip(_rings(shp), _attributes(dbf, encoding), strict=False):
                    if row is not None:
                        part.append({"archive": archive, "stem": stem, "name": row.get(name_field, ""), "attributes": list(row.items()), "rings": rings})
                    if len(part) == rows:
                        yield pa.RecordBatch.from_pylist(part, schema=out)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema=out)

    ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    out = pa.schema([("archive", pa.string()), ("stem", pa.string()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("rings", pa.list_(ring))])
    return both.mapInArrow(read, "archive string, stem string, name string, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>")
