"""Exact dedup by content-defined chunk recipes.

A text, lower-cased A-Z, is cut where a rolling hash of its last bytes says so. A chunk
goes by a digest of its bytes; digests are verified by comparing the bytes of all chunks
that share one, and a digest that stands for several contents gets a content number.
Documents then compare as ordered lists of these identifiers. Digests are counted first:
only chunks whose digest comes up again move at all, each distinct one once a map task, as
long as the list of such digests can be sent to the tasks; beyond that every distinct chunk
moves once. Dropping copies goes by a list of rows and moves no text.

Defined cases: a null text is empty; an empty text has the empty recipe, so all empty
texts are equal; a null doc_id loses against any other; rows that repeat both doc_id and
text count in group_size and all carry the same decision, but drop_exact_copies leaves
one row of a group, whatever the ids; no documents: no rows; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import ROW, fields, materialise, restored, sent_if_few, skew_join, with_row_key, without_rows

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 16384, 11
DIGEST = 16
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of data. A cut falls after a byte where the hash of the 16
    bytes up to it has its top bits clear, at least MIN_CHUNK and at most MAX_CHUNK
    bytes after the one before: it depends on near bytes only."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8):  # the hash of 2 x width bytes from two of width bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    ends, last = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist():
        while i - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if i - last >= MIN_CHUNK:
            ends.append(i)
            last = i
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(data: bytes, digest_bytes: int = DIGEST) -> Iterator[tuple[bytes, bytes]]:
    last = 0
    for end in cuts(data):
        part = data[last:end]
        yield xxhash.xxh3_128_digest(part)[:digest_bytes], part
        last = end


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield (x.as_py() or b"").lower()  # bytes.lower() changes A-Z only


def recipes(docs: DataFrame, digest_bytes: int = DIGEST, key: str = "doc_id") -> DataFrame:
    """doc_id, text_sha256 and the digests of the text's chunks, in order, as one binary;
    and the column key, if another."""
    names = list(dict.fromkeys(("doc_id", key)))

    def run(batches):
        for b in batches:
            sha, lists = [], []
            for data in _texts(b.column("text")):
                sha.append(hashlib.sha256(data).hexdigest())
                lists.append(b"".join(d for d, _ in chunks(data, digest_bytes)))
            yield pa.record_batch([*map(b.column, names), pa.array(sha, pa.string()), pa.array(lists, pa.binary())], names=[*names, "text_sha256", "recipe"])

    columns = [F.col(c).cast("long").alias(c) for c in names]
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", text_sha256 string, recipe binary")


def chunk_contents(docs: DataFrame, digest_bytes: int = DIGEST, of: DataFrame | None = None) -> DataFrame:
    """(digest, content), each distinct pair once; only those of the digests ``of``, if given."""

    def run(batches):
        for b in batches:
            digests, parts, held = [], [], 0
            for data in _texts(b.column("text")):
                for d, part in chunks(data, digest_bytes):
                    digests.append(d)
                    parts.append(part)
                    held += len(part)
                if held > 1 << 24:
                    yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(parts, pa.binary())], names=["digest", "content"])
                    digests, parts, held = [], [], 0
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(parts, pa.binary())], names=["digest", "content"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "digest binary, content binary")
    return (parts if of is None else parts.join(of, "digest", "left_semi")).distinct()


def repeated_digests(found: DataFrame, digest_bytes: int = DIGEST) -> DataFrame:
    """The digests that come up more than once in recipes."""

    def run(batches):
        for b in batches:
            raw = b"".join(x.as_py() or b"" for x in b.column("recipe"))
            digests = np.frombuffer(raw, f"S{digest_bytes}") if digest_bytes == 1 else np.frombuffer(raw, f"V{digest_bytes}")
            names, counts = np.unique(digests.view(f"V{digest_bytes}"), return_counts=True)
            yield pa.record_batch([pa.array([x.tobytes() for x in names], pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n"])

    counted = found.select("recipe").mapInArrow(run, "digest binary, n long")
    return counted.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")


def shared_digests(contents: DataFrame) -> DataFrame:
    """The digests that stand for more than one content."""
    return contents.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")


def content_numbers(contents: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, content, number) of the digests that stand for more than one content."""
    return contents.join(shared, "digest").withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("content")))


def _patches(docs: DataFrame, numbers: DataFrame, digest_bytes: int, key: str) -> DataFrame:
    """For documents with such a digest: where it stands and which content it is there."""

    def run(batches):
        for b in batches:
            out = [(i.as_py(), k, d, part) for i, data in zip(b.column(key), _texts(b.column("text")), strict=True) for k, (d, part) in enumerate(chunks(data, digest_bytes))]
            i, k, d, part = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(d, pa.binary()), pa.array(part, pa.binary())], names=["row", "place", "digest", "content"])

    spread = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, place long, digest binary, content binary")
    return spread.join(numbers, ["digest", "content"]).select("row", "place", "number")


def _contents(docs: DataFrame, digest_bytes: int = DIGEST, key: str = "doc_id") -> DataFrame:
    """The recipes and, as patch, what tells contents of one digest apart: rows of equal
    text, and no others, agree in both.

    With DIGEST bytes (128 bits) no digest is expected to stand for two contents; that
    none does is still checked on all bytes, and those that do are told apart. The
    check is one job over all chunks; only where it finds such digests is text read again."""
    found = materialise(recipes(docs, digest_bytes, key))
    repeated = sent_if_few(materialise(repeated_digests(found, digest_bytes)), 64)
    shared = materialise(shared_digests(chunk_contents(docs, digest_bytes, repeated)))
    if shared.limit(1).count():
        numbers = materialise(content_numbers(chunk_contents(docs, digest_bytes), shared))
        places = _patches(docs, numbers, digest_bytes, key).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("place", "number"))).alias("patch"))
        found = found.join(places, found[key].eqNullSafe(places["row"]), "left").drop("row").withColumn("patch", F.coalesce(F.to_json("patch"), F.lit("")))
    else:
        return found.withColumn("patch", F.lit(""))
    return materialise(found)


def exact_dedup(docs: DataFrame, digest_bytes: int = DIGEST) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = _contents(docs, digest_bytes)
    groups = found.groupBy("recipe", "patch").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return skew_join(found, groups, ["recipe", "patch"], "inner").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, digest_bytes: int = DIGEST) -> DataFrame:
    """docs with one row of each group, one that has the group's greatest doc_id; rows and
    columns otherwise as they are."""
    keyed = with_row_key(docs)
    found = _contents(fields(keyed, "doc_id", "text"), digest_bytes, ROW)
    best = found.groupBy("recipe", "patch").agg(F.max(F.struct("doc_id", ROW)).alias("best"), F.count("*").alias("n")).where("n > 1")
    beaten = skew_join(found.select(ROW, "recipe", "patch"), best, ["recipe", "patch"], "inner").where(F.col(ROW) != F.col(f"best.{ROW}"))
    return restored(without_rows(keyed, materialise(beaten.select(ROW))))
