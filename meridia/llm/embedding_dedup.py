"""Embedding near-dedup by randomised-rotation binary codes with correction factors.

A vector is normalised and turned by a random rotation; the signs of its coordinates are
its code, and the code's inner product with the vector itself is kept as a correction
factor. With the other vector at four bits a coordinate, stored as bit planes, the inner
product of a pair is estimated from popcounts of (code AND plane),

    <code_x, y> / <code_x, x>,

which a random rotation makes unbiased. Its spread is known as well: the part of the code
across x, in the part of y across x, and the rounding of y, each over the root of the
dimensions. A pair whose estimate lies more than SPREAD such deviations below what a
cosine of the threshold would give is discarded; every other pair, and no more, is
recomputed exactly in double precision, and linked if its cosine reaches the threshold.

Candidates: codes meet in TABLES tables of cells, a cell being BITS signs of further
rotations. Two vectors at cosine 0.95 agree in a sign 9 times in 10, and share one of the
24 cells of 16 signs with probability 0.99, at 0.97 with 0.9998. A pair that meets in several
tables counts in the first only, which both rows' cell numbers tell.

How it moves: equal vectors are merged first (by SHA-256), so a crowd of copies is one row
with a weight. Through the tables go codes (about 120 bytes a row and table) and no vectors; what comes
back is the rows that have a surviving pair, never the pairs. Only these rows move
with their vectors, to the tables where they are needed, to be verified. A group hands on
its sums of links by row and a star for each of its components. Cells over CELL rows are cut
into pairs of parts. Components come from the distributed star algorithm.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components
link with nothing, nor do vectors of different lengths; a repeated vector links with its
copies; a null vec_id is no component's smallest unless there is no other, and is
kept where its component_id is null; rows of one vec_id are rows of their own, and kept
alike; finite components of any size are scaled before they are squared; no rows: no rows;
other columns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import connected_components, in_parts, materialise, skew_join

THRESHOLD, TABLES, BITS, CELL, SEED = 0.95, 24, 16, 4096, 20
#: Deviations below the threshold at which a pair is discarded: one in a million at worst.
SPREAD = 5.0
#: Bits a coordinate of the rotated vector is rounded to.
PLANES = 4
WORD = 64


@lru_cache(maxsize=4)
def rotations(dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation of the codes, those of the cells (stacked), and the rounding's dither,
    for vectors of this length filled up to whole words."""
    width = WORD * -(-dimensions // WORD)
    made = np.random.default_rng(SEED)
    turns = []
    for _ in range(1 + -(-TABLES * BITS // width)):
        q, r = np.linalg.qr(made.standard_normal((width, width)))
        turns.append((q * np.sign(np.diag(r)))[:, :dimensions])
    return turns[0], np.concatenate(turns[1:])[: TABLES * BITS], made.random(width)


class Codes:
    """Codes of some unit vectors: words, bit planes, factors (own inner product, low end and
    step of the rounding, sum and error of the rounded vector) and cell numbers by table."""

    def __init__(self, words: np.ndarray, planes: np.ndarray, factors: np.ndarray, cells: np.ndarray):
        self.words, self.planes, self.factors, self.cells = words, planes, factors, cells

    @staticmethod
    def of(unit: np.ndarray) -> Codes:
        turn, cell_turns, dither = rotations(unit.shape[1])
        y = unit @ turn.T
        n, width = y.shape
        low, step = y.min(axis=1), np.ptp(y, axis=1) / (2**PLANES - 1)
        step[step == 0] = 1
        level = np.clip(np.floor((y - low[:, None]) / step[:, None] + dither), 0, 2**PLANES - 1).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * level
        pack = lambda bits: np.packbits(bits, axis=1).view(np.uint64)
        planes = np.stack([pack(level >> p & 1) for p in range(PLANES)], axis=1)
        factors = np.stack([np.abs(y).sum(axis=1) / math.sqrt(width), low, step, rounded.sum(axis=1), np.linalg.norm(y - rounded, axis=1)], axis=1)
        signs = (unit @ cell_turns.T > 0).reshape(n, TABLES, BITS)
        cells = (signs << np.arange(BITS)).sum(axis=2).astype(np.uint16)
        return Codes(pack(y > 0), planes, factors, cells)

    def packed(self) -> list[bytes]:
        parts = (self.words, self.planes.reshape(len(self.words), -1), self.factors.astype(np.float32), self.cells)
        rows = np.concatenate([np.ascontiguousarray(p).view(np.uint8).reshape(len(p), -1) for p in parts], axis=1)
        return [r.tobytes() for r in rows]

    @staticmethod
    def unpacked(rows: list[bytes]) -> Codes:
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        tail = 5 * 4 + TABLES * 2
        words = (raw.shape[1] - tail) // (8 * (1 + PLANES))
        cut = np.cumsum([words * 8, words * 8 * PLANES, 5 * 4])
        a, b, c, d = (np.ascontiguousarray(x) for x in np.split(raw, cut, axis=1))
        return Codes(a.view(np.uint64), b.view(np.uint64).reshape(len(rows), PLANES, words), c.view(np.float32).astype(np.float64), d.view(np.uint16))

    def estimates(self, rows: np.ndarray, others: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of rows' codes and the others' rounded vectors, and the
        deviation of each at the threshold."""
        width = self.words.shape[1] * WORD
        both = np.zeros((len(rows), len(range(*others.indices(len(self.words))))), np.int32)
        for w in range(self.words.shape[1]):
            own = self.words[rows, w][:, None]
            for p in range(PLANES):
                both += np.bitwise_count(own & self.planes[others, p, w][None, :]).astype(np.int32) << p
        ones = np.bitwise_count(self.words[rows]).sum(axis=1, dtype=np.int64)[:, None]
        factor = self.factors[rows, 0][:, None]
        _, low, step, total, error = self.factors[others].T
        estimate = (2 * (low * ones + step * both) - total) / (math.sqrt(width) * factor)
        across = np.maximum(0, 1 - factor**2) / (factor**2 * max(1, width - 1)) * (1 - threshold**2)
        return estimate, np.sqrt(across + error**2 / (width * factor**2))

    def survivors(self, table: int, threshold: float, left: int | None = None):
        """Blocks of pairs (i, j), i < j, that the bounds leave and that meet in no earlier
        table; with left set, one of the first ``left`` rows and one of the rest."""
        n = len(self.words)
        others = slice(0 if left is None else left, n)
        step = max(1, (1 << 20) // max(1, n))
        for a in range(0, n if left is None else left, step):
            rows = np.arange(a, min(a + step, n if left is None else left))
            estimate, deviation = self.estimates(rows, others, threshold)
            near = estimate >= threshold - SPREAD * deviation
            if left is None:
                near &= np.arange(n)[None, :] > rows[:, None]
            i, j = np.nonzero(near)
            i, j = rows[i], j + others.start
            new = ~(self.cells[i, :table] == self.cells[j, :table]).any(axis=1)
            if new.any():
                yield i[new], j[new]


def _packed(x: np.ndarray) -> bytes:
    """In single precision where that is exact."""
    short = x.astype("<f4")
    return b"4" + short.tobytes() if (short.astype(np.float64) == x).all() else b"8" + x.astype("<f8").tobytes()


def _units(rows: list[bytes]) -> np.ndarray:
    m = np.array([np.frombuffer(r, f"<f{r[:1].decode()}", offset=1) for r in rows], np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _read(batches):
    """vec_id, and of usable vectors a digest and the packed components."""
    for b in batches:
        digests, packed = [], []
        lists = b.column("e")
        # null components become NaN; adding zero makes -0 and 0 one
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False) + 0.0
        for null, start, end in zip(lists.is_null().to_pylist(), offsets, offsets[1:], strict=False):
            v = flat[start:end]
            with np.errstate(over="ignore"):
                raw = _packed(v) if not null and np.isfinite(v).all() and v.any() else None
            packed.append(raw)
            digests.append(raw and hashlib.sha256(raw).digest())
        yield pa.record_batch([b.column("vec_id"), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "vec"])


def _encode(batches):
    for b in batches:
        vecs = b.column("vec").to_pylist()
        sizes = np.array([(len(v) - 1) // int(v[:1]) for v in vecs], np.int32)
        out: list = [None] * len(vecs)
        cells = np.zeros((len(vecs), TABLES), np.int32)
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            codes = Codes.of(_units([vecs[k] for k in at]))
            cells[at] = codes.cells
            for k, c in zip(at, codes.packed(), strict=True):
                out[k] = c
        yield pa.record_batch([b.column("id"), pa.array(sizes), pa.array(out, pa.binary()), pa.array(list(cells), pa.list_(pa.int32()))], names=["id", "dim", "code", "cells"])


def _groups(b):
    """Of each group in a batch: its table, its columns in order of part and id, and how many
    rows are of the first of two parts."""
    lists = b.column("all")
    offsets, flat = lists.offsets.to_numpy(), lists.values
    for k in range(b.num_rows):
        t, i, j = (b.column(c)[k].as_py() for c in ("t", "i", "j"))
        rows = flat.slice(offsets[k], offsets[k + 1] - offsets[k])
        own, ids = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("own", "id"))
        order = np.lexsort((ids, own != i))
        yield k, t, rows, order, ids[order], None if i == j else int((own == i).sum())


def _marks(threshold: float):
    """The rows of a cell that have a surviving pair."""

    def run(batches):
        for b in batches:
            at, found = [], []
            for k, t, rows, order, ids, left in _groups(b):
                codes = rows.field("code").to_pylist()
                codes = Codes.unpacked([codes[x] for x in order])
                hit = np.zeros(len(ids), bool)
                for i, j in codes.survivors(t, threshold, left):
                    hit[i] = hit[j] = True
                found += ids[hit].tolist()
                at += [k] * int(hit.sum())
            at = pa.array(at, pa.int64())
            yield pa.record_batch([b.column(c).take(at) for c in ("dim", "t", "key")] + [pa.array(found, pa.int64())], names=["dim", "t", "key", "id"])

    return run


def stars(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, least row of its component) for every row that is not itself the least."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        # hook both ends and their labels to the least, then shorten the paths
        for end in (i, j, before[i], before[j]):
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _verified(threshold: float):
    """(a, null, n): a links with n more vectors; (a, b, null): a and b are of one component."""

    def run(batches):
        for b in batches:
            a, c, n = [], [], []
            for _, t, rows, order, ids, left in _groups(b):
                codes, vecs = (rows.field(x).to_pylist() for x in ("code", "vec"))
                weights = rows.field("w").to_numpy(zero_copy_only=False)[order]
                unit, links, near = _units([vecs[x] for x in order]), np.zeros(len(ids), np.int64), []
                for i, j in Codes.unpacked([codes[x] for x in order]).survivors(t, threshold, left):
                    for at in range(0, len(i), 1 << 16):
                        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                        true = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                        x, y = x[true], y[true]
                        np.add.at(links, x, weights[y])
                        np.add.at(links, y, weights[x])
                        # of these links only what connects: the rest of the group needs no more
                        near.append(stars(len(ids), x, y))
                if near:
                    x, y = stars(len(ids), *(np.concatenate(z) for z in zip(*near, strict=True)))
                    some = np.flatnonzero(links)
                    a += ids[some].tolist() + ids[x].tolist()
                    c += [None] * len(some) + ids[y].tolist()
                    n += links[some].tolist() + [None] * len(x)
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (a, c, n)], names=["a", "b", "n"])

    return run


def _cells(rows: DataFrame, cell: int, *columns: str) -> DataFrame:
    """Groups of the rows (dim, t, key, id, columns) as lists."""
    dealt = in_parts(rows, ["dim", "t", "key"], "id", cell)
    return dealt.groupBy("dim", "t", "key", "i", "j").agg(F.collect_list(F.struct("own", "id", *columns)).alias("all")).where(F.size("all") > 1)


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; see the module's text."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    read = materialise(rows.mapInArrow(_read, "vec_id long, digest binary, vec binary"))
    merged = read.where("digest is not null").groupBy("digest").agg(F.first("vec").alias("vec"), F.count("*").alias("w"), F.min("vec_id").alias("first"))
    distinct = materialise(merged.select(F.monotonically_increasing_id().alias("id"), "*"))
    codes = materialise(distinct.select("id", "vec").mapInArrow(_encode, "id long, dim int, code binary, cells array<int>"))
    spots = codes.select("id", "dim", "code", F.posexplode("cells").alias("t", "key"))
    met = _cells(spots, cell, "code").mapInArrow(_marks(threshold), "dim int, t int, key int, id long")
    marks = materialise(met.distinct())
    whole = marks.join(codes.select("id", "code"), "id").join(distinct.select("id", "vec", "w"), "id")
    found = materialise(_cells(whole, cell, "code", "vec", "w").mapInArrow(_verified(threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null"), "a", "b").select(F.col("node").alias("id"), "component")
    own = distinct.select("id", "digest", "w", "first").join(links, "id", "left").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = own.groupBy("component").agg(F.min("first").alias("least"))
    judged = skew_join(own, least, ["component"], "inner").select("digest", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    out = skew_join(read.select("vec_id", "digest"), judged, ["digest"], "left")
    at = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), at.alias("component_id"), F.col("vec_id").eqNullSafe(at).alias("kept"))
