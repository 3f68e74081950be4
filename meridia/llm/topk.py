"""Exact top-k search by columnar branch-and-bound.

Vectors become integer vectors, floor(256 x) by component. Candidates are held in
vertical layout, one row a dimension; scores accumulate dimension block by dimension
block. After each block a candidate's score is bounded by what it has plus the product of
the remaining masses (the norms over the dimensions to come, by Cauchy-Schwarz);
candidates that cannot reach the k-th best score so far are dropped and the survivors
compacted. Bounds are widened by one, so that rounding never drops a tie. The k-th best
score starts from what the query finds among SEED_ROWS vectors, any of the table's, sent to
all tasks: a bound that holds for the whole table, whichever they are. Dimensions are taken
in the order of their mass in these vectors, so that little is left early. Bounds are
computed with components scaled to one at most, so that no square overflows; scores are
whole numbers, past 2^53 of any size.

Candidates are packed into blocks of at most CANDIDATE_BLOCK rows and BLOCK_BYTES, and
HELD blocks make a group. Queries, every vector whose id is divisible by ``every``, go as rows
to every group and are scanned against it in blocks of QUERY_BLOCK; none passes through the
driver. A first wave covers every WAVE-th group; what its queries have found by then bounds
the rest. Each group hands on its k best by query that may still count, and these are merged
by query and candidate row.

Defined cases: vectors that are null, empty, or hold null or non-finite components, or
that have a null id, take no part; a candidate of another length than the query's is no
candidate; rows with the query's own id are its own; a query id on several rows gets the
best over these rows, each candidate row once; repeated candidate rows count one by one;
no candidates: no rows; a score beyond the range of a long is given as that end of it, and
such scores tie; a component whose 256-fold is past the largest double becomes that; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import struct
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import ROW, fields, materialise, met_in_groups, with_row_key

K, EVERY, SCALE = 5, 50, 256
DIMENSIONS, QUERY_BLOCK, CANDIDATE_BLOCK, BLOCK_BYTES, HELD, WAVE, SEED_ROWS = 16, 1024, 4096, 2 << 20, 16, 16, 512
LEAST, MOST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, q) and the other columns: integer vectors as arrays of double, which holds them exactly."""
    e = F.col(embedding).cast("array<double>")
    q = F.transform("e", _floor)
    also = [c for c in vectors.columns if c not in (vec_id, embedding)]
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e"), *also).where(F.col("vec_id").isNotNull() & F.coalesce(_sound("e"), F.lit(False))).select("vec_id", q.alias("q"), *also)


def _sound(c: str):
    return (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _floor(x):
    # x * 256 only shifts the exponent; floor() of a double past 2^63 would wrap, and such a double is whole
    largest = F.lit(sys.float_info.max)
    scaled = F.greatest(F.least(x * F.lit(float(SCALE)), largest), -largest)
    return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled).cast("double")).otherwise(scaled)


def _matrix(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each vector length in a batch."""
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((rows, flat[offsets[rows][:, None] + np.arange(n)]))
    return out


def _typed(queries: np.ndarray, candidates: np.ndarray):
    """Both in the narrowest type whose sums are exact: float32, float64, or Python's ints."""
    tops = [float(np.abs(m).max(initial=0)) for m in (queries, candidates)]
    top = max(*tops, tops[0] * tops[1] * max(1, queries.shape[1]))
    if top < 2**24:
        return queries.astype(np.float32), candidates.astype(np.float32)
    if top < 2**53:
        return queries, candidates
    whole = np.frompyfunc(int, 1, 1)
    return whole(queries), whole(candidates)


def _longs(scores: np.ndarray) -> np.ndarray:
    """As longs; what lies beyond their range becomes its end."""
    if scores.dtype == object:
        return np.array([min(MOST, max(LEAST, int(s))) for s in scores], np.int64)
    return scores.astype(np.int64)


class Best:
    """The k best candidates so far of each query of a block. ``floors`` are scores that
    each query's k-th best is known to reach; ``scored`` counts, by dimension block, the
    candidates that were still alive in it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.floors = np.full(len(ids), LEAST) if floors is None else floors
        self.found: list[list[tuple]] = [[] for _ in ids]  # (-score, vec_id, row), sorted
        self.scored = np.zeros(-(-vectors.shape[1] // DIMENSIONS), np.int64)

    def scan(self, ids: np.ndarray, rows: np.ndarray, candidates: np.ndarray) -> None:
        q, x = _typed(self.vectors, candidates)
        n = q.shape[1]
        x = np.ascontiguousarray(x.T)
        starts = list(range(0, n, DIMENSIONS))
        # bounds are held in units of the largest query component times the largest candidate component
        tops = [max(1.0, float(np.abs(m).max(initial=0))) for m in (self.vectors, candidates)]
        squares = [np.square(m.T / top) for m, top in zip((self.vectors, candidates), tops, strict=True)]
        left_q, left_x = (np.sqrt(np.array([s[a + DIMENSIONS :].sum(axis=0) for a in starts])) for s in squares)
        unit = int(tops[0]) * int(tops[1])

        def scaled(score):
            if score.dtype == object:
                return np.array([int(s) / unit for s in score], np.float64)
            return np.asarray(score, np.float64) / tops[0] / tops[1]

        first = q[:, :DIMENSIONS] @ x[:DIMENSIONS]
        for k, own in enumerate(self.ids):
            best = self.found[k]
            floor = max(int(self.floors[k]), -best[self.k - 1][0] if len(best) >= self.k else LEAST)
            # rounding must not drop a tie: the floor goes a little lower, bounds a little higher
            least = floor / unit - abs(floor / unit) * 1e-12
            at, score = None, first[k]
            for b, a in enumerate(starts):
                if b:
                    score = score + q[k, a : a + DIMENSIONS] @ (x[a : a + DIMENSIONS] if at is None else x[a : a + DIMENSIONS, at])
                self.scored[b] += len(score)
                if floor == LEAST:
                    continue
                near = scaled(score)
                bound = near + left_q[b, k] * (left_x[b] if at is None else left_x[b, at]) * (1 + 1e-9) + np.abs(near) * 1e-12
                stay = np.flatnonzero(bound >= least)
                if len(stay) < len(bound):
                    at, score = (stay if at is None else at[stay]), score[stay]
                if not len(score):
                    break
            if not len(score):
                continue
            names, numbers = (ids, rows) if at is None else (ids[at], rows[at])
            others = names != own
            names, numbers, score = names[others], numbers[others], _longs(score[others])
            if len(score) > self.k:
                cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
                near = score >= cut
                names, numbers, score = names[near], numbers[near], score[near]
            best += [(-int(s), int(i), int(r)) for s, i, r in zip(score, names, numbers, strict=True)]
            best.sort()
            del best[self.k :]

    def kth(self) -> np.ndarray:
        """Each query's k-th best score so far; the least long where it has fewer."""
        return np.array([-f[self.k - 1][0] if len(f) >= self.k else LEAST for f in self.found], np.int64)


@dataclass
class Seeds:
    """Some of the table's vectors, by length: ids, vectors, order of the dimensions."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list) -> Seeds:
        out = {}
        for n in {len(r["q"]) for r in rows}:
            m = np.array([r["q"] for r in rows if len(r["q"]) == n], np.float64)
            order = np.argsort(-np.square(m / max(1.0, np.abs(m).max())).sum(axis=0), kind="stable")
            out[n] = np.array([r["vec_id"] for r in rows if len(r["q"]) == n], np.int64), m, order
        return Seeds(out)

    def order(self, n: int) -> np.ndarray:
        return self.by_length[n][2] if n in self.by_length else np.arange(n)

    def floors(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
        if vectors.shape[1] not in self.by_length:
            return np.full(len(ids), LEAST)
        names, m, _ = self.by_length[vectors.shape[1]]
        block = Best(ids, vectors, k)
        block.scan(names, np.arange(len(names)), m)
        return block.kth()


def _packer(sent):
    """Blocks of candidates of one length, dimensions by mass, as bytes."""

    def run(batches):
        seeds = sent.value
        for b in batches:
            ids, numbers = b.column("vec_id").to_numpy(), b.column(ROW).to_numpy()
            out = []
            for rows, m in _matrix(b.column("q")):
                m = m[:, seeds.order(m.shape[1])]
                step = max(1, min(CANDIDATE_BLOCK, BLOCK_BYTES // (8 * m.shape[1])))
                for a in range(0, len(rows), step):
                    part, at = m[a : a + step], rows[a : a + step]
                    kind = next((t for t in (np.int16, np.int32) if np.abs(part).max(initial=0) <= np.iinfo(t).max), np.float64)
                    out.append(struct.pack("<qqq", *part.shape, np.dtype(kind).itemsize) + ids[at].tobytes() + numbers[at].tobytes() + part.astype(kind).tobytes())
            yield pa.record_batch([pa.array(out, pa.binary())], names=["block"])

    return run


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, row numbers, vectors"""
    n, d, size = struct.unpack("<qqq", block[:24])
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[size]
    return np.frombuffer(block, np.int64, n, 24), np.frombuffer(block, np.int64, n, 24 + 8 * n), np.frombuffer(block, kind, n * d, 24 + 16 * n).reshape(n, d).astype(np.float64)


def _searched(sent, k: int):
    """Each query's k best of a group's blocks; a group's blocks come before its queries."""

    def run(batches):
        seeds, group, blocks = sent.value, None, []

        def against(ids, vectors, floors):
            order = seeds.order(vectors.shape[1])
            best = Best(ids, vectors[:, order], k, np.maximum(floors, seeds.floors(ids, vectors, k)))
            for names, numbers, m in blocks:
                if m.shape[1] == vectors.shape[1]:
                    best.scan(names, numbers, m)
            return [(int(q), i, r, -s) for q, got in zip(ids, best.found, strict=True) for s, i, r in got]

        for b in batches:
            groups, raw = b.column("g").to_numpy(), b.column("block")
            held = raw.is_valid().to_numpy(zero_copy_only=False)
            # stretches of one group's blocks or of its queries
            cuts = (np.flatnonzero((np.diff(groups) != 0) | (held[1:] != held[:-1])) + 1).tolist()
            for a, e in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                if a == e:
                    continue
                if groups[a] != group:
                    group, blocks = groups[a], []
                if held[a]:
                    blocks += [_unpack(x.as_py()) for x in raw[a:e]]
                    continue
                part = b.slice(a, e - a)
                ids, floors, rows = part.column("query_id").to_numpy(), part.column("floor").to_numpy(), []
                for at, m in _matrix(part.column("q")):
                    for x in range(0, len(at), QUERY_BLOCK):
                        own = at[x : x + QUERY_BLOCK]
                        rows += against(ids[own], m[x : x + QUERY_BLOCK], floors[own])
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", ROW, "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for each query; see the module's text."""
    spark = vectors.sparkSession
    # a row keeps its number in every scan
    all_vectors = usable(fields(with_row_key(vectors.select("vec_id", "embedding")), "vec_id", "embedding"))
    seeds = spark.sparkContext.broadcast(Seeds.of(all_vectors.select("vec_id", "q").limit(SEED_ROWS).collect()))
    blocks = materialise(all_vectors.mapInArrow(_packer(seeds), "block binary").withColumn("number", F.monotonically_increasing_id()))
    groups = max(1, -(-blocks.count() // HELD))
    dealt = blocks.select(F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int").alias("g"), "block")
    queries = all_vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "q", F.lit(LEAST).alias("floor"))
    every_group, in_first = F.sequence(F.lit(0), F.lit(groups - 1)), F.col("g") % WAVE == 0
    out = f"query_id long, vec_id long, {ROW} long, score long"
    found = met_in_groups(dealt.where(in_first), queries, F.filter(every_group, lambda g: g % WAVE == 0), groups).mapInArrow(_searched(seeds, k), out)
    if groups > 1:
        found = materialise(_best(found, k).drop("rank"))
        known = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        told = queries.join(known, "query_id", "left").select("query_id", "q", F.coalesce("least", "floor").alias("floor"))
        rest = met_in_groups(dealt.where(~in_first), told, F.filter(every_group, lambda g: g % WAVE != 0), groups)
        found = found.unionByName(rest.mapInArrow(_searched(seeds, k), out))
    return _best(found, k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    # a query id on several rows has a candidate row once, at its best score
    found = found.groupBy("query_id", "vec_id", ROW).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", ROW)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
