"""SimHash near-dedup with pivot distance tables.

Each document gets a fingerprint: bit by bit the majority of the XXH64 of its word
shingles. Distinct fingerprints meet in cells. Within a cell the Hamming distances to
reference fingerprints (pivots) are tabulated; as the triangle inequality bounds every
coordinate's difference by the pair's distance, a pair whose largest coordinate difference
exceeds the limit is discarded, and survivors are verified. A cell hands on a spanning
forest of its links, nearest first, never all of them; cells over CELL fingerprints are
cut into pairs of parts, each its own group. Components are found by the distributed star
algorithm.

``simhash_components``: 64 bits, three words, at most three bits apart. Fingerprints that
agree on some two of five bit blocks share a cell (any two that differ in at most three
bits do, for three bits touch at most three blocks), so no link is lost.

``drop_near_copies``: a similarity of 0.8 of the sets of five-word shingles moves about 15 %
of the bits, too many for blocks. Fingerprints, over distinct shingles, have WIDE bits, and
cells are shingle hashes. Of a document's SAMPLE smallest hashes two like documents have at
least SHARED in common (of 16 at similarity 0.8, fewer than 9 once in 5,000 pairs); put in one
order, the rarest in the corpus first, two lists that share so many of them share one before
the last SHARED - 1. A document is in the cells of these only, so that a passage that many
documents hold makes no cell, unless it is most of what they are. This rule is the same at
every size. Pivots are members of the cell, pairs within MARGIN standard deviations of
the bits that the similarity moves are survivors, and their documents are verified: by
the sets of shingle hashes themselves, exactly up to SKETCH distinct shingles, and beyond
by their SKETCH smallest, with a standard error of the similarity of 0.006. Only documents
that have a survivor are read again for that, and of a cell's pairs only those that would
join two of its components are verified, and only in the first cell that both are in.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer
words than a shingle: the whole sequence is the one shingle; a null doc_id keeps a null
id, and a component of such rows only has a null component_id; rows of one doc_id and
several texts are one node of the graph, whose links are those of all its texts; repeated
rows each get the same answer; no documents: no rows; other columns, whatever their
names, are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import ROW, connected_components, fields, give_back, in_parts, materialise, restored, sent_if_few, skew_join, with_row_key, without_rows

SHINGLE, SEED, LIMIT = 3, 42, 3
#: Bit blocks as (first bit, width); a pair within LIMIT bits agrees on BLOCKS - LIMIT of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Most fingerprints of a cell that one group compares.
CELL = 2048
N_PIVOTS = 24
PIVOTS = np.array([[xxhash.xxh64_intdigest(bytes([i]), seed=SEED)] for i in range(N_PIVOTS)], np.uint64)

#: The near-copy stage: words of a shingle, similarity, fingerprint bits, a document's smallest
#: hashes and how many of them like documents share, deviations allowed to the bits, and the
#: hashes by which documents are verified.
NEAR_SHINGLE, SIMILARITY, WIDE, SAMPLE, SHARED, MARGIN, SKETCH = 5, 0.8, 512, 16, 9, 5.0, 4096


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the text's shingles in order, repeats included; none for a text without words."""
    words = data.lower().split()  # on bytes: A-Z only; space, \t, \n, \v, \f, \r
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.fromiter((digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[shingle:], strict=False)), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> bytes:
    """The bits that are set in over half of the rows; a row's words, highest bit first."""
    ones = np.zeros(hashes.shape[1] * 64, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13)].astype(">u8").view(np.uint8).reshape(-1, hashes.shape[1] * 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    return int.from_bytes(majority(shingle_hashes(data, shingle)[:, None]), "big")


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """words hashes of 64 bits from each: the output function of SplitMix64 (fixed values)."""
    x = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_hashes(data: bytes) -> np.ndarray:
    """The near-copy stage's set of a text, in order; a text without words has the hash 0."""
    hashes = np.unique(shingle_hashes(data, NEAR_SHINGLE))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def sketch(data: bytes) -> bytes:
    """The SKETCH smallest of the set, and before them how many it has, as 32-bit numbers."""
    hashes = distinct_hashes(data)
    return np.uint32(len(hashes)).tobytes() + (hashes[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sketches' sets have this similarity."""
    few, many = sorted((int(a[0]), int(b[0])))
    if few < least * many - 1e-9:
        return False
    small, large = sorted((a[1:], b[1:]), key=len)
    both = small[large.take(np.searchsorted(large, small), mode="clip") == small]
    if many <= SKETCH:
        return len(both) >= least * (few + many - len(both)) - 1e-9
    smallest = np.union1d(a[1:], b[1:])[:SKETCH]
    return np.searchsorted(both, smallest[-1], "right") >= least * len(smallest) - 1e-9


def expected_bits(similarity: float = SIMILARITY, bits: int = WIDE) -> int:
    """Differing bits up to which a pair survives: what a pair of this similarity (of sets;
    its cosine follows for sets of one size) differs in on average, and MARGIN standard
    deviations more."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))


@dataclass
class Tally:
    """Pairs in a cell, those that the pivots leave, and those within the limit."""

    pairs: int = 0
    left: int = 0
    near: int = 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; and the column key, if another."""
    names = list(dict.fromkeys(("doc_id", key)))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x.as_py() or b"", shingle) for x in b.column("text").cast(pa.binary())], np.uint64)
            yield pa.record_batch([*map(b.column, names), pa.array(fp.view(np.int64))], names=[*names, "fp"])

    columns = [F.col(c).cast("long").alias(c) for c in names]
    return docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", fp long")


def pivot_table(fps: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Distances of the fingerprints (rows of words) to the pivots: a row a pivot."""
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots])


def members(fps: np.ndarray, n: int = 12) -> np.ndarray:
    """Pivots taken from the fingerprints themselves, spread over their order: where copies
    of some texts crowd, these lie near one crowd and far from the others."""
    return fps[np.unique(np.linspace(0, len(fps) - 1, n).astype(int))]


def near_pairs(fps: np.ndarray, limit: int = LIMIT, left: int | None = None, pivots: np.ndarray = PIVOTS, tally: Tally | None = None):
    """Blocks of index arrays (i, j), i < j, and distances of all pairs within limit bits;
    with left set, only pairs of one of the first ``left`` and one of the rest."""
    n = len(fps)
    table = pivot_table(fps, pivots)
    step = max(1, (1 << 18) // max(n, 1))
    for a in range(0, n if left is None else left, step):
        rows = np.arange(a, min(a + step, n if left is None else left))
        keep = np.arange(n)[None, :] > rows[:, None] if left is None else np.broadcast_to(np.arange(n)[None, :] >= left, (len(rows), n))
        if tally:
            tally.pairs += int(keep.sum())
        i, j = np.nonzero(keep & (np.abs(table[0, rows][:, None] - table[0][None, :]) <= limit))
        i = rows[i]
        for coordinate in table[1:]:
            close = np.abs(coordinate[i] - coordinate[j]) <= limit
            i, j = i[close], j[close]
            if not len(i):
                break
        if not len(i):
            continue
        distance = np.zeros(len(i), np.int16)
        for w in range(fps.shape[1]):
            distance += np.bitwise_count(fps[i, w] ^ fps[j, w])
        true = distance <= limit
        if tally:
            tally.left += len(i)
            tally.near += int(true.sum())
        yield i[true].astype(np.int32), j[true].astype(np.int32), distance[true]


def forest(fps: np.ndarray, limit: int = LIMIT, left: int | None = None, pivots: np.ndarray = PIVOTS) -> list[tuple[int, int]]:
    """Spanning forest of the pairs within limit bits, nearest first, by index."""
    found = list(near_pairs(fps, limit, left, pivots))
    if not found:
        return []
    i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
    label, out = np.arange(len(fps)), []
    for at in np.unique(d):
        x, y = i[d == at], j[d == at]
        while True:
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            if not len(x):
                break
            # one pair a tree, taken in turn: each joins its tree to another, or to one just joined
            _, first = np.unique(label[x], return_index=True)
            for k in first.tolist():
                a, b = label[x[k]], label[y[k]]
                if a != b:
                    label[label == max(a, b)] = min(a, b)
                    out.append((int(x[k]), int(y[k])))
    return out


def _groups(b):
    """Of each group in a batch: its number, its rows in order of part and fingerprint, ids,
    fingerprints, and how many rows are of the first of two parts."""
    lists, i, j = b.column("all"), b.column("i").to_pylist(), b.column("j").to_pylist()
    offsets, flat = lists.offsets.to_numpy(), lists.values
    own, ids = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("own", "id"))
    for k, (x, y) in enumerate(zip(i, j, strict=True)):
        at = slice(offsets[k], offsets[k + 1])
        rows = flat.slice(offsets[k], offsets[k + 1] - offsets[k])
        raw = rows.field("fp").to_pylist()
        fps = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)
        # in order of the fingerprint's first word, the first part's rows before the second's
        order = np.lexsort((ids[at], fps[:, 0], own[at] != x))
        yield k, rows, order, ids[at][order], fps[order], None if x == y else int((own[at] == x).sum())


def _cells(rows: DataFrame, keys: list[str], cell: int, *columns: str) -> DataFrame:
    """Groups of at most about 2 x cell rows (keys, id, columns), as lists."""
    dealt = in_parts(rows, keys, "id", cell)
    return dealt.groupBy(*keys, "i", "j").agg(F.collect_list(F.struct("own", "id", *columns)).alias("all")).where(F.size("all") > 1)


def _compare(rows: DataFrame, limit: int, cell: int) -> DataFrame:
    """Edges (a, b) from rows (key columns t and key, fp as big-endian binary, id): the
    forests of all cells of more than one row."""

    def run(batches):
        for b in batches:
            edges = [(ids[m], ids[n]) for _, _, _, ids, fps, left in _groups(b) for m, n in forest(fps, limit, left)]
            a, c = zip(*edges, strict=True) if edges else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return _cells(rows, ["t", "key"], cell, "fp").select("i", "j", "all").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between the ids of distinct fingerprints (fp, id) that connect all
    within LIMIT bits of each other."""
    spots = []
    for number, kept in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - LIMIT)):
        mask = sum(((1 << BLOCKS[k][1]) - 1) << BLOCKS[k][0] for k in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        spots.append(F.struct(F.lit(number).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(signed)).alias("key")))
    word = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    rows = distinct.select(word.alias("fp"), "id", F.explode(F.array(*spots)).alias("s")).select("fp", "id", "s.t", "s.key")
    return _compare(rows, LIMIT, cell)


def signatures(docs: DataFrame) -> DataFrame:
    """_row, doc_id, same (a digest of the set of shingle hashes), fp and least (its smallest
    hashes) of docs that have a row key."""

    def run(batches):
        for b in batches:
            same, fp, least = [], [], []
            for x in b.column("text").cast(pa.binary()):
                hashes = distinct_hashes(x.as_py() or b"")
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fp.append(majority(_spread(hashes, WIDE // 64)))
                least.append(hashes[:SAMPLE].view(np.int64))
            yield pa.record_batch([b.column(ROW), b.column("doc_id"), pa.array(same, pa.binary()), pa.array(fp, pa.binary()), pa.array(least, pa.list_(pa.int64()))], names=[ROW, "doc_id", "same", "fp", "least"])
        give_back()

    rows = docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{ROW} long, doc_id long, same binary, fp binary, least array<long>")


def near_cells(distinct: DataFrame) -> DataFrame:
    """(key, id): the cells of distinct (id, least). A hash that no other document has in its
    sample stands before all others in the order, and makes no cell."""
    spots = distinct.select("id", F.size("least").alias("m"), F.explode("least").alias("h"))
    shared = spots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    known = skew_join(spots, shared, ["h"], "inner").groupBy("id").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("n", "h"))).alias("found"))
    need = F.least(F.lit(SHARED), F.ceil(F.col("m") * F.lit(SIMILARITY)))
    first = F.greatest(F.lit(0), F.size("found") - need + 1).cast("int")
    keys = F.sort_array(F.transform(F.slice("found", F.lit(1), first), lambda f: f["h"]))
    return known.select("id", keys.alias("keys")).select("id", "keys", F.explode("keys").alias("key"))


def survivors(fps: np.ndarray, keys: np.ndarray, key: int, left: int | None = None):
    """Blocks of pairs (i, j) and distances of a cell that survive and have no cell in common
    that comes before this one; ``keys`` has a row's cells, in order."""
    # a row's place of this cell; what follows it is left out by a number of its own
    before = np.where(keys < key, keys, np.arange(len(keys))[:, None] - (1 << 62))
    width = int((keys < key).sum(axis=1).max(initial=0))
    for i, j, d in near_pairs(fps, expected_bits(), left, members(fps)):
        first = np.ones(len(i), bool)
        for a in range(width):
            own = before[i, a]
            for c in range(width):
                first &= own != before[j, c]
        if first.any():
            yield i[first], j[first], d[first]


def _keys(rows: pa.Array, order: np.ndarray) -> np.ndarray:
    """The rows' cells, filled up with the largest long."""
    lists = rows.field("keys").to_pylist()
    out = np.full((len(order), max(map(len, lists))), 2**63 - 1, np.int64)
    for at, k in enumerate(order):
        out[at, : len(lists[k])] = lists[k]
    return out


def _marks(batches):
    """The rows of a cell that have a survivor."""
    for b in batches:
        at, found, cells = [], [], b.column("key").to_pylist()
        for k, rows, order, ids, fps, left in _groups(b):
            hit = np.zeros(len(ids), bool)
            for i, j, _ in survivors(fps, _keys(rows, order), cells[k], left):
                hit[i] = hit[j] = True
            found += ids[hit].tolist()
            at += [k] * int(hit.sum())
        yield pa.record_batch([b.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["key", "id"])


def verified(found: Iterable, sketches: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the survivors (blocks of i, j, distance) that are similar, by
    index: block by block the nearest fingerprints first, and no pair that is connected already."""
    sizes, label, out = np.array([x[0] for x in sketches], np.int64), np.arange(len(sketches)), []
    for i, j, d in found:
        fit = (np.minimum(sizes[i], sizes[j]) >= SIMILARITY * np.maximum(sizes[i], sizes[j]) - 1e-9) & (label[i] != label[j])
        i, j, d = i[fit], j[fit], d[fit]
        order = np.argsort(d, kind="stable")
        i, j = i[order], j[order]
        for a in range(0, len(i), 1 << 12):
            x, y = i[a : a + (1 << 12)], j[a : a + (1 << 12)]
            apart = label[x] != label[y]
            for m, n in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                p, q = label[m], label[n]
                if p != q and similar(sketches[m], sketches[n]):
                    label[label == max(p, q)] = min(p, q)
                    out.append((m, n))
    return out


def _links(batches):
    for b in batches:
        edges, cells = [], b.column("key").to_pylist()
        for k, rows, order, ids, fps, left in _groups(b):
            raw = rows.field("sketch").to_pylist()
            found = survivors(fps, _keys(rows, order), cells[k], left)
            edges += [(ids[m], ids[n]) for m, n in verified(found, [np.frombuffer(raw[x], np.uint32) for x in order])]
        a, c = zip(*edges, strict=True) if edges else ((), ())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])
    give_back()


def _sketches(batches):
    for b in batches:
        yield pa.record_batch([b.column("id"), pa.array([sketch(x.as_py() or b"") for x in b.column("text").cast(pa.binary())], pa.binary())], names=["id", "sketch"])
    give_back()


def near_links(distinct: DataFrame, texts: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between the ids of distinct (id, fp, least) whose texts (_row, text; an id
    is a _row) are similar."""
    cells = materialise(near_cells(distinct))
    met = _cells(cells.join(distinct.select("id", "fp"), "id"), ["key"], cell, "fp", "keys").select("key", "i", "j", "all")
    marks = materialise(met.mapInArrow(_marks, "key long, id long").distinct())
    whole = sent_if_few(materialise(marks.select("id").distinct()), 32)
    again = texts.select(F.col(ROW).alias("id"), F.col("text").cast("string").alias("text")).join(whole, "id", "left_semi").mapInArrow(_sketches, "id long, sketch binary")
    known = marks.join(distinct.select("id", "fp"), "id").join(materialise(again), "id").join(cells.select("key", "id", "keys"), ["key", "id"])
    return materialise(_cells(known, ["key"], cell, "fp", "keys", "sketch").select("key", "i", "j", "all").mapInArrow(_links, "a long, b long"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = materialise(fingerprints(docs, shingle))
    distinct = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    # rows without any doc_id stand apart: their fingerprint has no id to link by
    linked = distinct.where("first is not null").select("fp", F.col("first").alias("id"))
    parts = connected_components(links(linked), "a", "b").select(F.col("node").alias("first"), "component")
    known = distinct.join(parts, "first", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    return skew_join(found, known, ["fp"], "inner").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """docs with one row of each group of near copies, one that has its smallest doc_id, null
    last. Rows are linked by a key of their own, so rows without a doc_id are linked as well."""
    keyed = with_row_key(docs)
    rows = materialise(signatures(fields(keyed, "doc_id", "text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", ROW)).alias("first")
    distinct = materialise(rows.groupBy("same").agg(first, F.first("fp").alias("fp"), F.first("least").alias("least")).withColumn("id", F.col(f"first.{ROW}")))
    edges = near_links(distinct, fields(keyed, "text"), cell)
    parts = connected_components(edges, "a", "b").select(F.col("node").alias("id"), "component")
    stays = distinct.select("id", "first").join(parts, "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("first").alias("first"))
    dropped = rows.select(ROW).join(stays.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_anti")
    return restored(without_rows(keyed, materialise(dropped)))
