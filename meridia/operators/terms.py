"""Terms of a table found in texts: whole words, however many terms, in one pass a text.

Texts and terms are brought to one normal form (folded, words set apart by single blanks),
so that a term is found where it stands between blanks. The terms' automaton (Aho and
Corasick) finds all of them, overlapping ones too, as it walks a text once. It is built in
each task from the terms, which are sent round as long as they are few: more than
SHARD_BYTES of them are dealt into shards, each with a pass of its own, and more than MOST_SHARDS
shards are not sent at all: then the texts' runs of words are joined with the terms, an
equality by hash that Spark deals out.

A null text holds nothing, a term without letters or digits is left out, of several ids of
one term each gets its hits; repeated texts count by their keys' rows."""

from __future__ import annotations

from collections.abc import Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions import text as tx
from meridia.operators.shared import materialise

SHARD_BYTES, MOST_SHARDS = 1 << 20, 8


def normal_terms(terms: DataFrame, term: str) -> DataFrame:
    """The distinct normal forms, t, of a term table."""
    return terms.select(tx.normalise(F.col(term)).alias("t")).where("t <> ''").distinct()


def _automaton(words: Sequence[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(f" {w} ", w)
    out.make_automaton()
    return out


def _passes(texts: DataFrame, words: Sequence[str]) -> DataFrame:
    """_k, t, hits, first of the words found in each text (_k, _t)."""
    sent = texts.sparkSession.sparkContext.broadcast(list(words))

    def run(batches):
        automaton = _automaton(sent.value)
        for b in batches:
            keys, found, hits, first = [], [], [], []
            for k, t in zip(b.column("_k").to_pylist(), b.column("_t").to_pylist(), strict=True) if sent.value else ():
                own: dict[str, list[int]] = {}
                for end, w in automaton.iter(f" {t} ") if t else ():
                    # ends come in order, so a term's first hit is its first place
                    own.setdefault(w, [0, end - len(w)])[0] += 1
                keys += [k] * len(own)
                found += own
                hits += [h for h, _ in own.values()]
                first += [f for _, f in own.values()]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(found, pa.string()), pa.array(hits, pa.int64()), pa.array(first, pa.int64())], names=["_k", "t", "hits", "first"])

    return texts.mapInArrow(run, "_k long, t string, hits long, first long")


def _joined(texts: DataFrame, words: DataFrame) -> DataFrame:
    """As _passes, by an equality of runs of words with the terms (t)."""
    sized = words.withColumn("n", F.size(F.split("t", " ")))
    lengths = [r["n"] for r in sized.select("n").distinct().collect()]  # a few: words of a term
    w = texts.where("_t <> ''").select("_k", F.split("_t", " ").alias("w"))
    out = None
    for n in lengths:
        part = w.where(F.size("w") >= n).select("_k", F.posexplode(_runs(n)).alias("place", "t"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return texts.select("_k", F.lit("").alias("t"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("first")).limit(0)
    # a run's place among the words becomes one among the characters
    hit = out.join(words, "t").groupBy("_k", "t").agg(F.count("*").alias("hits"), F.min("place").alias("place"))
    before = F.aggregate(F.slice("w", F.lit(1), F.col("place")), F.lit(1).cast("long"), lambda s, x: s + F.length(x) + 1)
    return hit.join(w, "_k").select("_k", "t", "hits", before.alias("first"))


def _runs(n: int):
    return F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))


def match_terms(texts: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, term: str, shard_bytes: int = SHARD_BYTES, most_shards: int = MOST_SHARDS) -> DataFrame:
    """The texts' keys, the terms' other columns and term, hits and first (the place of the
    first hit in the normal form, from 1), a row for each text and term found in it."""
    named = terms.withColumn("t", tx.normalise(F.col(term))).where("t <> ''")
    words = materialise(named.select("t").distinct())
    size = words.agg(F.sum(F.octet_length("t") + 2).alias("n")).first()["n"] or 0
    rows = materialise(texts.select(F.monotonically_increasing_id().alias("_k"), *keys, tx.normalise(F.col(text)).alias("_t")))
    shards = -(-size // shard_bytes)
    if shards > most_shards:
        found = _joined(rows.select("_k", "_t"), words)
    else:
        dealt = words.withColumn("_s", F.pmod(F.xxhash64("t"), F.lit(max(1, shards))))
        found = None
        for k in range(max(1, shards)):
            # at most about shard_bytes of terms
            part = _passes(rows.select("_k", "_t"), [r["t"] for r in dealt.where(F.col("_s") == k).select("t").collect()])
            found = part if found is None else found.unionByName(part)
    return found.join(rows.drop("_t"), "_k").join(named, "t").drop("t", "_k").select(*keys, *terms.columns, "hits", "first")
