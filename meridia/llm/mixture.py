"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length. A source's target is met by
whole copies of all its documents and, for what remains, a choice of how many documents of
each length to add: most of the budget in proportion, the next part from the longest
lengths down, and the last few words by a bounded-knapsack dynamic programme. The counts
then pick documents in seeded hash order, each length's own: of the doc_id's hash, then of a
row's own. Where the order is cut is found by counting, digit by digit of these hashes, and
only the last handful of rows, BUCKET at most, is ranked. A row then tells by itself
whether it is taken; in the pipeline no text moves for it.

Targets: weights repeat over the sources in code point order, null last; a target above
``cap`` times its source's size is cut to it and the excess reshared by weight, until none
is above. The rounds are small aggregates over the sources; only two sums reach the driver.

Defined cases: a null text has size 0; documents of size 0 count but are never taken; no
words at all: targets are 0; rows of one doc_id (or of none) and one size go by a hash of
their own, so that any number of them is split as others are, and a rerun takes the same
number of them; a text of any length counts whole; no documents: no rows; other columns,
whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.common import DOC, ROW, WORD, materialise, sent_if_few, skew_join, with_row_key

WEIGHTS, TOTAL, CAP, SEED = (5, 2, 1), 1.5, 2, 42
#: Words that are left to the dynamic programme, rows that are ranked at most, and bits of a digit.
EXACT, BUCKET, DIGIT = 4096, 1024, 12


def fit_budget(lengths: Sequence[int], counts: Sequence[int], budget: int, exact: int = EXACT) -> list[int]:
    """How many documents of each length to take: at most counts, at most budget words
    in all, and as near to it as the last stage can reach."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [0] * len(lengths)
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return [c if n else 0 for n, c in zip(lengths, counts, strict=True)]
    aside = min(budget, exact)
    for i, (n, c) in enumerate(zip(lengths, counts, strict=True)):
        take[i] = c * (budget - aside) // total if n else 0
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    for i in sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i]):
        if left <= exact:
            break
        more = min(counts[i] - take[i], (left - exact) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    # Bounded knapsack over the sums up to what is left, one bit a sum; each sum keeps the
    # item that reached it first, and the rest of it was reached by items before that.
    reach, mask, by = 1, (1 << (left + 1)) - 1, {}
    for i in sorted((i for i, n in enumerate(lengths) if 0 < n <= left), key=lambda i: -lengths[i]):
        room, k = min(counts[i] - take[i], left // lengths[i]), 1
        while room and not reach >> left & 1:
            k = min(k, room)
            new = reach << k * lengths[i] & mask & ~reach
            reach |= new
            while new:
                s = new & -new
                by[s.bit_length() - 1] = (i, k)
                new ^= s
            room, k = room - k, k * 2
        if reach >> left & 1:
            break
    s = reach.bit_length() - 1
    while s:
        i, k = by[s]
        take[i] += k
        s -= k * lengths[i]
    return take


def size_of(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string") if isinstance(text, str) else text, F.lit(WORD.replace(r"\x20\x09-\x0D", " \t-\r"))), F.lit(0)).cast("long")


def hashes(doc_id: Column, row: Column, seed: int) -> list[Column]:
    """The order in which rows of one length are taken: h of the doc_id, r of the row."""
    return [F.xxhash64(doc_id.cast("long"), F.lit(seed)).alias("h"), F.xxhash64(row, F.lit(seed)).alias("r")]


def targets(by_source: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source."""
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    # one row a source: the only global order here
    placed = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    state = materialise(placed.select("source", "source_size", pick.alias("weight"), F.lit(None).cast("double").alias("target")))
    words = state.agg(F.sum("source_size")).first()[0] or 0
    goal = total * words
    while True:
        free = F.col("target").isNull()
        used, weight = state.agg(F.sum("target"), F.sum(F.when(free, F.col("weight")))).first()
        if not weight:
            return state.select("source", "source_size", "target")
        share = (goal - (used or 0.0)) / weight
        most = F.col("source_size") * F.lit(float(cap))
        above = free & (F.col("weight") * F.lit(share) > most)
        if not state.where(above).limit(1).count():
            return state.select("source", "source_size", F.coalesce("target", F.col("weight") * F.lit(share)).alias("target"))
        state = materialise(state.withColumn("target", F.when(above, most).otherwise(F.col("target"))))


def _fit(seed_free: pd.DataFrame) -> pd.DataFrame:
    rows = seed_free.sort_values("size", ascending=False)
    whole, left = int(rows["whole"].iloc[0]), int(rows["budget"].iloc[0])
    rows["extra"] = fit_budget(rows["size"].tolist(), rows["n"].tolist(), left)
    return rows[["source", "size", "n", "extra"]].assign(whole=whole)


def plan(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP) -> DataFrame:
    """source, size, source_size, target, whole, h, r from rows (source, size, h, r): each
    document of the size is taken ``whole`` times, and once more where its hashes are not above
    (h, r); where these are null, never."""
    counts = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = materialise(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, total, cap))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    budgets = goals.withColumn("whole", whole).withColumn("budget", F.when(F.col("whole") < cap, F.floor(F.col("target") - F.col("whole") * F.col("source_size"))).otherwise(0).cast("long"))
    asked = skew_join(counts, budgets.select("source", "whole", "budget"), ["source"], "inner")
    # a group holds a source's distinct lengths, no more than its longest document has words
    fitted = materialise(asked.groupBy("source").applyInPandas(_fit, "source string, size long, n long, extra long, whole long"))
    ends = _ends(sized, fitted.where("extra > 0 and extra < n"))
    known = skew_join(skew_join(fitted, goals, ["source"], "inner"), ends, ["source", "size"], "left")
    last = lambda c: F.when(F.col("extra") == F.col("n"), F.lit(2**63 - 1)).otherwise(F.col(c)).alias(c)
    return materialise(known.select("source", "size", "source_size", "target", "whole", last("h"), last("r")))


def _ends(sized: DataFrame, cut: DataFrame) -> DataFrame:
    """source, size, h, r: the hashes of the last of the ``extra`` rows of each length that
    comes first in their order."""
    group = ["source", "size"]
    open_ = cut.select(*group, "n", "extra")
    rows = materialise(skew_join(sized.select(*group, "h", "r"), open_, group, "inner"))
    done = None
    for level in range(2 * (64 // DIGIT) + 1):
        small = rows.where(F.col("n") <= BUCKET)
        done = small if done is None else done.unionByName(small)
        rows = rows.where(F.col("n") > BUCKET)
        if level == 2 * (64 // DIGIT) or not rows.limit(1).count():
            # rows that no digit tells apart would have both hashes in common
            done = done.unionByName(rows)
            break
        c, place = ("h", level) if level < 64 // DIGIT else ("r", level - 64 // DIGIT)
        digit = F.shiftrightunsigned(F.col(c).bitwiseXOR(F.lit(-(2**63))), 64 - DIGIT * (place + 1)).bitwiseAND(F.lit(2**DIGIT - 1))
        rows = rows.withColumn("digit", digit)
        counted = rows.groupBy(*group, "digit").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # at most 2^DIGIT rows a length
        at = counted.withColumn("before", before).where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("m")))
        told = at.select(*group, "digit", "m", (F.col("extra") - F.col("before")).alias("left"))
        rows = materialise(skew_join(rows, told, [*group, "digit"], "inner").select(*group, "h", "r", F.col("m").alias("n"), F.col("left").alias("extra")))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("h", "r"))
    return done.withColumn("rank", rank).where(F.col("rank") == F.col("extra")).select(*group, "h", "r")


def copies(h: Column, r: Column) -> Column:
    """How often a row of these hashes is taken, by its length's line of the plan."""
    more = (h < F.col("_r_h")) | ((h == F.col("_r_h")) & (r <= F.col("_r_r")))
    return F.when(F.col("size") > 0, F.col("whole") + F.coalesce(more.cast("long"), F.lit(0))).otherwise(0)


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: one row a document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of("text").alias("size"))
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    sized = numbered.select("doc_id", "source", "size", *hashes(F.col("doc_id"), F.col("row"), seed))
    asked = plan(sized, weights, total, cap).withColumnsRenamed({"h": "_r_h", "r": "_r_r"})
    out = skew_join(sized, asked, ["source", "size"], "inner").withColumn("copies", copies(F.col("h"), F.col("r")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs as the mix takes them: a document taken twice is there twice, one not taken
    is not. Columns are docs'. Each row is there by its own copies, whatever its doc_id. The
    plan goes to the rows, unless it is too large to send."""
    keyed = with_row_key(docs)
    own = [F.col("doc.source").cast("string").alias("source"), size_of(F.col("doc.text").cast("string")).alias("size"), *hashes(F.col("doc.doc_id"), F.col(ROW), seed)]
    sized = keyed.withColumnRenamed(DOC, "doc").select(ROW, *own)
    asked = sent_if_few(plan(materialise(sized)), 200).select("source", "size", "whole", F.col("h").alias("_r_h"), F.col("r").alias("_r_r"))
    whole = keyed.withColumnRenamed(DOC, "doc").select("doc", *own)
    taken = skew_join(whole, asked, ["source", "size"], "inner").withColumn("copies", copies(F.col("h"), F.col("r")).cast("int")).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
