"""Filter interaction audit by the potential of Hart and Mas-Colell.

Five filters may each remove a document; which of them gets the credit depends on the
order they run in. A removal game says, for each of the 32 coalitions of filters, how many
documents at least one of its filters fails: v(S). Its potential is built up recursively,

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,    P(empty) = 0,

and a filter's Shapley value is P(all) - P(all without it). Held 120-fold, P stays whole,
and the value is what the filter removes, summed over all 120 orders. What a filter removes
as the next of an order is v(filters so far and it) - v(filters so far), so that the same
32 numbers give every step of every order; nothing is run 120 times.

The scan: one pass over the texts makes a mask of five bits a document, with a digest of
its text for the filter on repeated texts. Texts themselves are never shuffled; digests
are, to find the smallest doc_id of each (a partial minimum by task, then a join that splits
crowded digests). Documents are then counted by part and mask, at most 32 rows a part.

Filters, over words ``[^\\x20\\x09-\\x0D]+``: A under 200 words; B 100 x distinct words under
50 x words; C 100 x ``[A-Z]`` characters over 2 x code points; D any of ``#$%&*|``; E the
text of a smaller doc_id, wherever in the table and whether removed or not.

Defined cases: a null text is empty (A fails, and E with the smallest doc_id of empty texts
apart); a null doc_id is never smaller than another, and its row never fails E; rows of one
doc_id and text fail E together or not at all; a null part counts as the empty string, with
parts so named; a document with several labels is good (toxic) if any of them says so, one
without is neither; null labels, and labels of a null doc_id, say nothing; no documents: no rows; other columns, whatever
their names, are left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import materialise, skew_join, text_or_empty

FILTERS = "ABCDE"
#: What separates words, and the thresholds of the filters (fixed values).
GAP, LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = r"[\x20\x09-\x0D]+", 200, 50, 2, "[#$%&*|]"
ALL = (1 << len(FILTERS)) - 1
#: Orders of the filters; also what the potential is multiplied by to stay whole.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("n", "good", "toxic")


def masks(docs: DataFrame, part: str) -> DataFrame:
    """doc_id, part, digest and mask (bit k: fails the k-th filter; E's bit is not set yet)."""
    text = text_or_empty("text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    # bound once: a lambda's argument is computed a single time a row
    fails = F.transform(
        F.array(F.struct(words.alias("w"))),
        lambda x: _bit(0, F.size(x["w"]) < LEAST_WORDS) + _bit(1, 100 * F.size(F.array_distinct(x["w"])) < LEAST_DISTINCT * F.size(x["w"])),
    )[0]
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    mask = fails + _bit(2, 100 * capitals > MOST_CAPITALS * F.length("text")) + _bit(3, F.col("text").rlike(MARKS))
    return read.select("doc_id", "part", F.sha2("text", 256).alias("digest"), mask.cast("int").alias("mask"))


def _bit(k: int, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << k)).otherwise(F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the set of filters they fail."""
    seen = materialise(masks(docs, part))
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    whole = skew_join(skew_join(seen, first, ["digest"], "inner"), told, ["doc_id"], "left")
    repeats = _bit(4, F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)))
    return whole.groupBy("part", (F.col("mask") + repeats).alias("mask")).agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS[1:]])


def removal_games(counts: DataFrame) -> DataFrame:
    """part, total, n, good, toxic (v(S) for each coalition S of 0 to 31, a bit a filter) and
    potential (120 P(S)). A part's rows are at most 32."""
    rows = counts.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", *COUNTS)).alias("rows"))
    return rows.select("part", "total", *[_game(c).alias(c) for c in COUNTS]).select("*", _potential(F.col("n")).alias("potential"))


def _game(count: str) -> Column:
    """v(S) for S from 0 up: what any of its filters removes."""

    def removed(s: Column) -> Column:
        return F.aggregate("rows", F.lit(0).cast("long"), lambda total, r: total + F.when(r["mask"].bitwiseAND(s) != 0, r[count]).otherwise(F.lit(0)))

    return F.transform(F.sequence(F.lit(0), F.lit(ALL)), removed)


def _potential(v: Column) -> Column:
    """120 P(S) for S from 0 up: a coalition's parts come before it."""
    scale, singles = len(ORDERS), F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])

    def step(done: Column, s: Column) -> Column:
        without = F.transform(F.filter(singles, lambda i: s.bitwiseAND(i) != 0), lambda i: F.element_at(done, 1 + s - i))
        below = F.aggregate(without, F.lit(0).cast("long"), lambda sum_, p: sum_ + p)
        # the division leaves nothing: 120 P(S) is a sum of v(T) times whole numbers
        whole = F.call_function("div", F.lit(scale) * F.element_at(v, s + 1) + below, F.bit_count(s))
        return F.concat(done, F.array(whole))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), step)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step; see the module's text."""
    games = removal_games(mask_counts(docs, labels, part))
    orders = games.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substr(filter_order, {{}}, 1)) - 1)"
    before = f"aggregate(filter(sequence(1, {len(FILTERS)}), k -> k < step), 0, (m, k) -> m + {bit.format('k')})"
    rows = orders.withColumns({"own": F.expr(bit.format("step")), "before": F.expr(before)})
    after = F.col("before") + F.col("own")
    gain = lambda c: F.col(c)[after] - F.col(c)[F.col("before")]
    removed = gain("n")
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.col("n")[after]).alias("kept"),
        removed.alias("removed"),
        (F.col("n")[F.col("own")] - removed).alias("redundant"),
        (F.col("n")[ALL] - F.col("n")[F.lit(ALL) - F.col("own")]).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.col("potential")[ALL] - F.col("potential")[F.lit(ALL) - F.col("own")]).alias("shapley"),
    )
