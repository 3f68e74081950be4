"""Ordered rules: tags, decision lists, values with their basis, reasons of refusal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of the rules whose pattern the text matches, in the rules' order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in rules]))


def decision_list(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule that holds wins."""
    out = F.lit(otherwise)
    for condition, label in reversed(rules):
        out = F.when(condition, label).otherwise(out)
    return out


def coalesce_with_basis(*sources: tuple[str, Column]) -> Column:
    """struct<value, basis>: the first value that is there, and where it is from."""
    basis = F.lit(None).cast("string")
    for name, c in reversed(sources):
        basis = F.when(c.isNotNull(), name).otherwise(basis)
    return F.struct(F.coalesce(*[c for _, c in sources]).alias("value"), basis.alias("basis"))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """All reasons that hold, in order, joined; empty if none does."""
    return F.array_join(F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in rules])), "; ")


def first_signal(c: Column, signals: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """struct<signal, confidence>: the first signal that the text holds."""
    out = F.struct(F.lit("").alias("signal"), F.lit(otherwise).alias("confidence"))
    for signal, confidence in reversed(signals):
        out = F.when(c.contains(signal), F.struct(F.lit(signal).alias("signal"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def layer_score(weights: Column, factor: Column) -> Column:
    """Mean weight of the known layers, times a factor; null if none is known."""
    known = F.filter(weights, lambda w: w.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, w: a + w) / F.size(known) * factor)


def gate(provisional: Column, confident: Column) -> Column:
    """Whether a row may be used: not provisional, and confident; null counts against it."""
    return ~F.coalesce(provisional, F.lit(True)) & F.coalesce(confident, F.lit(False))
