"""Scores of candidates and transitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Costs in natural logarithms.
CORRECTION_COST = {"exact": 0.0, "swap": 2.25, "neighbour": 2.75, "missing": 3.0, "extra": 3.0}
CORRECTION_RANK = {"exact": 0, "swap": 1, "neighbour": 2, "missing": 3, "extra": 4}
ABBREVIATION_COST, LITERAL_COST = 0.85, 8.0
UNIGRAM_SHARE, BIGRAM_SHARE, SMOOTHING = 0.35, 0.65, 0.5


def _of(kind: Column, values: dict) -> Column:
    case = F.when(kind == next(iter(values)), F.lit(next(iter(values.values()))))
    for name, value in list(values.items())[1:]:
        case = case.when(kind == name, F.lit(value))
    return case


def correction_cost(kind: Column) -> Column:
    return _of(kind, CORRECTION_COST)


def correction_rank(kind: Column) -> Column:
    return _of(kind, CORRECTION_RANK)


def word_score(frequency: Column, kind: Column, abbreviated: Column) -> Column:
    return F.round(F.ln(frequency) - correction_cost(kind) - ABBREVIATION_COST * abbreviated, 9)


def conditional(count: Column, total: Column, vocabulary: Column | int, alpha: float = SMOOTHING) -> Column:
    """ln of the smoothed probability of a transition."""
    vocabulary = F.lit(vocabulary) if isinstance(vocabulary, int) else vocabulary
    return F.ln((F.coalesce(count, F.lit(0)) + alpha) / (F.coalesce(total, F.lit(0)) + alpha * vocabulary))


def boost(count: Column) -> Column:
    """Steps that a personal count lifts a word: 0, 1, 2 (twice or thrice), 3."""
    return F.when(count >= 4, 3).when(count >= 2, 2).when(count >= 1, 1).otherwise(0)


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
