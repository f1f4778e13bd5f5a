"""Labels, weights and gains of a candidate by its true rank (0 or null: not in the truth)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gain of each relevance level, from 0.
GAINS = (0, 1, 3, 5, 7, 10, 14, 19, 25, 32, 40, 50)


def _stepped(rank: Column, *steps: tuple[int, float], otherwise: float = 0) -> Column:
    """The value of the first step whose rank is not passed, for ranks from 1."""
    out = F.when(F.coalesce(rank, F.lit(0)) < 1, otherwise)
    for most, value in steps:
        out = out.when(rank <= most, value)
    return out.otherwise(otherwise)


def binary(rank: Column) -> Column:
    return _stepped(rank, (20, 1))


def graded_short(rank: Column) -> Column:
    """11 to 2 for ranks 1 to 10, 1 up to 20."""
    r = F.coalesce(rank, F.lit(0))
    return F.when(r.between(1, 10), 12 - r).when(r.between(11, 20), 1).otherwise(0)


def graded(rank: Column) -> Column:
    """20 to 1 for ranks 1 to 20."""
    r = F.coalesce(rank, F.lit(0))
    return F.when(r.between(1, 20), 21 - r).otherwise(0)


def three_level(rank: Column) -> Column:
    return _stepped(rank, (10, 1.0), (20, 0.1), otherwise=0.0)


def hard_label(rank: Column) -> Column:
    """Ranks 11 to 20 count as hard negatives."""
    return _stepped(rank, (10, 1))


def weight_recall(rank: Column) -> Column:
    return _stepped(rank, (5, 40), (20, 30), otherwise=1)


def weight_steep(rank: Column) -> Column:
    return _stepped(rank, (3, 50), (10, 35), (20, 24), otherwise=1)


def weight_level(rank: Column) -> Column:
    return _stepped(rank, (10, 20), (20, 5), otherwise=1)


def decay(year: Column, last: Column, rate: float = 0.9) -> Column:
    return F.pow(F.lit(rate), last - year)


def gain(rank: Column) -> Column:
    """2^(21 - rank) - 1 for ranks 1 to 20."""
    return F.when(F.coalesce(rank, F.lit(0)).between(1, 20), F.pow(F.lit(2.0), 21 - rank) - 1).otherwise(0.0)


def listed_gain(relevance: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GAINS)), (relevance + 1).cast("int"))
