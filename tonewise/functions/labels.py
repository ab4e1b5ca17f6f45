"""Class maps from scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewise.functions import fixed_values as fixed


def three_class(compound: Column) -> Column:
    return F.when(compound >= 0.5, 2.0).when(compound <= -0.2, 0.0).otherwise(1.0)


def two_class(compound: Column) -> Column:
    return F.when(compound >= 0, 1.0).otherwise(0.0)


def score_to_class(score: Column) -> Column:
    return F.when(score >= 1.333, 2.0).when(score <= 0.666, 0.0).otherwise(1.0)


def five_class(compound: Column) -> Column:
    """Five codes whose fold to three agrees with ``three_class``."""
    return (
        F.when(compound <= -0.6, 0)
        .when(compound <= -0.2, 1)
        .when(compound < 0.5, 2)
        .when(compound < 0.8, 3)
        .otherwise(4)
    )


def sentiment_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in fixed.SENTIMENT_NAMES]), code + 1)


def sentiment_code(name: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(n) for n in fixed.SENTIMENT_NAMES]), name)
    return F.when(found > 0, (found - 1).cast("int"))


def five_to_three(code: Column) -> Column:
    return F.when(code <= 1, 0).when(code == 2, 1).otherwise(2)


def boosting_label(compound: Column) -> Column:
    return (three_class(compound) + 1) / 2


def boosting_class(score: Column) -> Column:
    """Back from the boosting scale to the three classes."""
    return score_to_class(F.least(F.greatest(score * 2 - 1, F.lit(0.0)), F.lit(2.0)))


def api_class(neg: Column, pos: Column) -> Column:
    return F.when(neg > pos, 0.0).otherwise(1.0)
