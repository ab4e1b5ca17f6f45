"""Train / validation / classify splits and the set operations behind them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Weights:
    train: float
    validation: float
    classification: float


def split_sizes(df: DataFrame, weights: Weights) -> DataFrame:
    """Truncated sizes of the three parts."""
    n = F.count(F.lit(1))
    size = lambda w: F.floor(n * F.lit(w)).cast("bigint")
    return df.agg(
        size(weights.train).alias("train"),
        size(weights.validation).alias("validation"),
        size(weights.classification).alias("classification"),
    )


def bucket(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends only on the id and the seed, whatever the partitioning."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _three_way(share: Column, weights: Weights) -> Column:
    return (
        F.when(share < weights.train, "train")
        .when(share < weights.train + weights.validation, "validation")
        .otherwise("classify")
    )


def split_random(df: DataFrame, weights: Weights, key: str = "tweet_id", seed: int = 42) -> DataFrame:
    return df.withColumn("split", _three_way(bucket(key, seed), weights))


def dataset_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("tweets"), F.count_if("contain_emoji").alias("emoji_tweets")
    )


def split_emoji_aware(df: DataFrame, weights: Weights, tag: str, key: str = "tweet_id", seed: int = 42) -> DataFrame:
    """Emoji tags can only be learnt from rows with emoji.

    With an emoji tag and too few such rows for train and validation, exactly those rows are split
    between the two and all others are classified; else the plain three-way split is used. The
    share is a scalar subquery over one column, evaluated within the same query.
    """
    plain = _three_way(bucket(key, seed), weights)
    if tag != "emoji":
        return df.withColumn("split", plain)
    supervised = weights.train + weights.validation
    share = df.agg(
        F.coalesce(F.avg(F.col("contain_emoji").cast("double")), F.lit(0.0)).alias("share")
    ).scalar()
    scarce = (
        F.when(~F.col("contain_emoji"), "classify")
        .when(bucket(key, seed) < weights.train / supervised, "train")
        .otherwise("validation")
    )
    return df.withColumn("split", F.when(share < supervised, scarce).otherwise(plain))


def subtract_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows that equal no right row; repeats on the left stay."""
    names = left.columns
    other = right.select(*[F.col(n).alias(f"_r_{n}") for n in names]).distinct()
    same = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(other, same, "left_anti")


def union_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)
