"""Class metrics from one confusion matrix, and the area under the curve from mergeable score histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewise.operators.order import range_of, splitters


def confusion_matrix(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) of the rows that have both; one pass, combined on the map side."""
    both = predictions.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    return both.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(class, support, predicted, hits, precision, recall, f1) of every class that occurs in a confusion matrix.

    A class that was never predicted has no precision, one that never occurs no recall; F1 is null unless both
    exist, and 0 where both are 0.
    """
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(0)
    sides = matrix.select(
        F.explode(F.array(
            F.struct(F.col("label").alias("class"), n.alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
            F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("support"), n.alias("predicted"), F.lit(0).cast("long").alias("hits")),
        )).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision, recall = F.try_divide("hits", "predicted"), F.try_divide("hits", "support")
    f1 = F.when((F.col("support") > 0) & (F.col("predicted") > 0), 2 * F.col("hits") / (F.col("support") + F.col("predicted")))
    return sums.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def overall_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, and recall, precision and F1 weighted by support (a class without one counts as 0)."""
    share = lambda c: (F.sum(F.coalesce(c, F.lit(0.0)) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    return class_metrics(matrix).agg((F.sum("hits") / F.sum("support")).alias("accuracy"), *[share(c) for c in ("precision", "recall", "f1")])


def score_histogram(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, positives, negatives) of each distinct score; histograms of parts of a table can be added up."""
    rows = scored.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isNotNull())
    # -0.0 and 0.0 are one score
    return rows.groupBy((F.col(score) + F.lit(0.0)).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives")
    )


def area_under_curve(histogram: DataFrame) -> DataFrame:
    """One row: the chance that a positive has a higher score than a negative, an equal score counting half.

    Sums are whole numbers, so the result is exact up to one division. Scores are cut into ranges; a range is
    ordered by itself and starts from the number of negatives in the ranges below, so no task orders all
    scores. Null where either class is missing.
    """
    rows = histogram.count()
    bounds = splitters(histogram, [("score", True)], rows)
    ranged = histogram.withColumn("range", range_of([("score", True)], bounds))
    below = ranged.groupBy("range").agg(F.sum("negatives").alias("n"))  # at most 64 rows
    earlier = below.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("earlier"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    so_far = F.sum("negatives").over(Window.partitionBy("range").orderBy("score")) - F.col("negatives")
    placed = ranged.join(F.broadcast(earlier), "range").withColumn("lower", so_far + F.col("earlier"))
    wins = F.sum((big("positives") * (2 * big("lower") + big("negatives"))).cast("decimal(38,0)")).alias("wins")
    sums = placed.agg(wins, F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    return sums.select("p", "n", F.try_divide(F.col("wins").cast("double"), 2.0 * F.col("p").cast("double") * F.col("n").cast("double")).alias("auc"))
