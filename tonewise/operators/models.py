"""Supervised models on hashed bags of words, with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IndexToString, SQLTransformer, StringIndexer
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.functions.labels import boosting_class
from tonewise.operators.splits import Weights

# Folder prefix of each saved kind.
MODEL_PREFIX = {"bayes": "bayes", "rr": "randomforest", "boosting": "gradient"}
_MODEL_CLASS = {"bayes": PipelineModel, "rr": RandomForestClassificationModel, "boosting": GBTRegressionModel}


@dataclass(frozen=True)
class ModelSpec:
    """Typed parameters of one supervised model."""

    id: str
    kind: str
    tag: str = "vader"
    weights: Weights = field(default_factory=lambda: Weights(0.6, 0.2, 0.2))
    n_class_words: int = 1024
    type_model: str = "multinomial"
    smoothing: float = 1.0
    num_trees: int = 20
    depth: int = 5
    max_bins: int = 32
    subset_strategy: str = "auto"
    impurity: str = "gini"
    num_iterations: int = 20
    seed: int = 42

    @property
    def label_kind(self) -> str:
        return self.type_model if self.kind == "bayes" else self.kind


def hash_features(df: DataFrame, buckets: int, binary: bool = False, tokens: str = "tokens") -> DataFrame:
    """Term counts (or 0/1) hashed to ``buckets`` positions."""
    tf = HashingTF(inputCol=tokens, outputCol="features", numFeatures=buckets, binary=binary)
    return tf.transform(df)


def spec_features(df: DataFrame, spec: ModelSpec) -> DataFrame:
    return hash_features(df, spec.n_class_words, spec.kind == "bayes" and spec.type_model == "bernoulli")


def train_bayes(train: DataFrame, spec: ModelSpec) -> Model:
    """Naive Bayes on the classes that occur.

    The estimator predicts the rank of a class among those it has seen, so classes are indexed
    before the fit and predictions turned back into class values: a training split without neutral
    rows must not shift the positive class.
    """
    indexer = StringIndexer(
        inputCol="label", outputCol="class_index", stringOrderType="alphabetAsc", handleInvalid="keep"
    ).fit(train)
    model = NaiveBayes(
        labelCol="class_index",
        predictionCol="class_prediction",
        modelType=spec.type_model,
        smoothing=spec.smoothing,
    ).fit(indexer.transform(train))
    back = IndexToString(inputCol="class_prediction", outputCol="class_name", labels=indexer.labels)
    value = SQLTransformer(statement="SELECT *, CAST(class_name AS DOUBLE) AS prediction FROM __THIS__")
    return PipelineModel([indexer, model, back, value])


def train_forest(train: DataFrame, spec: ModelSpec) -> Model:
    return RandomForestClassifier(
        numTrees=spec.num_trees,
        featureSubsetStrategy=spec.subset_strategy,
        impurity=spec.impurity,
        maxDepth=spec.depth,
        maxBins=spec.max_bins,
        seed=spec.seed,
    ).fit(train)


def train_gbt(train: DataFrame, spec: ModelSpec) -> Model:
    return GBTRegressor(
        maxIter=spec.num_iterations, maxDepth=spec.depth, seed=spec.seed
    ).fit(train)


TRAINERS = {"bayes": train_bayes, "rr": train_forest, "boosting": train_gbt}


def train(rows: DataFrame, spec: ModelSpec) -> Model:
    if spec.kind not in TRAINERS:
        raise ValueError(f"model kind {spec.kind!r} is not supervised")
    return TRAINERS[spec.kind](rows, spec)


def model_path(root: str, kind: str, model_id: str) -> str:
    return f"{root.rstrip('/')}/{MODEL_PREFIX[kind]}_{model_id}"


def save_model(model: Model, root: str, kind: str, model_id: str) -> str:
    path = model_path(root, kind, model_id)
    model.write().overwrite().save(path)
    return path


def load_model(root: str, kind: str, model_id: str) -> Model:
    return _MODEL_CLASS[kind].load(model_path(root, kind, model_id))


def correct(kind: str, prediction: Column, label: Column) -> Column:
    """Whether a prediction hits; boosting predicts a real number, so its class is compared."""
    if kind == "boosting":
        return boosting_class(prediction) == boosting_class(label)
    return prediction == label


def evaluate_splits(predictions: DataFrame, kind: str, split: str = "split") -> DataFrame:
    """Accuracy of train, validation and test in one pass; an empty split gives null."""
    hit = correct(kind, F.col("prediction"), F.col("label")).cast("double")
    return predictions.agg(
        F.avg(F.when(F.col(split) == "train", hit)).alias("train_accuracy"),
        F.avg(F.when(F.col(split) == "validation", hit)).alias("valid_accuracy"),
        F.avg(F.when(F.col(split) == "classify", hit)).alias("test_accuracy"),
    )


def predict(model: Model, rows: DataFrame, on: str | None = "classify", keep: Sequence[str] = ("tweet_id",)) -> DataFrame:
    """Predictions for one split, or for all rows with ``on`` None."""
    chosen = rows if on is None else rows.where(F.col("split") == on)
    return model.transform(chosen).select(*keep, "prediction")
