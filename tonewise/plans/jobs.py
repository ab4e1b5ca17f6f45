"""Train, evaluate and run: the whole jobs over one topic's tweets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.functions.fixed_values import ENGLISH_STOP_WORDS
from tonewise.operators import models as ml
from tonewise.operators.splits import split_emoji_aware
from tonewise.operators.tagging import Lexicons, as_results, compound_of, label_for, run_emoji, run_sentences, run_vader, tokens_of
from tonewise.operators.tallies import tally
from tonewise.schemas import EXECUTION_STATES
from tonewise.session import scratch_dir
from tonewise.sources import sinks

UNSUPERVISED = {"vader": run_vader, "emoji": run_emoji, "nlp": run_sentences}


def compounds(tweets: DataFrame, tag: str, lexicons: Lexicons) -> DataFrame:
    """(tweet_id, compound) of every row, written once; several models can take their labels from it."""
    spark = tweets.sparkSession
    path = scratch_dir(spark, "compounds")
    compound_of(tweets, tag, lexicons).write.parquet(path)
    return spark.read.parquet(path)


def prepared(tweets: DataFrame, spec: ml.ModelSpec, lexicons: Lexicons, scored: DataFrame | None = None) -> DataFrame:
    """(tweet_id, split, features, label) of every row; ``scored`` are compounds that exist already.

    Tokens are hashed before the join with the labels, so short sparse vectors are shuffled and not
    the texts.
    """
    parts = split_emoji_aware(tweets, spec.weights, spec.tag, seed=spec.seed)
    words = None
    if spec.kind == "bayes" and spec.tag == "vader":
        words = ENGLISH_STOP_WORDS
    tokens = tokens_of(parts, lexicons, keep=["split"], stop_words=words)
    features = ml.spec_features(tokens, spec).drop("tokens")
    scored = compound_of(tweets, spec.tag, lexicons) if scored is None else scored
    return features.join(scored.select("tweet_id", label_for(spec.label_kind, spec.tag, F.col("compound")).alias("label")), "tweet_id")


def stored(rows: DataFrame) -> DataFrame:
    """Prepared rows written once to the shared scratch folder, laid out by split.

    Scoring is then not repeated when an executor is lost, lineage is cut before the iterative
    trainers, and the trainers read the training split only.
    """
    path = scratch_dir(rows.sparkSession, "prepared")
    rows.write.partitionBy("split").parquet(path)
    return rows.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Trained:
    model: Model
    path: str
    metrics: DataFrame
    rows: DataFrame


def train_and_evaluate(tweets: DataFrame, spec: ml.ModelSpec, lexicons: Lexicons, root: str, scored: DataFrame | None = None) -> Trained:
    """Fit on the training split, save, and compute the three accuracies."""
    rows = stored(prepared(tweets, spec, lexicons, scored))
    model = ml.train(rows.where(F.col("split") == "train"), spec)
    path = ml.save_model(model, root, spec.kind, spec.id)
    return Trained(model, path, evaluate(rows, model, spec), rows)


def evaluate(rows: DataFrame, model: Model, spec: ml.ModelSpec) -> DataFrame:
    """One metrics row for a trained model."""
    scored = model.transform(rows).select("split", "label", "prediction")
    return ml.evaluate_splits(scored, spec.kind).select(
        F.concat_ws("-", F.lit("result"), F.lit(spec.id)).alias("id"),
        F.lit(spec.id).alias("model_id"),
        "train_accuracy",
        "valid_accuracy",
        "test_accuracy",
    )


def evaluate_saved(tweets: DataFrame, spec: ml.ModelSpec, lexicons: Lexicons, root: str, status: str) -> DataFrame:
    """Evaluate a stored model; refused unless the run has been trained."""
    if status != "trained":
        raise ValueError(f"run of model {spec.id!r} is {status!r}, not trained")
    model = ml.load_model(root, spec.kind, spec.id)
    return evaluate(prepared(tweets, spec, lexicons), model, spec)


def features_of(tweets: DataFrame, spec: ml.ModelSpec, lexicons: Lexicons) -> DataFrame:
    """(tweet_id, split, features): what prediction needs; no label is computed."""
    parts = split_emoji_aware(tweets, spec.weights, spec.tag, seed=spec.seed)
    words = ENGLISH_STOP_WORDS if spec.kind == "bayes" and spec.tag == "vader" else None
    return ml.spec_features(tokens_of(parts, lexicons, keep=["split"], stop_words=words), spec).drop("tokens")


def run_saved(tweets: DataFrame, spec: ml.ModelSpec, lexicons: Lexicons, root: str, execution: str, on: str | None = "classify") -> DataFrame:
    """Result rows of a stored model."""
    model = ml.load_model(root, spec.kind, spec.id)
    scored = ml.predict(model, features_of(tweets, spec, lexicons), on)
    return as_results(scored, spec.kind, execution, F.col("prediction"))


def tally_kind(spec: ml.ModelSpec) -> str:
    return spec.type_model if spec.kind == "bayes" else spec.kind


def metrics_id(spec: ml.ModelSpec, execution: str) -> str:
    """Id of the metrics of one training; each training of a model has its own."""
    return f"result-{spec.id}-{execution}"


def train_run_and_store(tweets: DataFrame, spec: ml.ModelSpec, lexicons: Lexicons, models: str, tables: str, execution: str, topic: str, date: str) -> None:
    """The whole supervised run: train, metrics, load, predict, tally; every table gets the run's rows once.

    ``model_results`` gets the metrics, ``executions`` the run as created, trained and runned,
    ``tweet_results`` a row per classified tweet and ``aggs`` its tally, taken from the stored rows. All are
    laid out by run, and a run replaces its own rows, so one that is repeated after a failure, or by
    mistake, leaves the same tables. The features that were trained on are classified, not made again.
    """
    spark = tweets.sparkSession
    result = metrics_id(spec, execution)

    def state(status: str) -> None:
        run = spark.range(1).select(
            F.lit(execution).alias("id"), F.lit(spec.id).alias("modelId"), F.lit(topic).alias("topicId"), F.lit(date).alias("dateExecution"),
            F.lit(status).alias("status"), F.lit(None if status == EXECUTION_STATES[0] else result).cast("string").alias("resultModel"),
        )
        sinks.replace_results(run, tables, "executions", ["id", "status"])

    created, trained_state, runned = EXECUTION_STATES
    state(created)
    trained = train_and_evaluate(tweets, spec, lexicons, models)
    metrics = trained.metrics.select(F.lit(result).alias("id"), *[c for c in trained.metrics.columns if c != "id"], F.lit(execution).alias("idExecution"))
    sinks.replace_results(metrics, tables, "model_results", ["idExecution"])
    state(trained_state)
    scored = ml.predict(ml.load_model(models, spec.kind, spec.id), trained.rows, "classify")
    sinks.replace_results(as_results(scored, spec.kind, execution, F.col("prediction")), tables, "tweet_results", ["idExecution"])
    results = spark.read.parquet(f"{tables}/tweet_results").where(F.col("idExecution").cast("string") == execution)
    counted = tally(results, tally_kind(spec)).select(
        F.concat_ws("-", F.lit("agg"), F.lit(execution)).alias("id"), F.lit(topic).alias("topic_id"), F.lit(spec.id).alias("model_id"), "positive", "negative", "neutral", F.lit(execution).alias("idExecution")
    )
    sinks.replace_results(counted, tables, "aggs", ["idExecution"])
    state(runned)


def run_unsupervised(tweets: DataFrame, kind: str, lexicons: Lexicons, execution: str, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Result rows of a lexicon scorer, and their tally."""
    results = UNSUPERVISED[kind](tweets, lexicons, execution, by)
    return results, tally(results, kind, by)
