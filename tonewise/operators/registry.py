"""Model registry rows, run states and reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewise.operators.joins import lookup, measure
from tonewise.operators.rows import latest_by, upsert_rows
from tonewise.schemas import EXECUTION_STATES, MODEL_RESULT

# Parameters each model kind stores, with the type they are read as.
KIND_PARAMETERS: Mapping[str, Mapping[str, str]] = {
    "api": {"api_client": "string"},
    "bayes": {"nClassWords": "int", "type_model": "string", "lambda": "double"},
    "rr": {
        "num_trees": "int",
        "depth": "int",
        "max_bins": "int",
        "subset_strategy": "string",
        "impurity": "string",
        "seed": "int",
        "nClassWords": "int",
    },
    "boosting": {"num_iterations": "int", "depth": "int", "strategy_boosting": "string", "nClassWords": "int"},
    "nlp": {"num_iterations": "int", "agg_function": "string"},
    "vader": {},
    "emoji": {},
}


def _types() -> dict[str, str]:
    return {name: kind for group in KIND_PARAMETERS.values() for name, kind in group.items()}


def _stores(name: str) -> Column:
    return F.col("type_classifier").isin([k for k, group in KIND_PARAMETERS.items() if name in group])


def parse_model_params(models: DataFrame) -> DataFrame:
    """Registry map to typed columns; a column is null where the kind does not store it."""
    typed = [
        F.when(_stores(name), F.col("parameters")[name]).try_cast(kind).alias(name)
        for name, kind in _types().items()
    ]
    return models.select("id", "name", "tag_tweets", "type_classifier", *typed, "partitionConf")


def format_model_params(typed: DataFrame) -> DataFrame:
    """Typed columns back to the registry map, without the parameters that are not set."""
    entries = [
        F.struct(F.lit(name).alias("key"), F.col(name).cast("string").alias("value")) for name in _types()
    ]
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return typed.select(
        "id", "name", "tag_tweets", "type_classifier", F.map_from_entries(kept).alias("parameters"), "partitionConf"
    )


def create_runs(requests: DataFrame) -> DataFrame:
    """New runs (id, modelId, topicId, dateExecution) start as created, without a result."""
    return requests.select(
        "id",
        "modelId",
        "topicId",
        "dateExecution",
        F.lit("created").alias("status"),
        F.lit(None).cast(_result_type()).alias("resultModel"),
    )


def _result_type() -> str:
    return MODEL_RESULT.simpleString()


def mark_trained(executions: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with metrics (run id, metrics struct fields) become trained; the others stay."""
    metrics = results.select(
        F.col("run_id").alias("id"),
        F.struct("id", "model_id", "train_accuracy", "valid_accuracy", "test_accuracy").alias("resultModel"),
    )
    trained = executions.drop("status", "resultModel").join(metrics, "id").select(
        "id", "modelId", "topicId", "dateExecution", F.lit("trained").alias("status"), "resultModel"
    )
    return upsert_rows(executions, trained)


def judge_actions(actions: DataFrame) -> DataFrame:
    """Accept or refuse each requested action (run, action, asked_at, seq).

    Evaluating needs a training of the same run at an earlier (asked_at, seq). The first training per run
    is one map-side-combined aggregate, looked up by run, so a run with very many actions is neither
    sorted nor gathered in one task.
    """
    first = (
        actions.where(F.col("action") == "train")
        .groupBy("run")
        .agg(F.min(F.struct("asked_at", "seq")).alias("first_train"))
        .withColumnRenamed("run", "trained_run")
    )
    # One row per run: it grows with the data, so it is measured, and salted when it is large.
    judged = lookup(actions, "run", measure(first, "trained_run"))
    ready = F.coalesce(F.col("first_train") < F.struct("asked_at", "seq"), F.lit(False))
    return judged.select(
        "run", "action", "asked_at", "seq", ((F.col("action") != "evaluate") | ready).alias("accepted")
    )


def run_states(actions: DataFrame) -> DataFrame:
    """Latest state per run and how many actions were refused."""
    state = (
        F.when(F.col("action") == "train", "trained")
        .when(F.col("action") == "execute", "runned")
        .when(F.col("action") == "create", "created")
    )
    judged = judge_actions(actions).withColumn("state", state)
    moment = F.struct("asked_at", "seq")
    return judged.groupBy("run").agg(
        F.coalesce(
            F.max_by("state", F.when(F.col("state").isNotNull(), moment)), F.lit("created")
        ).alias("status"),
        F.count_if(~F.col("accepted")).alias("refused"),
        F.count(F.lit(1)).alias("actions"),
    )


def latest_states(executions: DataFrame) -> DataFrame:
    """Current row per run from an append-only execution log; on a tie the state later in a run's life."""
    stage = F.coalesce(F.array_position(F.array(*map(F.lit, EXECUTION_STATES)), F.col("status")), F.lit(0))
    return latest_by(executions.withColumn("_stage", stage), ["id"], "dateExecution", "_stage").drop("_stage")


def run_report(executions: DataFrame, models: DataFrame, aggs: DataFrame) -> DataFrame:
    """Runs with their model's name and kind, and the tally of their topic under that model."""
    named = models.select(F.col("id").alias("model_key"), "name", "type_classifier")
    tallies = aggs.select(
        F.col("topic_id").alias("topicId"), F.col("model.id").alias("modelId"), "positive", "negative", "neutral"
    )
    runs = lookup(executions, "modelId", measure(named, "model_key"))
    return runs.join(tallies, ["topicId", "modelId"], "left").select(
        "id", "modelId", "topicId", "name", "type_classifier", "status", "positive", "negative", "neutral"
    )
