"""Model registry and run tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.operators import registry as rg
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import common

KINDS = "['nlp', 'vader', 'emoji', 'boosting', 'api', 'bayes', 'rr']"
# The stored values per kind, as the fixture writes them.
TYPED = f"""kinds AS (SELECT s_suppkey AS k, s_name, {KINDS}[s_suppkey % 7 + 1] AS kind FROM supplier),
typed AS (SELECT concat('m', k) AS id, s_name AS name, CASE WHEN k % 2 = 0 THEN 'vader' ELSE 'emoji' END AS tag_tweets,
  kind AS type_classifier,
  CASE WHEN kind = 'api' THEN 'text_service' END AS api_client,
  CASE WHEN kind IN ('bayes', 'rr', 'boosting') THEN CAST(500 + k % 100 AS INT) END AS "nClassWords",
  CASE WHEN kind = 'bayes' THEN CASE WHEN k % 2 = 0 THEN 'bernoulli' ELSE 'multinomial' END END AS type_model,
  CASE WHEN kind = 'bayes' THEN CASE WHEN k % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS lambda,
  CASE WHEN kind = 'rr' THEN CAST(10 + k % 9 AS INT) END AS num_trees,
  CASE WHEN kind IN ('rr', 'boosting') THEN CAST(2 + k % 5 AS INT) END AS depth,
  CASE WHEN kind = 'rr' THEN CAST(16 + k % 17 AS INT) END AS max_bins,
  CASE WHEN kind = 'rr' THEN 'auto' END AS subset_strategy,
  CASE WHEN kind = 'rr' THEN 'gini' END AS impurity,
  CASE WHEN kind = 'rr' THEN CAST(1 + k % 50 AS INT) END AS seed,
  CASE WHEN kind IN ('boosting', 'nlp') THEN CAST(3 + k % 8 AS INT) END AS num_iterations,
  CASE WHEN kind = 'boosting' THEN 'Regression' END AS strategy_boosting,
  CASE WHEN kind = 'nlp' THEN 'meanagg' END AS agg_function FROM kinds)"""


@query("parse_model_params", f"WITH {TYPED} SELECT * FROM typed")
def parse_model_params(spark: SparkSession, sf: str) -> DataFrame:
    return rg.parse_model_params(fx.models(spark, sf)).drop("partitionConf")


@query(
    "format_model_params",
    f"WITH {TYPED}, flat AS (UNPIVOT (SELECT id, type_classifier, api_client, CAST(\"nClassWords\" AS VARCHAR) AS \"nClassWords\", "
    "type_model, CAST(\"lambda\" AS VARCHAR) AS \"lambda\", CAST(num_trees AS VARCHAR) AS num_trees, CAST(depth AS VARCHAR) AS depth, "
    "CAST(max_bins AS VARCHAR) AS max_bins, subset_strategy, impurity, CAST(seed AS VARCHAR) AS seed, "
    "CAST(num_iterations AS VARCHAR) AS num_iterations, strategy_boosting, agg_function FROM typed) "
    "ON COLUMNS(* EXCLUDE (id, type_classifier)) INTO NAME key VALUE value) SELECT id, type_classifier, key, value FROM flat",
)
def format_model_params(spark: SparkSession, sf: str) -> DataFrame:
    """Typed parameters written back to the map, one row per entry: each kind keeps its own."""
    stored = rg.format_model_params(rg.parse_model_params(fx.models(spark, sf)))
    return stored.select("id", "type_classifier", F.explode("parameters").alias("key", "value"))


JUDGED = """first AS (SELECT run, min(asked_at) AS trained_at FROM actions WHERE action = 'train' GROUP BY run),
judged AS (SELECT a.*, action <> 'evaluate' OR coalesce(f.trained_at < a.asked_at, false) AS accepted
  FROM actions a LEFT JOIN first f ON a.run = f.run)"""


@query("judge_actions", common(JUDGED) + "SELECT run, action, asked_at, seq, accepted FROM judged")
def judge_actions(spark: SparkSession, sf: str) -> DataFrame:
    return rg.judge_actions(fx.actions(spark, sf))


@query(
    "run_registry",
    common(JUDGED)
    + """SELECT run, coalesce(arg_max(CASE action WHEN 'train' THEN 'trained' WHEN 'execute' THEN 'runned' END, asked_at)
      FILTER (WHERE action <> 'evaluate'), 'created') AS status, count(*) FILTER (WHERE NOT accepted) AS refused,
      count(*) AS actions FROM judged GROUP BY run""",
)
def run_registry(spark: SparkSession, sf: str) -> DataFrame:
    return rg.run_states(fx.actions(spark, sf))


@query(
    "latest_states",
    common()
    + """SELECT id, "modelId", "topicId", "dateExecution", status FROM (SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY "dateExecution" DESC,
      CASE status WHEN 'runned' THEN 1 WHEN 'trained' THEN 2 WHEN 'created' THEN 3 ELSE 4 END) AS n FROM executions) WHERE n = 1""",
)
def latest_states(spark: SparkSession, sf: str) -> DataFrame:
    return rg.latest_states(fx.executions(spark, sf))


@query(
    "mark_trained",
    common(
        """created AS (SELECT id, min("modelId") AS "modelId", min("topicId") AS "topicId", min("dateExecution") AS "dateExecution"
        FROM executions GROUP BY id)"""
    )
    + """SELECT id, "modelId", "topicId", "dateExecution", CASE WHEN s_suppkey IS NULL THEN 'created' ELSE 'trained' END AS status,
      s_acctbal AS train_accuracy FROM created LEFT JOIN supplier ON id = concat('r', s_suppkey * 7)""",
)
def mark_trained(spark: SparkSession, sf: str) -> DataFrame:
    """New runs, of which those with metrics become trained."""
    runs = fx.executions(spark, sf).groupBy("id").agg(
        F.min("modelId").alias("modelId"), F.min("topicId").alias("topicId"), F.min("dateExecution").alias("dateExecution")
    )
    balance = F.col("s_acctbal")
    metrics = fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("r"), F.col("s_suppkey") * 7).alias("run_id"),
        F.concat(F.lit("result-"), F.col("s_suppkey")).alias("id"),
        F.concat(F.lit("m"), F.col("s_suppkey")).alias("model_id"),
        balance.alias("train_accuracy"),
        balance.alias("valid_accuracy"),
        balance.alias("test_accuracy"),
    )
    marked = rg.mark_trained(rg.create_runs(runs), metrics)
    return marked.select("id", "modelId", "topicId", "dateExecution", "status", "resultModel.train_accuracy")


@query(
    "run_report",
    common(TYPED)
    + """SELECT e.id, e."modelId", e."topicId", m.name, m.type_classifier, e.status, g.positive, g.negative, g.neutral
      FROM executions e LEFT JOIN typed m ON e."modelId" = m.id
      LEFT JOIN aggs g ON e."topicId" = g.topic_id AND e."modelId" = g.model_id""",
)
def run_report(spark: SparkSession, sf: str) -> DataFrame:
    return rg.run_report(fx.executions(spark, sf), fx.models(spark, sf), fx.aggs(spark, sf))
