"""Training, evaluation, prediction and storage of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewise.functions import labels
from tonewise.operators import models as ml
from tonewise.operators import sentences as sn
from tonewise.operators import splits as sp
from tonewise.operators import tagging as tg
from tonewise.operators.scoring import vader_scores
from tonewise.plans import jobs
from tonewise.session import scratch_dir
from tonewise.sources import sinks
from tonewise.sources.tables import read_table
from tonewise.workload import aggregates as ag
from tonewise.workload import fixtures as fx
from tonewise.workload import query
from tonewise.workload.twin import common, three_way, two

BERNOULLI = ml.ModelSpec(id="nb2", kind="bayes", type_model="bernoulli", n_class_words=1024)
MULTINOMIAL = ml.ModelSpec(id="nb3", kind="bayes", n_class_words=1024)
FOREST = ml.ModelSpec(id="rf", kind="rr", num_trees=8, depth=4, n_class_words=256)
BOOSTED = ml.ModelSpec(id="gb", kind="boosting", num_iterations=4, depth=3, n_class_words=256)


def _metrics(spark: SparkSession, sf: str, *specs: ml.ModelSpec) -> DataFrame:
    """Model, rows per split, and whether the three accuracies are shares; the texts are scored once."""
    tweets, lexicons = fx.flagged_tweets(spark, sf, wide=True), fx.lexicons(spark)
    root = scratch_dir(spark, "models")
    scored = jobs.compounds(tweets, specs[0].tag, lexicons)
    shares = [F.col(f"{part}_accuracy").between(0, 1) for part in ("train", "valid", "test")]
    out = None
    for spec in specs:
        trained = jobs.train_and_evaluate(tweets, spec, lexicons, root, scored)
        counts = trained.rows.agg(*(F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "validation", "classify")))
        row = trained.metrics.select("id", "model_id", (shares[0] & shares[1] & shares[2]).alias("legal")).join(counts)
        out = row if out is None else out.unionByName(row)
    return out


def _metrics_sql(*ids: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {three_way('tweet_id')} = '{s}') AS {s}_rows" for s in ("train", "validation", "classify"))
    return common() + " UNION ALL ".join(f"SELECT 'result-{i}' AS id, '{i}' AS model_id, true AS legal, {counts} FROM tweets" for i in ids)


@query("train_bayes", _metrics_sql("nb2", "nb3"))
def train_bayes(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, BERNOULLI, MULTINOMIAL)


@query("train_forest", _metrics_sql("rf"))
def train_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, FOREST)


@query("train_gbt", _metrics_sql("gb"))
def train_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, BOOSTED)


@query(
    "predict",
    common()
    + f"""SELECT concat('{ag.RUN}', '-', tweet_id) AS id, tweet_id AS "idTweet", '{ag.RUN}' AS "idExecution", 'bayes' AS "typeModel",
      true AS legal FROM tweets WHERE {three_way('tweet_id')} = 'classify'""",
)
def predict(spark: SparkSession, sf: str) -> DataFrame:
    """Train, store, load and run on the rows kept for classification; legal: the result is a class."""
    tweets = fx.flagged_tweets(spark, sf, wide=True)
    root = scratch_dir(spark, "models")
    lexicons = fx.lexicons(spark)
    jobs.train_and_evaluate(tweets, MULTINOMIAL, lexicons, root)
    found = jobs.run_saved(tweets, MULTINOMIAL, lexicons, root, ag.RUN)
    return found.withColumn("legal", F.col("result").isin(0.0, 1.0, 2.0)).drop("result")


@query(
    "supervised_run",
    common()
    + f"""SELECT s.status, true AS has_metrics, r.n AS results, r.n AS tallied FROM (VALUES ('created'), ('trained'), ('runned')) s(status),
      (SELECT count(*) AS n FROM tweets WHERE {three_way('tweet_id')} = 'classify') r""",
)
def supervised_run(spark: SparkSession, sf: str) -> DataFrame:
    """A whole run as its tables tell it: states, metrics, result rows and what the tally counts."""
    models, tables = scratch_dir(spark, "models"), scratch_dir(spark, "tables")
    tweets = fx.flagged_tweets(spark, sf, wide=True)
    jobs.train_run_and_store(tweets, MULTINOMIAL, fx.lexicons(spark), models, tables, ag.RUN, "all", "2024-01-01")
    metrics = read_table(spark, f"{tables}/model_results")
    runs = read_table(spark, f"{tables}/executions").join(metrics.select(F.col("id").alias("resultModel"), "test_accuracy"), "resultModel", "left")
    results = read_table(spark, f"{tables}/tweet_results").agg(F.count("*").alias("results"))
    counted = read_table(spark, f"{tables}/aggs").agg(F.sum(F.col("positive") + F.col("negative") + F.col("neutral")).alias("tallied"))
    known = (F.col("status") == "created") | F.col("test_accuracy").between(0, 1)
    return runs.select("status", known.alias("has_metrics")).join(results).join(counted)


SENTENCE_CLASSES = (0.0, 1.0)


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The longest sentence of every labelled text, its quality as label, and its part."""
    truth = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("tweet_id"), F.col("quality").cast("double").alias("label"))
    tweets = fx.tweets(spark, sf, wide=True).select("tweet_id", "tweetText").join(truth, "tweet_id")
    picked = sp.split_random(sn.longest_sentences(tweets, ("tweet_id", "label")), sp.Weights(0.6, 0.2, 0.2))
    path = scratch_dir(spark, "sentences")
    picked.write.parquet(path)
    return read_table(spark, path)


@query(
    "train_sentences",
    common()
    + f"""SELECT {three_way('t.tweet_id')} AS split, count(*) AS rows, true AS above_lexicon FROM tweets t JOIN labels l ON t.tweet_id = l.doc_id GROUP BY 1""",
)
def train_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The composed sentence model against the lexicon, on the quality labels: is its accuracy higher in each part?"""
    parts = _sentences(spark, sf)
    model = sn.train_sentences(parts.where("split = 'train'"), SENTENCE_CLASSES)
    scored = sn.score_sentences(parts, model, ("tweet_id", "split", "label"))
    lexicon = vader_scores(parts, ["tweet_id"], "sentence", fx.lexicons(spark).vader).select("tweet_id", labels.two_class(F.col("compound")).alias("lexicon"))
    hits = [F.count_if(F.col(c) == F.col("label")) for c in ("prediction", "lexicon")]
    return scored.join(lexicon, "tweet_id").groupBy("split").agg(F.count("*").alias("rows"), (hits[0] > hits[1]).alias("above_lexicon"))


@query("run_trained_sentences", common() + "SELECT concat('run-1-', tweet_id) AS id, tweet_id AS \"idTweet\", 'nlp' AS \"typeModel\", true AS legal FROM tweets")
def run_trained_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of the trained sentence model for all texts, the model stored and loaded between; legal: a class."""
    path = scratch_dir(spark, "sentence-model")
    sn.save_sentences(sn.train_sentences(_sentences(spark, sf), SENTENCE_CLASSES), spark, path)
    results = tg.run_trained_sentences(fx.tweets(spark, sf, wide=True), sn.load_sentences(spark, path), ag.RUN)
    return results.select("id", "idTweet", "typeModel", F.col("result").isin(0.0, 2.0).alias("legal"))


# Two kinds of texts that any of the models can tell apart.
SEPARABLE = "SELECT doc_id AS tweet_id, CASE WHEN doc_id % 3 = 0 THEN 'good great film' ELSE 'awful bad film' END AS tweetText, source AS topic, false AS contain_emoji FROM documents"
PLAIN = (
    ml.ModelSpec("s-nb", "bayes", type_model="bernoulli", n_class_words=64),
    ml.ModelSpec("s-nm", "bayes", n_class_words=64),
    ml.ModelSpec("s-rf", "rr", num_trees=5, depth=3, n_class_words=64),
    ml.ModelSpec("s-gb", "boosting", num_iterations=3, depth=2, n_class_words=64),
)


@query(
    "separable_models",
    f"""WITH rows AS ({SEPARABLE}) SELECT m.id AS model, tweet_id % 3 = 0 AS good, CASE WHEN tweet_id % 3 = 0 THEN m.up ELSE m.down END AS class, count(*) AS n
    FROM rows, (VALUES ('s-nb', 1.0::DOUBLE, 0.0::DOUBLE), ('s-nm', 2.0::DOUBLE, 0.0::DOUBLE), ('s-rf', 2.0::DOUBLE, 0.0::DOUBLE), ('s-gb', 2.0::DOUBLE, 0.0::DOUBLE)) m(id, up, down) GROUP BY ALL""",
)
def separable_models(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by class of each kind of model: on separable texts all of them must be right."""
    tweets, root, out = fx.shaped(spark, sf, SEPARABLE, "documents"), scratch_dir(spark, "models"), None
    lexicons = fx.lexicons(spark)
    for spec in PLAIN:
        trained = jobs.train_and_evaluate(tweets, spec, lexicons, root)
        found = ml.predict(trained.model, trained.rows, on=None)
        value = labels.boosting_class(F.col("prediction")) if spec.kind == "boosting" else F.col("prediction")
        rows = found.select(F.lit(spec.id).alias("model"), (F.col("tweet_id") % 3 == 0).alias("good"), value.cast("double").alias("class"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("model", "good", "class").agg(F.count("*").alias("n"))


@query("save_load_model", "SELECT count(*) AS rows, count(*) AS agreeing FROM documents")
def save_load_model(spark: SparkSession, sf: str) -> DataFrame:
    """A stored model predicts as the one that was trained."""
    root = scratch_dir(spark, "models")
    rows = jobs.stored(jobs.prepared(fx.flagged_tweets(spark, sf, wide=True), BERNOULLI, fx.lexicons(spark)))
    fitted = ml.train(rows.where("split = 'train'"), BERNOULLI)
    ml.save_model(fitted, root, BERNOULLI.kind, BERNOULLI.id)
    loaded = ml.load_model(root, BERNOULLI.kind, BERNOULLI.id)
    both = loaded.transform(
        fitted.transform(rows).select("features", F.col("prediction").alias("expected"))
    )
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") == F.col("expected")).alias("agreeing")
    )


PREDICTIONS = f"""predictions AS (SELECT {three_way('t.tweet_id')} AS split, {two('r.result')} AS prediction,
  CAST(l.quality AS DOUBLE) AS label FROM runs r JOIN tweets t ON r.tweet_id = t.tweet_id JOIN labels l ON t.tweet_id = l.doc_id)"""
ACCURACY = "round(avg(CAST(prediction = label AS INT)) FILTER (WHERE split = '{}'), 9) AS {}_accuracy"


@query(
    "evaluate_splits",
    common(*ag.VADER_RUN, PREDICTIONS)
    + f"SELECT {ACCURACY.format('train', 'train')}, {ACCURACY.format('validation', 'valid')}, "
    f"{ACCURACY.format('classify', 'test')} FROM predictions",
)
def evaluate_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The lexicon's two classes as predictions of the quality label, per split."""
    results = ag.run_vader(spark, sf).select(F.col("idTweet").alias("tweet_id"), labels.two_class(F.col("result")).alias("prediction"))
    truth = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("tweet_id"), F.col("quality").cast("double").alias("label"))
    predictions = sp.split_random(results.join(truth, "tweet_id"), sp.Weights(0.6, 0.2, 0.2))
    scored = ml.evaluate_splits(predictions, "bayes")
    return scored.select(*[F.round(c, 9).alias(c) for c in scored.columns])


@query("write_results", common(*ag.VADER_RUN) + ag.RESULT_SQL.format(kind="vader"))
def write_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows written by run and read back."""
    root = scratch_dir(spark, "results")
    sinks.write_results(ag.run_vader(spark, sf), root, "tweet_results")
    return read_table(spark, f"{root}/tweet_results")


@query(
    "run_and_tally",
    common(*ag.VADER_RUN)
    + """SELECT 'vader' AS kind, topic, count(*) FILTER (WHERE result > 0.5) AS positive,
      count(*) FILTER (WHERE result <= -0.5) AS negative, count(*) FILTER (WHERE result > -0.5 AND result < 0.5) AS neutral
      FROM runs GROUP BY topic""",
)
def run_and_tally(spark: SparkSession, sf: str) -> DataFrame:
    """One unsupervised run: results to the result table, its tally from the stored rows."""
    root = scratch_dir(spark, "results")
    results, _ = jobs.run_unsupervised(fx.tweets(spark, sf, wide=True), "vader", fx.lexicons(spark), ag.RUN, ("topic",))
    sinks.write_results(results, root, "tweet_results")
    stored = read_table(spark, f"{root}/tweet_results")
    return jobs.tally(stored, "vader", ["topic"]).withColumn("kind", F.lit("vader"))
