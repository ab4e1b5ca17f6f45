"""Connected components of large graphs as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm.store import new_folder


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of the edges (a, b); a component is named by its smallest id.

    Alternates large-star and small-star steps until the edges stop changing. A step takes a minimum
    per vertex, which combines before the shuffle, and joins it back. The join streams: no task holds the
    edges of a vertex, but those of one with very many go through one task unless adaptive execution
    splits it, which it does for skewed partitions of such a join. Each step is written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "components")

    def stored(df: DataFrame, step: int) -> DataFrame:
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema("a long, b long").parquet(f"{folder}/{step}")

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), 0)
    state, step = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        step += 1
        now = stored(small.select("e.a", "e.b").where("a <> b").distinct(), step)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if seen == state:
            break
        state = seen
    members = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("id"), "component").distinct())
