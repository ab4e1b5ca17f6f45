"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies. Within a source the documents
are put in the order of size (ties by a hash of the id); their expected copies are summed up in that
order, one random offset per source is added, and a document is emitted once per integer that its
stretch of the running sum crosses. So a document gets the floor or the ceiling of what it expects,
and since neighbours are alike in size, the words taken miss the target by about one largest
document.

Sources in the order of their code points, null last, weigh 5, 2, 1 and so on. Targets share all
words by weight; one above ``most`` times its source stops there and the rest is shared again.

The order is global: rows are range-partitioned by (source, size, hash, id) and numbered in each
partition, and what stands before a partition is added from a small table of counts (a partition
holds a contiguous stretch, so that table has at most one row per partition and source; its size is
measured before it is broadcast). A source
with a third of all rows takes a third of the partitions. The result depends on the rows and the
seed alone, not on their layout.

Null text has no words. Documents without words count as size 0. Rows that share an id are separate
documents. A table without words takes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tonewise.llm.store import new_folder
from tonewise.operators.joins import measure

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source.

    There may be any number of sources: they are numbered by range partitions, never in one task. The level that a
    weight of 1 gets is raised until it stands: sources whose bound is not above their share of it stop, what they
    leave is shared again. Each raise adds up one row; all sums are of whole numbers, so the order of adding does
    not matter.
    """
    spark, folder = sizes.sparkSession, new_folder(sizes.sparkSession, "targets")
    order, n = F.col(source).asc_nulls_last(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id().alias("_number")  # the partition, then 33 bits of the place in it
    numbered = sizes.repartitionByRange(n, order).sortWithinPartitions(order).select(source, "source_size", number)
    numbered.write.parquet(f"{folder}/numbered")
    numbered = spark.read.schema(numbered.schema).parquet(f"{folder}/numbered").withColumn("_range", F.shiftright("_number", 33))
    starts, before = [], 0
    for r in sorted(numbered.groupBy("_range").count().collect()):  # at most one row per shuffle partition
        starts.append((r["_range"], before % len(weights)))
        before += r["count"]
    ranks = spark.createDataFrame(starts, "_range long, _start long")
    place = (F.col("_start") + F.col("_number").bitwiseAND((1 << 33) - 1)) % len(weights) + 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), place.cast("int")).cast("long")
    rows = numbered.join(F.broadcast(ranks), "_range").select(source, "source_size", weight.alias("weight"))

    def stops(left: int, share: int) -> Column:
        bound = F.col("source_size").cast("decimal(19,0)") * F.lit(Decimal(most * share))
        return bound <= F.col("weight").cast("decimal(9,0)") * F.lit(Decimal(left))

    everything = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("left"), F.coalesce(F.sum("weight"), F.lit(0)).alias("share")).first()
    left, share = everything["left"], everything["share"]
    while share:
        stop = stops(left, share)
        open_ = rows.agg(F.coalesce(F.sum(F.when(stop, F.col("source_size"))), F.lit(0)).alias("stopped"), F.coalesce(F.sum(F.when(~stop, F.col("weight"))), F.lit(0)).alias("share")).first()
        now = everything["left"] - most * open_["stopped"], open_["share"]
        if now == (left, share):
            break
        left, share = now
    bound = (F.lit(most) * F.col("source_size")).cast("double")
    level = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(share)) if share else bound
    return rows.select(source, "source_size", F.when(stops(left, share), bound).otherwise(level).alias("target") if share else bound.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number from 0 to 1 drawn for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def mix(sized: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, limit: int | None = None) -> DataFrame:
    """All columns of every row with ``source_size``, ``target`` and ``copies``.

    ``size`` holds the number of words. The rows are written once to the shared folder, in order. The small table
    is broadcast up to ``limit`` rows and the bytes that general lookups allow.
    """
    spark = sized.sparkSession
    sized = sized.drop("source_size", "target", "copies", "_place", "_partition")
    names, folder = sized.columns, new_folder(spark, "mixing")
    sized.write.parquet(f"{folder}/sized")
    stored = spark.read.schema(sized.schema).parquet(f"{folder}/sized")
    tie = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.rdd.getNumPartitions())
    keyed = stored.withColumn("_tie", tie)
    order = [F.col(source).asc_nulls_last(), F.col(size), F.col("_tie"), F.col(doc_id)]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*names)
    at = names.index(source)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of each row among those of its source in this partition; rows come sorted by source."""
        part, last, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            codes = batch.column(at).dictionary_encode(null_encoding="encode")
            values, index = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]])) if len(index) else []
            places = np.empty(len(index), np.int64)
            for a, b in zip(edges, [*edges[1:], len(index)]):
                if (values[index[a]],) != last:
                    last, place = (values[index[a]],), 0
                places[a:b] = np.arange(place, place + b - a)
                place += int(b - a)
            columns = [*batch.columns, pa.array(places), pa.array(np.full(len(index), part), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_place", "_partition"])

    kinds = StructType([*sized.schema.fields, StructField("_place", LongType()), StructField("_partition", IntegerType())])
    ordered.mapInArrow(number, kinds).write.parquet(f"{folder}/ordered")
    placed = spark.read.schema(kinds).parquet(f"{folder}/ordered")
    counts = placed.groupBy(F.col(source).alias("_source"), "_partition").agg(F.count("*").alias("n"), F.sum(size).alias("words"))
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    before = Window.partitionBy("_source").orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    wanted = targets(counts.groupBy("_source").agg(F.sum("words").alias("source_size")), "_source", weights, most)
    counts = counts.select("_source", "_partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    wanted = wanted.withColumnRenamed("_source", "_of")
    table = counts.join(wanted, counts["_source"].eqNullSafe(wanted["_of"])).drop("_of").withColumnRenamed("_partition", "_part")
    table.write.parquet(f"{folder}/table")
    table = spark.read.schema(table.schema).parquet(f"{folder}/table")
    # Beyond the size of a broadcast both sides are shuffled; a key then has the rows of one partition at most.
    joined = placed.join(F.broadcast(table) if measure(table, "_part", limit).small else table, (F.col("_partition") == F.col("_part")) & F.col(source).eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.floor((F.col("_before") + F.col("_place") + 1).cast("double") * rate + offset(F.col(source), seed))
    from_ = F.floor((F.col("_before") + F.col("_place")).cast("double") * rate + offset(F.col(source), seed))
    return joined.select(*names, "source_size", "target", (upto - from_).cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """One row per copy, without the columns that ``mix`` added."""
    rows = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.drop("_copy", "copies", "source_size", "target")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((rank - 1) % 3 AS INT) + 1] AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) AS rank FROM s)),
levels AS (SELECT l.source, l.source_size / l.weight AS level FROM w l),
f AS (SELECT w.*, (SELECT sum(CASE WHEN x.source_size * w.weight < w.source_size * x.weight
    OR (x.source_size * w.weight = w.source_size * x.weight AND x.rank < w.rank) THEN {MOST} * x.source_size ELSE 0 END) FROM w x) AS stopped,
  (SELECT sum(CASE WHEN x.source_size * w.weight < w.source_size * x.weight
    OR (x.source_size * w.weight = w.source_size * x.weight AND x.rank < w.rank) THEN x.weight ELSE 0 END) FROM w x) AS gone,
  (SELECT sum(source_size) FROM w) AS everything, (SELECT sum(weight) FROM w) AS shares FROM w),
o AS (SELECT *, {MOST} * source_size * (shares - gone) > weight * (everything - stopped) AS free FROM f),
level AS (SELECT everything - stopped AS words, shares - gone AS share FROM o WHERE free ORDER BY source_size / weight, rank LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.source_size * l.share * {MOST} > o.weight * l.words
    THEN CAST(o.weight * l.words AS DOUBLE) / CAST(l.share AS DOUBLE) ELSE CAST({MOST} * o.source_size AS DOUBLE) END AS target
  FROM o LEFT JOIN level l ON TRUE),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS place FROM d),
u AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.place, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  (CAST(('0x' || substr(md5('{SEED}:' || coalesce(p.source, chr(0))), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0 AS start
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(CAST(place AS DOUBLE) * rate + start) - floor(CAST(place - 1 AS DOUBLE) * rate + start) AS BIGINT) AS taken FROM u
"""
