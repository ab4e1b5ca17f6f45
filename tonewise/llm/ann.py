"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector minus the mean of all is turned by ``ROTATIONS`` random rotations, side by side; its code is the
signs of the results, one bit each. Three numbers are kept beside the code: the length, the inner product
between the turned direction and its code, and how far the code leads away from the direction. From
them an inner product with a query is estimated without bias, with an error that exceeds ``SURE`` standard
bounds only very rarely; the bound shrinks with the root of the number of rotations. The k-th best exact product of a query over a
bounded sample of rows is a floor under its answer; candidates whose upper bound reaches the floor
are reranked with the exact product in double precision, the best k of a block of candidates go on,
and the best k of all blocks are the answer. The sample only sets the floor; every row is a candidate.

The query set is stated by the caller and meets every candidate, block by block: queries lie in the
shared folder in files of ``QUERY_BLOCK`` vectors that tasks map into memory, so nothing that grows is
broadcast and a task holds one block of either side.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of
another dimension than most. A candidate with the id of the query is the query's own row. Repeated
ids are separate candidates. Ties go to the smaller id. Fewer than k candidates give all of them. A
product beyond double precision is infinite in the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonewise.llm import store

SURE = 3.5
#: Bits of a code per dimension.
ROTATIONS = 16
#: Rows and bytes of the sample that sets the floor.
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 16 << 20
QUERY_BLOCK = 512
ROW_BLOCK = 4096
#: Bytes of the bits of a few rows while they are numbers.
WORK_BYTES = 16 << 20


def sound(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: F.coalesce(x.cast("double").between(-1.7976931348623157e308, 1.7976931348623157e308), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=2)
def frame(dimension: int, rotations: int = ROTATIONS, seed: int = 5) -> np.ndarray:
    """Random orthogonal matrices side by side, scaled so that lengths stay: rows are orthonormal."""
    rng, turns = np.random.default_rng(seed), []
    for _ in range(rotations):
        q, r = np.linalg.qr(rng.standard_normal((dimension, dimension)))
        turns.append(q * np.sign(np.diag(r)))
    return np.concatenate(turns, axis=1) / np.sqrt(rotations)


def encoded(centred: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(code, length, fit, spread) of vectors; ``spread`` is the part of a code across the vector, relative to ``fit``."""
    turn = frame(centred.shape[1])
    codes, numbers, step = [], [np.zeros((3, 0))], _step(turn)
    for at in range(0, len(centred), step):
        part = centred[at : at + step]
        turned = part @ turn
        length = np.sqrt((part**2).sum(1))
        fit = np.abs(turned).sum(1) / np.maximum(length, 1e-300) / np.sqrt(turn.shape[1])
        bits = np.packbits(turned > 0, axis=1)
        codes += [c.tobytes() for c in bits]
        across = (decoded(bits, centred.shape[1]).astype(np.float64) ** 2).sum(1) - fit**2
        numbers.append(np.stack([length, fit, np.sqrt(np.maximum(across, 0)) / np.maximum(fit, 1e-12)]))
    return codes, *np.concatenate(numbers, axis=1)


def decoded(bits: np.ndarray, dimension: int) -> np.ndarray:
    """What the packed bits of each row say about its direction, as a vector."""
    turn, out = frame(dimension), [np.zeros((0, dimension), np.float32)]
    back, step = (turn.T / np.sqrt(turn.shape[1])).astype(np.float32), _step(turn)
    for at in range(0, len(bits), step):
        signs = np.unpackbits(bits[at : at + step], axis=1, count=turn.shape[1]).astype(np.float32) * 2 - 1
        out.append(signs @ back)
    return np.concatenate(out)


def _step(turn: np.ndarray) -> int:
    return max(1, WORK_BYTES // (8 * turn.shape[1]))


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def index(vectors: DataFrame, vector: str, vec_id: str, folder: str) -> tuple[DataFrame, int, np.ndarray, float]:
    """Stored (id, vector, code, length, fit, spread) of all rows that take part, with dimension, mean and scale.

    Codes and bounds are those of the vectors times the scale, a power of two that brings the largest component
    below 1, so that no length or product in them is beyond double precision.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & sound(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimension = sizes["d"] if sizes else 1
    rows = rows.where(F.size("vector") == dimension)
    largest = rows.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()[0] or 1.0
    scale = float(2.0 ** -min(max(int(np.frexp(largest)[1]), -1022), 1023))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimension), 0
        for batch in batches:
            total += (matrix(batch.column(0), dimension) * scale).sum(0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n])], ["total", "n"])

    total = rows.select("vector").mapInArrow(totals, "total array<double>, n long").select(F.posexplode("total").alias("i", "x"), "n").groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    mean = np.zeros(dimension)
    for r in total:
        mean[r["i"]] = r["x"] / max(r["n"], 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, *numbers = encoded(matrix(batch.column(1), dimension) * scale - mean)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), *map(pa.array, numbers)], ["id", "vector", "code", "length", "fit", "spread"])

    kinds = "id long, vector array<double>, code binary, length double, fit double, spread double"
    rows.mapInArrow(encode, kinds).write.parquet(f"{folder}/index")
    return spark.read.schema(kinds).parquet(f"{folder}/index"), dimension, mean, scale


def nearest(vectors: DataFrame, queries: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``queries``, a condition on ``vec_id``."""
    spark, folder = vectors.sparkSession, store.new_folder(vectors.sparkSession, "codes")
    stored, dimension, mean, scale = index(vectors, vector, vec_id, folder)
    rows, most = stored.count(), max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dimension)))
    drawn = stored.select("id", "vector").where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(rows, 1)))).toArrow()
    store.write(folder, "sample", 0, {"id": drawn.column("id").to_numpy(), "vector": matrix(drawn.column("vector").combine_chunks(), dimension) * scale})
    files = {"id": "i8", "vector": "f8"}
    asked = stored.withColumnRenamed("id", vec_id).where(queries).select(F.col(vec_id).alias("id"), "vector")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes query vectors as numbered files, each with the floor under its answer."""
        number = TaskContext.get().partitionId() << 12
        sample = store.mapped(folder, "sample", 0, files)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                ids, vectors = part.column(0).to_numpy(), matrix(part.column(1), dimension)
                store.write(folder, "query", number, {"id": ids, "vector": vectors, "floor": _floor(ids, vectors * scale, sample, k)})
                yield pa.RecordBatch.from_arrays([pa.array([number])], ["block"])
                number += 1

    numbers = sorted(r["block"] for r in asked.mapInArrow(blocks, "block long").collect())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                rows = _estimates(batch.slice(at, ROW_BLOCK), dimension)
                for number in numbers:
                    yield _search(rows, store.mapped(folder, "query", number, {**files, "floor": "f8"}), k, mean, scale)

    found = stored.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(ids: np.ndarray, vectors: np.ndarray, sample: dict[str, np.ndarray], k: int) -> np.ndarray:
    """The k-th best product of each query with the sample, without its own row."""
    score = vectors @ np.asarray(sample["vector"]).reshape(-1, vectors.shape[1]).T
    score[ids[:, None] == np.asarray(sample["id"])[None, :]] = -np.inf
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(ids), -np.inf)


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact products; in a wider type where double precision does not hold one, so that opposite terms still cancel."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = (rows * query).sum(1)
        if np.isfinite(score).all():
            return score
        return (rows.astype(np.longdouble) * query).sum(1)


def _estimates(rows: pa.RecordBatch, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, vector, estimated vector, bound of the error per length of a query) of some rows."""
    bits = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    length, fit, spread = (rows.column(i).to_numpy() for i in (3, 4, 5))
    estimate = decoded(bits, dimension) * (length / np.maximum(fit, 1e-12)).astype(np.float32)[:, None]
    slack = SURE * length * spread / np.sqrt(max(dimension - 1, 1)) + 1e-5 * length
    return rows.column(0).to_numpy(), matrix(rows.column(1), dimension), estimate, slack.astype(np.float32)


def _search(rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], block: dict[str, np.ndarray], k: int, mean: np.ndarray, unit: float) -> pa.RecordBatch:
    """The k best of some rows for each query of a block."""
    ids, exact, estimate, slack = rows
    asked, vectors, floor = np.asarray(block["id"]), np.asarray(block["vector"]).reshape(-1, len(mean)), np.asarray(block["floor"])
    scaled = vectors * unit
    upper = scaled.astype(np.float32) @ estimate.T
    upper += np.sqrt((scaled**2).sum(1)).astype(np.float32)[:, None] * slack
    reach = ~(upper < (floor - scaled @ mean).astype(np.float32)[:, None])  # what can't be judged is reranked
    found: tuple[list, list, list] = [], [], []
    for query in range(len(asked)):
        candidate = np.flatnonzero(reach[query])
        candidate = candidate[ids[candidate] != asked[query]]
        score = _products(exact[candidate], vectors[query])
        if len(score) > k:
            near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])  # with all ties
            candidate, score = candidate[near], score[near]
        order = np.lexsort((ids[candidate], -score))[:k]
        found[0].append(np.full(len(order), asked[query]))
        found[1].append(ids[candidate[order]])
        found[2].append(score[order].astype(np.float64))
    columns = [np.concatenate([np.zeros(0, kind), *part]) for part, kind in zip(found, (np.int64, np.int64, np.float64))]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_id", "vec_id", "score"])
