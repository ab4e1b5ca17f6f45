"""Removal of lines that stand in several documents, over levelled sorted runs of line hashes.

The key of a line is the line without white space at both ends and with A-Z lowered. Keys of at least
``least_chars`` code points that are found in ``least_docs`` documents lose all their lines except
those in the document with the largest id.

The index holds (128-bit line hash, document) entries, cut into shards by the hash. Each shard is a
set of sorted runs in levels. A batch comes as sorted pieces, one from each flush of a map task; the
shard's task merge-anti-joins every piece with the runs: an entry stays out if it is there already or
if the runs already know ``least_docs`` larger documents of its line, so that it can change nothing.
What is left is a new run of level 0, and ``FANOUT`` runs of one level are compacted into one run of
the next, which keeps the ``least_docs`` largest documents of a line. A line on any number of documents
is therefore a few entries, and merging is a union of sets: the order of batches and of tasks, and
tasks that run twice, change nothing.

Run files are named by shard and batch and never changed; a shard's list of runs is written last, for
every shard in every batch, and a reader that misses a list or a run fails. ``settled`` gathers the lines
that have enough documents into sorted files, which tasks map to judge the lines of their documents.

Null and empty texts are one empty line; null stays null. Ids are compared as longs, a null id is less
than all others (and equal to the least long), and rows that share an id are one document. Columns
besides the text pass through; ``n_lines`` and ``n_dropped`` replace columns of those names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tonewise.llm import store
from tonewise.llm.words import _BASE, _BYTE, CHUNK_BYTES, mix, powers, split_rows, text_bytes

#: Runs of one level that are compacted into one of the next.
FANOUT = 4
#: Bytes of a file of settled lines.
SETTLED_BYTES = 64 << 20
#: Entries that a map task holds before it sends them.
HELD = 500_000

#: A line's hash in two halves, and a document that holds it.
ENTRY = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8")])

_U64 = np.uint64
_FIRST = np.iinfo(np.int64).min
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A second set of byte values, for the lower half of a hash.
_OTHER = mix(_BYTE)


class Lines:
    """The lines of consecutive rows: byte ranges, rows, hashes of their keys, and which are long enough."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least_chars: int):
        n, self.data, self.offsets = len(data), data, offsets
        breaks = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, side="right") - 1])
        order = np.lexsort((starts, rows))
        self.starts, self.rows = starts[order], rows[order]
        last = np.append(self.rows[1:] != self.rows[:-1], True)[: len(rows)]
        self.ends = np.append(self.starts[1:] - 1, 0)[: len(rows)]
        self.ends[last] = offsets[self.rows[last] + 1]
        self.last = last

        full = np.flatnonzero(~_SPACE[data])
        low = np.searchsorted(full, self.starts)
        high = np.searchsorted(full, self.ends)
        some = high > low
        self.left, self.right = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        self.left[some], self.right[some] = full[low[some]], full[high[some] - 1] + 1
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.long = some & (leads[self.right] - leads[self.left] >= least_chars) if n else some
        up, down = powers(_BASE, n + 1)
        folded = _LOWER[data]
        size = (self.right - self.left).astype(_U64)
        self.high, self.low = (self._hash(values[folded], up, down, size) for values in (_BYTE, _OTHER))

    def _hash(self, values: np.ndarray, up: np.ndarray, down: np.ndarray, size: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, _U64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return mix((total[self.right] - total[self.left]) * down[self.left] + size)


def line_chunks(column: pa.Array, least_chars: int) -> Iterator[tuple[int, Lines]]:
    """The first row and the lines of a few megabytes of rows at a time."""
    data, offsets = text_bytes(column)
    for first, last in split_rows(offsets, CHUNK_BYTES):
        yield first, Lines(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], least_chars)


def doc_numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_FIRST).to_numpy(zero_copy_only=False)


def entries(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = np.empty(len(high), ENTRY)
    out["high"], out["low"], out["doc"] = high, low, doc
    return out


def compacted(runs: list[np.ndarray], most: int) -> np.ndarray:
    """One sorted run of the distinct entries, with the ``most`` largest documents of each line, largest first."""
    run = np.concatenate(runs) if runs else np.empty(0, ENTRY)
    if not len(run):
        return run
    run = run[np.lexsort((~run["doc"], run["low"], run["high"]))]
    same = (run["high"][1:] == run["high"][:-1]) & (run["low"][1:] == run["low"][:-1])
    run = run[np.concatenate([[True], ~(same & (run["doc"][1:] == run["doc"][:-1]))])]
    return run[_place(run) < most]


def _place(run: np.ndarray) -> np.ndarray:
    """Number of an entry among those of its line, from 0."""
    new = np.concatenate([[True], (run["high"][1:] != run["high"][:-1]) | (run["low"][1:] != run["low"][:-1])])
    at = np.arange(len(run))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _first(run: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Where the entries of each line begin in a sorted run, or would."""
    at = np.searchsorted(run["high"], high)
    while len(run):  # lines that share the first half of their hash
        inside = np.minimum(at, len(run) - 1)
        behind = (at < len(run)) & (run["high"][inside] == high) & (run["low"][inside] < low)
        if not behind.any():
            break
        at = at + behind
    return at


def antijoin(batch: np.ndarray, runs: list[np.ndarray], most: int) -> np.ndarray:
    """Entries of the sorted batch that are in no run and whose line has fewer than ``most`` larger documents in any one."""
    keep = np.ones(len(batch), bool)
    for run in runs:
        at = _first(run, batch["high"], batch["low"])
        larger = np.zeros(len(batch), np.int64)
        for step in range(most):
            inside = np.minimum(at + step, len(run) - 1) if len(run) else at
            if not len(run):
                break
            same = (at + step < len(run)) & (run["high"][inside] == batch["high"]) & (run["low"][inside] == batch["low"])
            keep &= ~(same & (run["doc"][inside] == batch["doc"]))
            larger += same & (run["doc"][inside] > batch["doc"])
        keep &= larger < most
    return batch[keep]


class Levels:
    """The runs of a shard: levels[i] holds fewer than FANOUT sorted runs."""

    def __init__(self, most: int, levels: list[list] | None = None):
        self.most = most
        self.levels: list[list[np.ndarray]] = levels or []

    def add(self, piece: np.ndarray) -> None:
        fresh = antijoin(piece, [r for level in self.levels for r in level], self.most)
        if not len(fresh):
            return
        for i in range(len(self.levels) + 1):
            if i == len(self.levels):
                self.levels.append([])
            self.levels[i].append(fresh)
            if len(self.levels[i]) < FANOUT:
                return
            fresh = compacted(self.levels[i], self.most)
            self.levels[i] = []

    def all(self) -> np.ndarray:
        return compacted([np.asarray(r) for level in self.levels for r in level], self.most)


def _put(folder: str, name: str, content: bytes | memoryview) -> None:
    """A whole file, or none; a task that runs again puts the same content in its place."""
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    attempt = f"{path}/{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        out.write(content)
    if files.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound or isinstance(files, fs.LocalFileSystem):
        files.move(attempt, f"{path}/{name}")
    else:
        files.delete_file(attempt)


def _get(folder: str, name: str) -> pa.Buffer:
    files, path = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{path}/{name}") as source:
        return source.read_buffer()


class LineIndex:
    """Levelled runs in a folder that all machines share; ``add`` takes a batch, in any order and any number of times."""

    def __init__(self, spark: SparkSession, bits: int, least_chars: int = 20, least_docs: int = 3, folder: str | None = None):
        if least_docs < 1:
            raise ValueError("a line needs at least one document")
        self.spark, self.bits, self.least_chars, self.least_docs = spark, bits, least_chars, least_docs
        self.folder = folder or store.new_folder(spark, "lines")
        self.batches = 0

    def add(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> None:
        bits, least_chars, most = self.bits, self.least_chars, self.least_docs
        folder, batch, before = self.folder, self.batches, self.batches - 1

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def flushed() -> pa.RecordBatch:
                run = compacted(held, most)
                shards = store.shard_of(run["high"], bits)
                cut = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(run) else np.zeros(0, np.int64)
                runs = [run[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(run)])]
                return pa.RecordBatch.from_arrays([pa.array(shards[cut], pa.int32()), pa.array(runs, pa.binary())], ["shard", "run"])

            for part in batches:
                ids = doc_numbers(part.column(0))
                for first, lines in line_chunks(part.column(1), least_chars):
                    at = lines.long
                    held.append(compacted([entries(lines.high[at], lines.low[at], ids[first + lines.rows[at]])], most))
                    size += len(held[-1])
                    if size >= HELD:
                        yield flushed()
                        held, size = [], 0
            if size:
                yield flushed()

        def grown(table: pa.Table) -> pa.Table:
            shard = table.column("shard")[0].as_py()
            names = json.loads(_get(folder, f"runs-{before:05d}-{shard:07d}").to_pybytes()) if batch else []
            old, held = {}, []
            for level in names:
                held.append([])
                for name in level:
                    run = np.frombuffer(_get(folder, name), ENTRY)
                    old[id(run)] = name, run  # held, so that no other run gets its id
                    held[-1].append(run)
            levels = Levels(most, held)
            for piece in sorted(b.as_py() for b in table.column("run") if b.is_valid):
                levels.add(np.frombuffer(piece, ENTRY))
            listed = []
            for i, level in enumerate(levels.levels):
                listed.append([])
                for j, run in enumerate(level):
                    name, _ = old.get(id(run), (None, None))
                    if name is None:
                        name = f"run-{batch:05d}-{shard:07d}-{i}-{j}"
                        _put(folder, name, memoryview(np.ascontiguousarray(run)).cast("B"))
                    listed[-1].append(name)
            _put(folder, f"runs-{batch:05d}-{shard:07d}", json.dumps(listed).encode())
            return pa.table({"shard": pa.array([shard], pa.int32())})

        sent = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInArrow(pieces, "shard int, run binary")
        every = self.spark.range(1 << bits).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("run"))
        done = sent.unionByName(every).groupBy("shard").applyInArrow(grown, "shard int").count()
        if done != 1 << bits:
            raise RuntimeError(f"{done} of {1 << bits} shards were written")
        self.batches += 1

    def settled(self) -> tuple[str, int]:
        """Folder and bits of sorted files of the lines with enough documents, and the largest of these."""
        bits, most, folder, last = self.bits, self.least_docs, self.folder, self.batches - 1

        def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for shard in part.column(0).to_pylist():
                    levels = json.loads(_get(folder, f"runs-{last:05d}-{shard:07d}").to_pybytes())
                    run = Levels(most, [[np.frombuffer(_get(folder, name), ENTRY) for name in level] for level in levels]).all()
                    at = np.flatnonzero(_place(run) == most - 1) - (most - 1) if len(run) else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([run[at].tobytes()], pa.binary())], ["shard", "run"])

        shards = self.spark.range(1 << bits).select(F.col("id").cast("int").alias("shard"))
        at = f"{folder}/settled-{self.batches:05d}-{uuid.uuid4().hex}"
        shards.mapInArrow(repeated, "shard int, run binary").write.parquet(f"{at}/runs")
        runs = self.spark.read.schema("shard int, run binary").parquet(f"{at}/runs")
        size = runs.agg(F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).first()[0]
        files = min(bits, max(0, int(size // SETTLED_BYTES)).bit_length())

        def gathered(table: pa.Table) -> pa.Table:
            """Shards are ranges of the hash, so their runs follow one another."""
            table = table.sort_by("shard")
            number = table.column("file")[0].as_py()
            _put(at, f"lines-{number:07d}", b"".join(b.as_py() for b in table.column("run")))
            return pa.table({"file": pa.array([number], pa.int32())})

        number = F.shiftright("shard", bits - files).alias("file")
        done = runs.select(number, "shard", "run").groupBy("file").applyInArrow(gathered, "file int").count()
        if done != 1 << files:
            raise RuntimeError(f"{done} of {1 << files} files were written")
        return at, files

    def dedupe(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """All columns, the text without repeated lines, ``n_lines`` (before) and ``n_dropped``."""
        folder, files = self.settled()
        least_chars = self.least_chars
        docs = docs.drop("n_lines", "n_dropped")
        names = docs.columns
        where, number = names.index(text), names.index(doc_id)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = doc_numbers(batch.column(number))
                for first, lines in line_chunks(batch.column(where), least_chars):
                    n = len(lines.offsets) - 1
                    part = batch.slice(first, n)
                    gone = np.zeros(len(lines.rows), bool)
                    asked = np.flatnonzero(lines.long)
                    gone[asked] = _kept_elsewhere(folder, files, lines.high[asked], lines.low[asked], ids[first + lines.rows[asked]])
                    texts = part.column(where)
                    if gone.any():
                        texts = _without(lines, gone, texts)
                    columns = [texts if i == where else part.column(i) for i in range(len(names))]
                    columns += [pa.array(np.bincount(lines.rows, minlength=n)), pa.array(np.bincount(lines.rows[gone], minlength=n))]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])

        return docs.mapInArrow(cut, StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())]))


@lru_cache(maxsize=8)
def _file(folder: str, number: int) -> np.ndarray:
    files, path = fs.FileSystem.from_uri(folder)
    at = f"{path}/lines-{number:07d}"
    if not isinstance(files, fs.LocalFileSystem):
        return np.frombuffer(_get(folder, f"lines-{number:07d}"), ENTRY)
    return np.memmap(at, ENTRY, "r") if files.get_file_info(at).size else np.frombuffer(_get(folder, f"lines-{number:07d}"), ENTRY)


def _kept_elsewhere(folder: str, bits: int, high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lines that are settled on another document."""
    out = np.zeros(len(high), bool)
    order = np.argsort(high, kind="stable")
    shards = store.shard_of(high[order], bits)
    edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        run, mine = _file(folder, int(shards[a])), order[a:b]
        if not len(run):
            continue
        at = _first(run, high[mine], low[mine])
        inside = np.minimum(at, len(run) - 1)
        found = (at < len(run)) & (run["high"][inside] == high[mine]) & (run["low"][inside] == low[mine])
        out[mine] = found & (run["doc"][inside] != doc[mine])
    return out


def _without(lines: Lines, gone: np.ndarray, texts: pa.Array) -> pa.Array:
    """The texts without the lines that go; the others stay joined by line breaks."""
    n = len(lines.offsets) - 1
    edge = np.zeros(len(lines.data) + 1, np.int64)
    # A line goes with the break after it; if no line of the text follows that stays, the break before goes too.
    np.add.at(edge, lines.starts[gone], 1)
    np.add.at(edge, (lines.ends + ~lines.last)[gone], -1)
    keep = np.cumsum(edge[:-1]) == 0
    stays = np.flatnonzero(~gone)
    final = stays[np.append(lines.rows[stays][1:] != lines.rows[stays][:-1], True)] if len(stays) else stays
    final = final[~lines.last[final]]
    keep[lines.ends[final]] = False
    sizes = np.concatenate([[0], np.cumsum(keep)])[lines.offsets]
    kind = pa.large_string() if pa.types.is_large_string(texts.type) else pa.string()
    offsets = sizes.astype("<i8" if kind == pa.large_string() else "<i4")
    data = lines.data[keep]
    valid = pc.is_valid(texts).cast(pa.uint8()).to_numpy(zero_copy_only=False)
    bitmap = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind, n, [bitmap, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``LineIndex.dedupe`` of one table as one batch."""
    index = LineIndex(docs.sparkSession, store.shard_bits(docs), least_chars, least_docs)
    index.add(docs, text, doc_id)
    return index.dedupe(docs, text, doc_id)


#: DuckDB SQL for the query's rows.
ORACLE = """
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key)
GROUP BY doc_id
"""
