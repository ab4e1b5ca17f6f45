"""Sorted hash arrays in the shared folder, built by Spark tasks and memory-mapped by workers.

A table of (key, values ...) is cut into shards by the upper bits of the key. Map tasks send each
shard one packed row per batch, reducers merge them, and each shard becomes one file of all its
columns. Every shard of a table has a file, so one that is missing is an error and never an empty
answer. A worker maps the files it needs, the last few of them; the system's page cache holds one copy
a machine. On a store that cannot be mapped a file is first copied to an unnamed local file.
"""

from __future__ import annotations

import mmap
import sys
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one shard is meant to stand for.
SHARD_BYTES = 16 << 20

#: Files that a worker keeps mapped.
MAPS = 128

_U64 = np.uint64
_open: OrderedDict[tuple[str, str, int], memoryview] = OrderedDict()


def size_of(conf: str) -> int:
    """Bytes of a Spark size such as 16m or 134217728b."""
    text = conf.strip().lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1:], 1)
    return int(text[:-1] if scale > 1 else text) * scale


def shard_bits(df: DataFrame) -> int:
    """log2 of the number of shards: follows the bytes that the scan of ``df`` was split into."""
    spark = df.sparkSession
    split = size_of(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    shards = max(8, df.rdd.getNumPartitions() * split // SHARD_BYTES)
    return min(20, int(shards - 1).bit_length())


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> _U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def merged(keys: np.ndarray, values: dict[str, np.ndarray], how: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Sorted distinct keys; values of one key are reduced by add, min or max."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    reduce = {"add": np.add, "min": np.minimum, "max": np.maximum}
    return keys[first], {k: reduce[how[k]].reduceat(v[order], first) for k, v in values.items()}


def pack(keys: np.ndarray, values: dict[str, np.ndarray], bits: int) -> pa.RecordBatch:
    """One row per shard that has any of the (sorted) keys: shard, and a packed column each."""
    shards = shard_of(keys, bits)
    cut = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(keys)]]) if len(cut) else cut
    packed = {"key": keys, **values}
    columns = [pa.array(shards[cut], pa.int32())]
    columns += [pa.array([v[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for v in packed.values()]
    return pa.RecordBatch.from_arrays(columns, ["shard", *packed])


def schema(fields: dict[str, str]) -> str:
    return "shard int, key binary, " + ", ".join(f"{k} binary" for k in fields) if fields else "shard int, key binary"


def unpack(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    parts = [np.frombuffer(b.as_buffer(), dtype) for b in table.column(name) if b.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class Writer:
    """Collects keyed values of one task and sends them, reduced, as packed rows."""

    def __init__(self, fields: dict[str, str], how: dict[str, str], bits: int, limit: int = 1_000_000):
        self.fields, self.how, self.bits, self.limit = fields, how, bits, limit
        self.parts: list[tuple[np.ndarray, dict[str, np.ndarray]]] = []
        self.held = 0

    def add(self, keys: np.ndarray, values: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        keys, values = merged(keys, values, self.how)
        self.parts.append((keys, values))
        self.held += len(keys)
        return self.flush() if self.held >= self.limit else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        keys = np.concatenate([k for k, _ in self.parts])
        values = {f: np.concatenate([v[f] for _, v in self.parts]) for f in self.fields}
        self.parts, self.held = [], 0
        keys, values = merged(keys, values, self.how)
        return pack(keys, {f: v.astype(self.fields[f]) for f, v in values.items()}, self.bits)


def reduced(table: pa.Table, fields: dict[str, str], how: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The merged content of a shard's packed rows."""
    return merged(unpack(table, "key", "u8"), {f: unpack(table, f, d) for f, d in fields.items()}, how)


def _room(n: int, dtype: str) -> int:
    """Bytes of a column in a file; columns begin at multiples of 8."""
    return -(-n * np.dtype(dtype).itemsize // 8) * 8


def write(folder: str, name: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """The file of a shard: the number of columns, their lengths, and then the columns.

    A file appears whole or not at all. A task that runs again has the same content: on a local disk it
    replaces the file, elsewhere the file that is there stays.
    """
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    target = f"{path}/{name}-{shard:07d}"
    attempt = f"{target}.{uuid.uuid4().hex}"
    with files.open_output_stream(attempt) as out:
        out.write(np.array([len(arrays), *(np.asarray(v).size for v in arrays.values())], "<i8").tobytes())
        for values in arrays.values():
            data = np.ascontiguousarray(values)
            if data.size:
                out.write(memoryview(data).cast("B"))
                out.write(bytes(_room(data.size, data.dtype.str) - data.nbytes))
    if isinstance(files, fs.LocalFileSystem) or files.get_file_info(target).type == fs.FileType.NotFound:
        files.move(attempt, target)
    else:
        files.delete_file(attempt)


def _mapped_file(at: str) -> memoryview:
    """A file's bytes, mapped; the handle is closed at once where Python can do without it."""
    with open(at, "rb") as file:
        if sys.version_info >= (3, 13):
            return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
        return memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


def mapped(folder: str, name: str, shard: int, fields: dict[str, str]) -> dict[str, np.ndarray]:
    """The arrays of a shard, mapped into memory; ``fields`` are its first columns in the order they were written.

    The last ``MAPS`` files stay mapped. A shard without a file raises FileNotFoundError.
    """
    key = (folder, name, shard)
    data = _open.get(key)
    if data is None:
        files, path = fs.FileSystem.from_uri(folder)
        at = f"{path}/{name}-{shard:07d}"
        if isinstance(files, fs.LocalFileSystem):
            data = _mapped_file(at)
        else:
            with tempfile.NamedTemporaryFile() as copy, files.open_input_stream(at) as source:
                while block := source.read(8 << 20):
                    copy.write(block)
                copy.flush()
                data = _mapped_file(copy.name)
        while len(_open) >= MAPS:
            _open.popitem(last=False)
        _open[key] = data
    _open.move_to_end(key)
    columns = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", columns, 8)
    found, at = {}, 8 + 8 * columns
    for (field, dtype), n in zip(fields.items(), sizes.tolist()):
        found[field] = np.frombuffer(data, dtype, n, at) if n else np.zeros(0, dtype)
        at += _room(n, dtype)
    return found


def lookup(folder: str, name: str, bits: int, keys: np.ndarray, fields: dict[str, str], missing: dict[str, float]) -> dict[str, np.ndarray]:
    """Values of the given keys, ``missing`` where a key is absent, and ``found``."""
    distinct, back = np.unique(keys, return_inverse=True)
    out = {f: np.full(len(distinct), missing[f], d) for f, d in fields.items()}
    found = np.zeros(len(distinct), bool)
    shards = shard_of(distinct, bits)
    edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(distinct) else []
    for a, b in zip(edges, [*edges[1:], len(distinct)]):
        arrays = mapped(folder, name, int(shards[a]), {"key": "u8", **fields})
        if len(arrays["key"]):
            part = distinct[a:b]
            at = np.minimum(np.searchsorted(arrays["key"], part), len(arrays["key"]) - 1)
            hit = arrays["key"][at] == part
            found[a:b] = hit
            for f in fields:
                out[f][a:b][hit] = arrays[f][at[hit]]
    return {"found": found[back], **{f: v[back] for f, v in out.items()}}


def every_shard(packed: DataFrame, bits: int) -> DataFrame:
    """Packed rows and one empty row for each shard, so that all shards are written."""
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in packed.dtypes if name != "shard"]
    return packed.unionByName(packed.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("shard"), *rest))


def build(packed: DataFrame, folder: str, name: str, bits: int, fields: dict[str, str], how: dict[str, str], keep: Callable | None = None) -> int:
    """Merge packed rows into the files of a table, one for each shard; returns its number of keys.

    ``keep`` maps the merged (keys, values) of a shard to the arrays to store, among them ``key``.
    """

    def one(table: pa.Table) -> pa.Table:
        keys, values = reduced(table, fields, how)
        shard = table.column("shard")[0].as_py()
        arrays = keep(keys, values) if keep else {"key": keys, **values}
        write(folder, name, shard, arrays)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(arrays["key"])], pa.int64())})

    written = every_shard(packed, bits).groupBy("shard").applyInArrow(one, "shard int, n long")
    n, files = written.agg(F.sum("n"), F.count("*")).first()
    if files != 1 << bits:
        raise RuntimeError(f"{files} of {1 << bits} shards of {name} were written")
    return n or 0


def new_folder(spark: SparkSession, label: str) -> str:
    from tonewise.session import scratch_dir

    return scratch_dir(spark, label)
