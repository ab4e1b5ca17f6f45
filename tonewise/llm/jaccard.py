"""Exact Jaccard self-join of word shingles by signature trees: links per document and connected components.

1. Every text becomes its set of distinct shingles. Texts with one set are one class, represented by
   the smallest id; only representatives go on, so thousands of copies cost one.
2. Two linked sets differ in at most D shingles. Each set is dealt by hash into a few more than D
   parts; then at least one part that is not empty is the same in both. Shingles that many texts of
   a task hold are left out of the parts of sets that have enough others (which ones are left out
   has no influence on the result), so a passage in every third text does not connect them. Equal
   parts connect their owners to the smallest of them. Sets whose parts are too often empty also
   offer the smallest hashes of their shingles, which two linked sets share. So no link crosses the connected
   components of this candidate graph, and most texts are in none.
3. Each component goes to one task, which bulk-loads a signature tree (a node holds the OR of the
   token bitmaps below it, the range of sizes and the least number of bits) and traverses it against
   itself. A pair of nodes is dropped only when even their largest possible overlap is too small;
   all other pairs of leaves are verified on the sets, and each link is counted on both sides, with
   the number of copies of the other side. The classes follow from these links.
4. A component of more than ``BLOCK`` shingles is dealt into blocks by size and hash. A block is one file
   in the shared folder and a task maps two of them, so what is written grows with the sets and not with
   the pairs of blocks. Every block is compared with itself and with those of sizes that can be linked,
   each pair of sets in one task. No link is lost by this.

Documents without words have an empty set and are linked with nothing. Texts shorter than a shingle
are one shingle. Rows with a null id get no class and are nobody's link. Rows that share an id are
classed and counted by their own text. The order of rows does not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm import store
from tonewise.llm.graph import components
from tonewise.llm.words import Chunk, chunks, grams, inside, mix, unmix

#: Shingles that one tree takes; larger candidate components are dealt into blocks.
BLOCK = 4_000_000
#: A shingle is common if, among about a million shingles of one task, so many texts and this share of them hold it.
COMMON_TEXTS = 8
COMMON_SHARE = 0.01
FANOUT = 8

_U64 = np.uint64


def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within a row, and the row bounds."""
    at = inside(chunk.bounds, n)
    row = np.searchsorted(chunk.bounds, at, side="right") - 1
    values = grams(chunk.hashes, n)[at] if len(at) else np.zeros(0, _U64)
    counts = chunk.counts
    for few in range(1, n):
        short = np.flatnonzero(counts == few)
        if len(short):
            value = grams(chunk.hashes, few)[chunk.bounds[short]]
            values, row = np.concatenate([values, mix(value + _U64(few))]), np.concatenate([row, short])
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    if len(values):
        first = np.concatenate([[True], (values[1:] != values[:-1]) | (row[1:] != row[:-1])])
        values, row = values[first], row[first]
    return values, np.searchsorted(row, np.arange(chunk.rows + 1))


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.concatenate([np.zeros(1, _U64), np.cumsum(mix(values + _U64(17)), dtype=_U64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + mix(np.diff(bounds).astype(_U64)))


class Parts:
    """How sets of each size are dealt into parts, for links at num / den."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity is a fraction above 0 and at most 1")
        self.num, self.den = num, den
        grow = max(1.4, 1.1 * den / num)
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * grow)))
        self.edges = np.array(edges)
        most = self.differ(2 * (self.edges[1:] - 1))
        self.parts = most + 2 + most // 32

    def differ(self, both: np.ndarray) -> np.ndarray:
        """The most shingles in which linked sets of these summed sizes can differ."""
        return (self.den - self.num) * both // (self.den + self.num)

    def keys(self, values: np.ndarray, bounds: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all rows and the row of each; linked rows with different sets share a key.

        ``common`` marks shingles that very many texts hold. Leaving them out of both sets of a pair
        does not make the pair differ in more, so parts are first made of the others; rows for which
        those are too few also offer parts of all their shingles, and if need be their first ones.
        """
        sizes = np.diff(bounds)
        if common is None or not common.any():
            keys, owners, lacking = self._parts(values, bounds, sizes, np.ones(len(sizes), bool), 1)
            found = [(keys, owners)]
        else:
            rare = np.concatenate([[0], np.cumsum(~common)])
            keys, owners, lacking = self._parts(values[~common], rare[bounds], sizes, np.ones(len(sizes), bool), 1)
            found = [(keys, owners)]
            keys, owners, lacking = self._parts(values, bounds, sizes, lacking, 2)
            found.append((keys, owners))
        for row in np.flatnonzero(lacking):
            n = int(sizes[row])
            prefix = n + (-self.num * n) // self.den + 1  # n - ceil(similarity * n) + 1
            found.append((mix(values[bounds[row] : bounds[row] + prefix] + _U64(43)), np.full(prefix, row)))
        return np.concatenate([k for k, _ in found]), np.concatenate([o for _, o in found])

    def _parts(self, values: np.ndarray, bounds: np.ndarray, sizes: np.ndarray, of: np.ndarray, space: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the parts of the rows ``of``, their owners, and the rows whose filled parts are too few."""
        kind = np.searchsorted(self.edges, sizes, side="right") - 1
        largest = sizes * self.den // self.num
        held = np.diff(bounds)
        lacking = np.zeros(len(sizes), bool)
        keys, owners = [np.zeros(0, _U64)], [np.zeros(0, np.int64)]
        for ahead in (0, 1):
            to = kind + ahead
            limit = self.edges[np.minimum(to + 1, len(self.edges) - 1)] - 1
            differ = self.differ(sizes + np.minimum(limit, largest))
            rows = np.flatnonzero(of & (sizes > 0) & (differ > 0) & ((ahead == 0) | (largest >= self.edges[to])))
            if not len(rows):
                continue
            count = self.parts[to[rows]]
            first = np.cumsum(count) - count
            size = held[rows]
            flat = np.repeat(bounds[rows] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            part = ((values[flat] >> _U64(33)) * np.repeat(count, size).astype(_U64)) >> _U64(31)
            part = part.astype(np.int64) + np.repeat(first, size)
            sums = np.zeros(int(count.sum()), _U64)
            np.add.at(sums, part, mix(values[flat] + _U64(29)))
            use = np.bincount(part, minlength=len(sums)) > 0
            owner = np.repeat(rows, count)
            place = np.arange(len(sums)) - np.repeat(first, count)
            name = mix((np.repeat(to[rows], count).astype(_U64) << _U64(40)) + (place.astype(_U64) << _U64(2)) + _U64(space))
            keys.append(mix(sums + name)[use])
            owners.append(owner[use])
            filled = np.bincount(owner[use], minlength=len(sizes))
            lacking[rows] |= filled[rows] <= differ[rows]
        return np.concatenate(keys), np.concatenate(owners), lacking


class Common:
    """Collects shingles that a noticeable share of a task's texts hold."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.texts = self.held = 0

    def add(self, values: np.ndarray, texts: int) -> np.ndarray:
        self.values.append(values)
        self.texts += texts
        self.held += len(values)
        return self.found() if self.held > 1_000_000 else values[:0]

    def found(self) -> np.ndarray:
        values = np.sort(np.concatenate([np.zeros(0, _U64), *self.values]))
        least = max(COMMON_TEXTS, int(self.texts * COMMON_SHARE))
        self.values, self.texts, self.held = [], 0, 0
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        return values[at[np.diff(np.append(at, len(values))) >= least]]


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Smallest id per key, and the distinct edges from it to the others of the key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    low = np.repeat(ids[at], np.diff(np.append(at, len(ids))))
    other = low != ids
    a, b = distinct_edges(ids[other], low[other])
    return keys[first], ids[first], a, b


def distinct_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[keep], b[keep]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up


class SignatureTree:
    """Sets under nodes that hold OR-combined bitmaps, size ranges and least bit counts.

    With ``sides``, which must ascend, only sets of different sides are compared.
    """

    def __init__(self, sets: list[np.ndarray], sides: np.ndarray | None = None):
        self.size = size = np.array([len(s) for s in sets])
        words = 16
        while words * 64 < 2 * size.max() and words < 1024 and words * len(sets) < 1 << 21:
            words *= 2
        bits = np.zeros((len(sets), words), _U64)
        row = np.repeat(np.arange(len(sets)), size)
        flat = np.concatenate(sets)
        spread = mix(flat + _U64(61))
        np.bitwise_or.at(bits, (row, (spread >> _U64(6)).astype(np.int64) % words), _U64(1) << (spread & _U64(63)))
        held = np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, held)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, held = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(held, at)))
        self.sides = None if sides is None else [(sides, sides)]
        for _ in self.levels[1:] if self.sides else ():
            low, high = self.sides[-1]
            at = np.arange(0, len(low), FANOUT)
            self.sides.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
        distinct, codes = np.unique(flat, return_inverse=True)
        self.codes = np.split(codes.astype(np.int32), np.cumsum(size)[:-1])
        self.mark = np.zeros(len(distinct), np.uint8)

    def join(self, num: int, den: int, copies: np.ndarray) -> tuple[Forest, np.ndarray]:
        """Connects all pairs of sets whose similarity is at least num / den, and counts for each set the copies of those it is linked with."""
        forest, links = Forest(len(self.size)), np.zeros(len(self.size), np.int64)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > (4096 if level else 1 << 16):
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            keep = self._possible(level, a, b, num, den)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level:
                n = len(self.levels[level - 1][0])
                child = np.arange(FANOUT)
                left = np.repeat(a[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
                right = np.tile(b[:, None] * FANOUT + child, (1, FANOUT)).ravel()
                keep = (left < n) & (right < n) & ((left < right) | ((left == right) & (level > 1)))
                stack.append((level - 1, left[keep], right[keep]))
                continue
            both = self._overlaps(a, b)
            keep = (a != b) & (den * both >= num * (self.size[a] + self.size[b] - both))
            a, b = a[keep], b[keep]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            roots = forest.roots()
            for i, j in np.unique(np.stack([roots[a], roots[b]], axis=1)[roots[a] != roots[b]], axis=0).tolist():
                forest.join(i, j)
        return forest, links

    def _overlaps(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles each pair of leaves shares."""
        order = np.argsort(a, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
        out = np.empty(len(a), np.int64)
        for at in np.split(order, first[1:]):
            own, others = self.codes[a[at[0]]], b[at]
            for few in np.array_split(np.arange(len(at)), max(1, int(self.size[others].sum()) >> 22)):
                if len(few):
                    self.mark[own] = 1
                    hit = self.mark[np.concatenate([self.codes[i] for i in others[few].tolist()])]
                    self.mark[own] = 0
                    size = self.size[others[few]]
                    out[at[few]] = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        return out

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        bits, low, high, held = self.levels[level]
        keep = (den * high[a] >= num * low[b]) & (den * high[b] >= num * low[a])
        if self.sides:
            least, most = self.sides[level]
            keep &= (np.minimum(least[a], least[b]) != np.maximum(most[a], most[b]))
        shared = np.zeros(len(a), np.int64)
        some = np.flatnonzero(keep & (a != b))
        for at in np.array_split(some, max(1, len(some) * bits.shape[1] >> 20)):
            shared[at] = np.bitwise_count(bits[a[at]] & bits[b[at]]).sum(1, dtype=np.int64)
        # A set bit that the other side lacks stands for a shingle that the other side lacks.
        most = np.minimum(high[a] - np.maximum(held[a] - shared, 0), high[b] - np.maximum(held[b] - shared, 0))
        return keep & ((a == b) | ((num + den) * most >= num * (low[a] + low[b])))


def counted(sets: list[np.ndarray], copies: np.ndarray, num: int, den: int, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number of its class, and the copies of all other sets it is linked with."""
    keys = ([len(s) for s in sets], [s[0] for s in sets])  # similar sets tend to share their smallest hash
    order = np.lexsort(keys if sides is None else (*keys, sides))
    forest, links = SignatureTree([sets[i] for i in order], None if sides is None else sides[order]).join(num, den, copies[order])
    of, count = np.empty(len(sets), np.int64), np.empty(len(sets), np.int64)
    of[order], count[order] = forest.roots(), links
    return of, count


def smallest(of: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest id of its class."""
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, of, ids)
    return low[of]


def linked(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set, the smallest id connected with it."""
    return smallest(counted(sets, np.ones(len(sets), np.int64), num, den)[0], ids)


MEMBER = {"group": "i8"}
PLACED = {"group": "i8", "blocks": "i8"}
BLOCKED = {"set_key": "i8", "id": "i8", "copies": "i8", "n": "i8", "items": "u8"}
FIRST = {"group": "i8", "copies": "i8"}
NAMED = {"low": "i8", "links": "i8"}
SIEVE = 1 << 22
_sieves: dict[str, np.ndarray] = {}


def _sieve(folder: str, bits: int) -> np.ndarray:
    """Which lower bits some common shingle has; most other shingles need no further look."""
    if folder not in _sieves:
        _sieves.clear()
        _sieves[folder] = np.zeros(SIEVE, bool)
        for shard in range(1 << bits):
            keys = store.mapped(folder, "common", shard, {"key": "u8", **MEMBER})["key"]
            _sieves[folder][(unmix(np.asarray(keys)) & _U64(SIEVE - 1)).astype(np.int64)] = True
    return _sieves[folder]


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, by the links of ``links``."""
    return links(docs, text, doc_id, n, num, den, block).drop("n_links")


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4, num: int = 85, den: int = 100, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row: two documents link when den * |x & y| >= num * |x | y|.

    ``n_links`` counts all other rows that the row links with, copies of its own text among them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    folder, bits = store.new_folder(spark, "jaccard"), store.shard_bits(docs)
    parts = Parts(num, den)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and hash of each set; a size of -1 marks a common shingle."""
        common, names = Common(), ["id", "n", "set_key"]

        def listed(values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(np.full(len(values), -1)), pa.array(values.view("i8"))], names)

        for batch in batches:
            for chunk in chunks(batch.column(1), lower=True):
                values, bounds = shingle_sets(chunk, n)
                ids = batch.column(0).slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds), pa.int64()), pa.array(set_keys(values, bounds).view("i8"))], names)
                yield listed(common.add(values, chunk.rows))
        yield listed(common.found())

    docs.mapInArrow(digests, "id long, n long, set_key long").write.parquet(f"{folder}/digests")
    digest = spark.read.schema("id long, n long, set_key long").parquet(f"{folder}/digests")
    common = digest.where("n = -1").select("set_key").distinct()
    digest = digest.where("n >= 0")
    distinct = digest.where("n > 0 and id is not null").groupBy("set_key", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    distinct.write.parquet(f"{folder}/distinct")
    distinct = spark.read.schema("set_key long, n long, id long, copies long").parquet(f"{folder}/distinct")

    def save(rows: DataFrame, name: str, fields: dict[str, str]) -> None:
        """Keeps (key, fields ...) as arrays."""
        how = {f: "min" for f in fields}

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = store.Writer(fields, how, bits)
            for batch in batches:
                if (out := sent.add(mix(batch.column(0).to_numpy().view("u8")), {f: batch.column(i).to_numpy() for i, f in enumerate(fields, 1)})) is not None:
                    yield out
            if (out := sent.flush()) is not None:
                yield out

        store.build(rows.mapInArrow(members, store.schema(fields)), folder, name, bits, fields, how)

    save(distinct.select("set_key", "id", "copies"), "first", FIRST)
    save(common.select(F.col("set_key"), F.lit(0).cast("long")), "common", MEMBER)

    def is_common(values: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(_sieve(folder, bits)[(values & _U64(SIEVE - 1)).astype(np.int64)])
        out = np.zeros(len(values), bool)
        out[maybe] = store.lookup(folder, "common", bits, mix(values[maybe]), {}, {})["found"]
        return out

    def sets_of(batch: pa.RecordBatch, grouped: bool) -> Iterator[tuple]:
        """(set keys, columns of the sets, values, bounds) of one row at least of each set, if ``grouped`` of those in a candidate component."""
        for chunk in chunks(batch.column(1), lower=True):
            column = batch.column(0).slice(chunk.first, chunk.rows)
            ids = column.fill_null(0).to_numpy(zero_copy_only=False)
            values, bounds = shingle_sets(chunk, n)
            key = set_keys(values, bounds)
            own = store.lookup(folder, "first", bits, mix(key), FIRST, {"group": 0, "copies": 0})
            keep = own["found"] & (own["group"] == ids) & column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bounds) > 0)
            columns = {"id": ids, "copies": own["copies"]}
            if grouped:
                group = store.lookup(folder, "group", bits, mix(key), PLACED, {"group": 0, "blocks": 0})
                keep &= group["found"]
                columns |= {"component": group["group"], "blocks": group["blocks"]}
            size = np.diff(bounds)[keep]
            flat = np.repeat(bounds[:-1][keep] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            yield key[keep].view("i8"), {k: v[keep] for k, v in columns.items()}, values[flat], np.concatenate([[0], np.cumsum(size)])

    shape = ["shard", "key", "id", "a", "b"]

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, low, a, b = _stars(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
            held.clear()
            size = 1 << bits
            cut = np.searchsorted(store.shard_of(keys, bits), np.arange(size + 1))
            where = (mix(a.view("u8")) >> _U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)
            order = np.argsort(where, kind="stable")
            a, b, edge = a[order], b[order], np.searchsorted(where[order], np.arange(size + 1))
            use = [s for s in range(size) if cut[s + 1] > cut[s] or edge[s + 1] > edge[s]]
            columns = [pa.array(use, pa.int32())]
            for values, at in ((keys, cut), (low, cut), (a, edge), (b, edge)):
                columns.append(pa.array([values[at[s] : at[s + 1]].tobytes() for s in use], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, shape)

        for batch in batches:
            for sets, _, values, bounds in sets_of(batch, False):
                keys, owners = parts.keys(values, bounds, is_common(values))
                held.append((keys, sets[owners]))
                if sum(len(k) for k, _ in held) > 3_000_000:
                    yield flush()
        if held:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        _, _, a, b = _stars(store.unpack(table, "key", "u8"), store.unpack(table, "id", "i8"))
        a, b = distinct_edges(np.concatenate([a, store.unpack(table, "a", "i8")]), np.concatenate([b, store.unpack(table, "b", "i8")]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    offered = docs.mapInArrow(offers, "shard int, key binary, id binary, a binary, b binary")
    offered.groupBy("shard").applyInArrow(meet, "a long, b long").write.parquet(f"{folder}/edges")
    groups = components(spark.read.schema("a long, b long").parquet(f"{folder}/edges"))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.schema("id long, component long").parquet(f"{folder}/groups")
    width = math.log(den / num) + 1e-6  # sets that link are of one kind, or of kinds that follow one another
    sized = groups.join(distinct.select(F.col("set_key").alias("id"), "n"), "id").withColumn("kind", F.floor(F.log(F.col("n").cast("double")) / width))
    kinds = sized.groupBy("component", "kind").agg(F.sum("n").alias("n"))
    large = kinds.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > block).select("component")
    kinds = kinds.join(large, "component").select("component", "kind", F.ceil(2 * F.col("n") / block).alias("blocks"))
    placed = sized.join(kinds, ["component", "kind"], "left").select("id", "component", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    save(placed, "group", PLACED)

    names = ["place", "component", "kind", "part", "set_key", "id", "copies", "items"]

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidate sets and where they are compared: with their component (kind and part are -1), or in a block of it."""
        for batch in batches:
            for keys, of, values, bounds in sets_of(batch, True):
                sets = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                big, component = of["blocks"] > 0, of["component"].view("u8")
                kind = np.where(big, np.floor(np.log(np.maximum(np.diff(bounds), 1)) / width).astype(np.int64), -1)
                part = np.where(big, (mix(keys.view("u8") + _U64(7)) % np.maximum(of["blocks"], 1).astype(_U64)).astype(np.int64), -1)
                place = np.where(big, mix(mix(mix(component) + kind.view("u8")) + part.view("u8")), mix(component) % _U64(2 << bits)).view("i8")
                yield pa.RecordBatch.from_arrays([*map(pa.array, (place, of["component"], kind, part, keys, of["id"], of["copies"])), sets], names)

    def judged(table: pa.Table) -> pa.Table:
        """(key, smallest key and id of its class, links) of the sets of small components; blocks are stored: (component, kind, part, -1)."""
        component, kind, part, keys, ids, copies = (table.column(c).to_numpy() for c in names[1:7])
        items = [np.frombuffer(x.as_buffer(), "u8") for x in table.column("items")]
        order = np.lexsort((keys, part, kind, component))  # rows that share their id and text are one set
        group = np.stack([component, kind, part])[:, order]
        other = np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)])
        use = other | np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        order, cut = order[use], np.flatnonzero(other[use])
        found = [np.zeros((4, 0), np.int64)]
        for x, y in zip(cut, [*cut[1:], len(order)]):
            at = order[x:y]
            sets = [items[i] for i in at]
            if kind[at[0]] >= 0:
                size = np.array([len(i) for i in sets])
                where = tuple(int(c[at[0]]) for c in (component, kind, part))
                store.write(folder, _block(*where[:2]), where[2], dict(zip(BLOCKED, (keys[at], ids[at], copies[at], size, np.concatenate(sets)))))
                found.append(np.array([[*where, -1]]).T)
            elif len(at) > 1:
                found.append(_links(sets, keys[at], ids[at], copies[at], num, den))
        return pa.table(dict(zip("abcd", map(pa.array, np.concatenate(found, axis=1)))))

    links_of = "a long, b long, c long, d long"
    sets = docs.mapInArrow(needed, "place long, component long, kind long, part long, set_key long, id long, copies long, items binary")
    sets.groupBy("place").applyInArrow(judged, links_of).where("d <> 0").write.parquet(f"{folder}/links")
    found = spark.read.schema(links_of).parquet(f"{folder}/links")
    blocks, found = found.where("d < 0").select(F.col("a").alias("component"), F.col("b").alias("kind"), F.col("c").alias("part")), found.where("d > 0")
    if not blocks.isEmpty():  # a set of a block is in several jobs
        _compared(blocks, folder, num, den).where("d > 0").write.parquet(f"{folder}/block_links")
        large = spark.read.schema(links_of).parquet(f"{folder}/block_links")
        total = large.groupBy(F.col("a").alias("set_key")).agg(F.sum("d").alias("links"), F.min("c").alias("low"))
        total = total.join(components(large.where("a <> b").select("a", "b")).withColumnRenamed("id", "set_key"), "set_key")
        low = total.groupBy("component").agg(F.min("low").alias("low"))
        large = total.drop("low").join(low, "component").select("set_key", "low", "links")
    found = found.select(F.col("a").alias("set_key"), F.col("c").alias("low"), F.col("d").alias("links"))
    found = found if blocks.isEmpty() else found.unionByName(large)
    named = distinct.join(found, "set_key", "left").select("set_key", "n", F.coalesce("low", "id").alias("low"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    save(named.select("set_key", "low", "links"), "named", NAMED)

    def rows_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class and links of each row, looked up by its set: all copies of one text stay where they are."""
        for batch in batches:
            row = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            own = store.lookup(folder, "named", bits, mix(batch.column(2).to_numpy().view("u8")), NAMED, {"low": 0, "links": 0})
            some = own["found"] & (batch.column(1).to_numpy() > 0)
            low = np.where(some, own["low"], batch.column(0).fill_null(0).to_numpy())
            columns = [pa.array(low, pa.int64(), mask=~row), pa.array(np.where(some, own["links"], 0), pa.int64(), mask=~row)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "n", "low", "links"])

    out = digest.select("id", "n", "set_key").mapInArrow(rows_named, "id long, n long, low long, links long")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), F.col("links").alias("n_links"))


def _links(sets: list[np.ndarray], keys: np.ndarray, ids: np.ndarray, copies: np.ndarray, num: int, den: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set its key, the smallest key and id of its class, and its links."""
    of, count = counted(sets, copies, num, den, sides)
    return np.stack([keys, smallest(of, keys), smallest(of, ids), count])


def _block(component: int, kind: int) -> str:
    """The name of the files of a component's sets of one kind; a part has a file."""
    return f"block{component}_{kind}"


def _compared(blocks: DataFrame, folder: str, num: int, den: int) -> DataFrame:
    """What ``judged`` returns, of each block with itself and of each two blocks whose sets may be linked; no set is shuffled."""
    spark = blocks.sparkSession
    other = blocks.select("component", F.col("kind").alias("next"), F.col("part").alias("with"))
    pairs = blocks.join(other, "component").where("next = kind and `with` >= part or next = kind + 1")
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.schema(pairs.schema).parquet(f"{folder}/pairs")

    def jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for component, *at in zip(*(c.to_pylist() for c in batch.columns)):
                places = dict.fromkeys([tuple(at[:2]), tuple(at[2:])])
                held = [store.mapped(folder, _block(component, kind), part, BLOCKED) for kind, part in places]
                keys, ids, copies = (np.concatenate([x[c] for x in held]) for c in ("set_key", "id", "copies"))
                sides = np.repeat(np.arange(len(held)), [len(x["n"]) for x in held]) if len(held) > 1 else None
                sets = [own for x in held for own in np.split(x["items"], np.cumsum(x["n"])[:-1])]
                found = _links(sets, keys, ids, copies, num, den, sides)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], list("abcd"))

    tasks = max(1, min(pairs.count(), 1 << 14))
    return pairs.repartition(tasks).mapInArrow(jobs, "a long, b long, c long, d long")
