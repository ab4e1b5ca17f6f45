"""Spelling variants: words at one inserted, deleted or replaced letter, found over bit-sliced position indexes.

1. Words are counted with numpy and Arrow in map tasks, then summed. The contract's damage (one letter of
   a run whose checksum is a multiple of 199 goes) is applied on the way.
2. Two words at one edit, the shorter of length a, share either the first a // 2 letters or the last
   a - a // 2. So each word stands in up to four groups: (a, side, those letters) for a its own length
   and one less. Pairs of two words of length a + 1 belong to the groups of a + 1, and a pair that shares
   both sides counts in the group of the first letters only, so every pair is met in exactly one group.
3. A group's words, most frequent first, are the bits of 64-bit lanes, and for each (position, letter)
   the index holds one word of bits a lane. A query letter moves three sets at once through all words of
   a lane: those without an error so far, and those with one, in which the positions are shifted by one
   for a missing or an extra letter. Queries and lanes are one array, so numpy runs each step over many.
4. Only the number of near words and the first bit, which is the most frequent, leave the group. Forms are
   followed to their roots by doubling; a form is at least five times as frequent as its word, so a chain
   has at most log5 of the largest count links.

A group of over ``BLOCK`` words is dealt into blocks, and each pair of blocks is one piece of work, so no task
holds a whole hot group; counts and best words of the pieces are added up. Groups are dealt to tasks by
shards, whose number follows the vocabulary. Only distinct words are shuffled.

Null texts have no words. A null id counts as an empty one in the checksum; rows that share an id or a
text count each for itself. Other columns are ignored. Words of any length take part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm import store
from tonewise.llm.words import CHUNK_BYTES, split_rows, text_bytes

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent.
TIMES = 5
#: One run in so many loses a letter.
DAMAGE = 199
#: Words of one block of a group; a piece of work holds two blocks at most.
BLOCK = 1 << 15
#: Rows of a shard, not counting hot groups.
SHARD_ROWS = 40_000
#: Query and lane pairs that are worked on at once.
PAIRS = 1 << 17

_U64 = np.uint64
_ALL = _U64(0xFFFFFFFFFFFFFFFF)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges and rows of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (0xC3 and one more byte)."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = after[inner - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each range, begun with the checksum of what stands before it."""
    state, size = ~begun, ends - starts
    order = np.argsort(-size, kind="stable")
    state, at, left = state[order], starts[order], -size[order]
    for step in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -step, side="left"))
        some = state[:n]
        state[:n] = _CRC[(some ^ data[at[:n] + step]) & np.uint32(0xFF)] ^ (some >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _counted(data: np.ndarray, offsets: np.ndarray, ids: list[str], least: int) -> pa.Table:
    """Distinct words of at least ``least`` letters and their counts, after the damage."""
    starts, ends, rows = runs_of(data, offsets)
    leads = np.concatenate([[0], np.cumsum(data == 0xC3)])
    size = ends - starts - (leads[ends] - leads[starts])
    some = size >= least
    starts, ends, rows, size = starts[some], ends[some], rows[some], size[some]
    folded = _LOWER[data]
    begun = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = checksums(folded, starts, ends, begun[rows])
    hit = crc % np.uint32(DAMAGE) == 0
    shorter = []
    for a, b, h in zip(starts[hit], ends[hit], crc[hit]):
        word = folded[a:b].tobytes().decode()
        at = int(h) % len(word)
        if len(word) > least:
            shorter.append(word[:at] + word[at + 1 :])
    starts, ends = starts[~hit], ends[~hit]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    held = np.cumsum(edge[:-1], dtype=np.int8) > 0
    places = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places.astype("<i8").tobytes()), pa.py_buffer(folded[held].tobytes())])
    found = pc.value_counts(pa.chunked_array([words, pa.array(shorter, pa.large_string())]).combine_chunks())
    return pa.table({"word": found.field("values"), "n": found.field("counts")})


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = text_bytes(batch.column(1))
            for first, last in split_rows(offsets, CHUNK_BYTES):
                held.append(_counted(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], ids[first:last], least_letters))
                if sum(len(t) for t in held) > 600_000:
                    held[:] = [merged()]
                    if len(held[0]) > 300_000:
                        yield from _batches(held.pop())
        if held:
            yield from _batches(merged())

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    table = table.set_column(0, "word", table.column("word").cast(pa.string()))
    yield from table.to_batches(max_chunksize=50_000)


def _symbols(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One small number for each letter, and the offsets of the words."""
    data, offsets = text_bytes(words)
    lead = data == 0xC3
    values = np.where(data < 0x80, data - 0x61, data - 0x80 + 26).astype(np.uint8)
    leads = np.concatenate([[0], np.cumsum(lead)])
    return values[~lead], offsets - leads[offsets]


class Slices:
    """For each (position, letter): which words of which lane have this letter there.

    Words have ``width - 1`` or ``width`` letters, given as small numbers below ``kinds``.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, lane: np.ndarray, bit: np.ndarray, lanes: int, kinds: int):
        self.width = codes.shape[1]
        self.bits = np.zeros((self.width + 1, kinds, lanes), _U64)  # at the last position stands no word
        one = _U64(1) << bit.astype(_U64)
        flat = self.bits.reshape(-1)
        for at in range(self.width):
            has = sizes > at
            np.add.at(flat, (at * kinds + codes[has, at]) * lanes + lane[has], one[has])
        self.short, self.long = np.zeros(lanes, _U64), np.zeros(lanes, _U64)
        np.add.at(self.short, lane[sizes < self.width], one[sizes < self.width])
        np.add.at(self.long, lane[sizes == self.width], one[sizes == self.width])

    def near(self, codes: np.ndarray, lane: np.ndarray, size: int, second: np.ndarray, half: int) -> np.ndarray:
        """The words at one edit from each query of ``size`` letters, in the lane that goes with it.

        A query of ``width - 1`` letters meets the words of both lengths, a longer one the shorter words.
        Words that share the first ``half`` letters are left out where ``second`` is set.
        """
        none = np.zeros(len(lane), _U64)
        exact = extra = np.full(len(lane), _ALL)
        replaced = missing = shared = none
        longer = size == self.width
        for at in range(size):
            code = codes[:, at]
            here = self.bits[at, code, lane]
            if longer:  # one letter of the query is missing in the word
                missing = (missing & self.bits[at - 1, code, lane] | exact) if at else exact
            else:
                replaced = (replaced & here) | (exact & ~here)
            exact = exact & here
            if not longer:  # the word has one letter more
                extra = (extra & self.bits[at + 1, code, lane]) | exact
            if at == half - 1:
                shared = exact
        found = missing & self.short[lane] if longer else (replaced & self.short[lane]) | (extra & self.long[lane])
        return found & ~np.where(second, shared, none)


ASKS, ANSWERS = 1, 2


def _compared(size: int, words: pa.Table, symbols: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking rows, numbers of near words, rows of the first of these) for whole pieces whose shorter words have ``size`` letters."""
    piece, role, second = (words.column(c).to_numpy() for c in ("piece", "role", "second"))
    width, n = size + 1, len(words)
    sizes = np.diff(offsets)
    codes = np.zeros((n, width), np.uint8)
    for at in range(width):
        has = sizes > at
        codes[has, at] = symbols[offsets[:-1][has] + at]
    used, codes = np.unique(codes, return_inverse=True)
    codes = codes.reshape(n, width)
    group = np.cumsum(np.concatenate([[0], piece[1:] != piece[:-1]]))

    answers = np.flatnonzero(role & ANSWERS)
    if not len(answers):
        return
    of = group[answers]
    at = np.arange(len(answers))
    within = at - np.maximum.accumulate(np.where(np.concatenate([[True], of[1:] != of[:-1]]), at, 0))
    opens = np.flatnonzero(within % 64 == 0)
    lane = np.cumsum(within % 64 == 0) - 1
    index = Slices(codes[answers], sizes[answers], lane, within % 64, len(opens), len(used))
    lanes = np.searchsorted(of[opens], np.arange(group[-1] + 2))  # of group g: lanes[g] to lanes[g + 1]
    for length in (size, width):
        asks = np.flatnonzero((role & ASKS > 0) & (sizes == length))
        many = np.diff(lanes)[group[asks]]
        ends, a = np.concatenate([[0], np.cumsum(many)]), 0
        while a < len(asks):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + PAIRS, side="right")) - 1)
            some, count = asks[a:b], many[a:b]
            query = np.repeat(np.arange(len(some)), count)
            met = np.arange(len(query)) - (ends[a:b] - ends[a])[query] + lanes[group[some]][query]
            found = index.near(codes[some][query], met, length, second[some][query], size // 2)
            total = np.bincount(query, np.bitwise_count(found), len(some)).astype(np.int64)
            hit = np.flatnonzero(found)
            asked, first = np.unique(query[hit], return_index=True)
            best = found[hit[first]]
            low = np.bitwise_count((best & (~best + _U64(1))) - _U64(1))
            yield some[asked], total[asked], answers[opens[met[hit[first]]] + low]
            a = b


def _neighbours(table: pa.Table) -> pa.Table:
    """word, n_near and the most frequent near word, for the words of a shard's pieces that have any."""
    table = table.combine_chunks().sort_by([("a", "ascending"), ("piece", "ascending"), ("n", "descending"), ("word", "ascending")])
    a, piece = table.column("a").to_numpy(), table.column("piece").to_numpy()
    symbols, offsets = _symbols(table.column("word"))
    words, n = table.column("word"), table.column("n").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (a[1:] != a[:-1])]))
    ends = np.append(starts[1:], len(a))
    asking, totals, best = [], [], []
    i = 0
    while i < len(starts):
        size, begin = int(a[starts[i]]), int(starts[i])
        # An index takes 8 bytes a lane for each position and letter; long words get few lanes at a time.
        room = max(64, (48 << 20) // ((size + 2) * 91 * 8))
        last = i + 1
        while last < len(starts) and a[starts[last]] == size and ends[last] - begin <= room:
            last += 1
        end, i = int(ends[last - 1]), last
        part = offsets[begin : end + 1]
        for ask, total, near in _compared(size, table.slice(begin, end - begin), symbols[part[0] : part[-1]], part - part[0]):
            asking.append(ask + begin)
            totals.append(total)
            best.append(near + begin)
    empty = np.zeros(0, np.int64)
    ask, near = (np.concatenate(x) if x else empty for x in (asking, best))
    return pa.table(
        {
            "word": words.take(pa.array(ask)),
            "n_near": pa.array(np.concatenate(totals) if totals else empty, pa.int64()),
            "near": words.take(pa.array(near)),
            "near_n": pa.array(n[near], pa.int64()),
        }
    )


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, form (the most frequent near word, least in code-point order) and form_n, of the words with any near word."""
    spark, block = words.sparkSession, BLOCK
    size = F.char_length("word").cast("int")
    keyed = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("a")).where(f"a >= {LEAST_LETTERS} or a = size")
    half = F.floor(F.col("a") / 2).cast("int")
    sides = F.array(F.struct(F.lit(False).alias("second"), F.left("word", half).alias("part")), F.struct(F.lit(True).alias("second"), F.right("word", F.col("a") - half).alias("part")))
    keyed = keyed.withColumn("side", F.explode(sides)).select("word", "n", "a", "side.second", F.xxhash64("a", "side.second", "side.part").alias("group"))
    # Groups of one word have no pair; of the others, those over the block size are dealt into blocks.
    sizes = keyed.groupBy("group").agg(F.count("*").alias("rows")).where("rows > 1")
    folder = store.new_folder(spark, "spelling")
    sizes.write.parquet(f"{folder}/sizes")
    sizes = spark.read.schema(sizes.schema).parquet(f"{folder}/sizes")
    rows, hot = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    keyed = keyed.join(sizes, "group")
    if hot > block:
        blocks = F.ceil(F.col("rows") / block).cast("int")
        keyed = keyed.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("word", F.lit("block")), "blocks").cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        both = F.when(F.col("mine") == F.col("other"), F.array(F.struct(F.lit(ASKS | ANSWERS).alias("role"), F.xxhash64("group", "mine", "mine").alias("piece"))))
        each = F.array(
            F.struct(F.lit(ASKS).alias("role"), F.xxhash64("group", "mine", "other").alias("piece")),
            F.struct(F.lit(ANSWERS).alias("role"), F.xxhash64("group", "other", "mine").alias("piece")),
        )
        keyed = keyed.withColumn("other", other).withColumn("deal", F.explode(F.coalesce(both, each))).select("word", "n", "a", "second", "deal.role", "deal.piece")
    else:
        keyed = keyed.select("word", "n", "a", "second", F.lit(ASKS | ANSWERS).alias("role"), F.col("group").alias("piece"))
    shards = max(64, rows // SHARD_ROWS)
    dealt = keyed.withColumn("shard", F.pmod("piece", F.lit(shards)).cast("int")).groupBy("shard")
    found = dealt.applyInArrow(_neighbours, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of a vocabulary (word, n)."""
    spark, folder = words.sparkSession, store.new_folder(words.sparkSession, "forms")
    words.write.parquet(f"{folder}/words")
    words = spark.read.schema(words.schema).parquet(f"{folder}/words")
    near = neighbours(words)
    clear = F.col("near_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("near")).alias("form"), F.when(clear, F.col("near_n")).alias("form_n")
    )
    found.write.parquet(f"{folder}/found")
    found = spark.read.schema(found.schema).parquet(f"{folder}/found")
    # up: word -> where it has got to; doubled until nothing moves
    up, step = found.where("form is not null").select("word", F.col("form").alias("up")), 0
    while True:
        on = up.select(F.col("word").alias("up"), F.col("up").alias("further"))
        up = up.join(on, "up", "left").select("word", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        up.write.parquet(f"{folder}/up-{step}")
        up = spark.read.schema(up.schema).parquet(f"{folder}/up-{step}")
        if up.where("moved").isEmpty():
            break
        up, step = up.drop("moved"), step + 1
    return found.join(up.select("word", "up"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("up", "word").alias("root"))
