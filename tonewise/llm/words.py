"""Words and n-gram hashes of whole texts, computed with numpy over Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide: two given
strings collide with a chance of about 2**-56 at worst, and a billion distinct ones are expected to
hold fewer than one colliding pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def _steady_memory() -> None:
    """Work arrays go back to the system when they are freed.

    By default the C library raises its limits with the largest array it has freed, and a worker that
    Spark uses again keeps that much for good.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, 32 << 20)
        libc.mallopt(_M_TRIM_THRESHOLD, 64 << 20)
    except (OSError, AttributeError):  # another C library
        return
    pa.set_memory_pool(pa.system_memory_pool())


_steady_memory()


def release_memory() -> None:
    """Give what was freed back to the system, after work that will not come again."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


#: Bytes of text that are hashed at once; the work arrays take about 60 times as much.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * _U64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD1342543DE82EF95 | 1
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.ones(n, _U64), np.ones(n, _U64)
        inverse = pow(base, -1, 1 << 64)
        done = 1
        while done < n:
            step = min(done, n - done)
            up[done : done + step] = up[:step] * _U64(pow(base, done, 1 << 64))
            down[done : done + step] = down[:step] * _U64(pow(inverse, done, 1 << 64))
            done += step
        _powers[base] = have = (up, down)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The value that ``mix`` turned into this one."""
    x = x ^ (x >> _U64(31)) ^ (x >> _U64(62))
    x = x * _U64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> _U64(27)) ^ (x >> _U64(54))
    x = x * _U64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U64(30)) ^ (x >> _U64(60))


@dataclass
class Chunk:
    """Consecutive rows of a batch: their text bytes, and their words as byte ranges and hashes."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # words of row i: bounds[i] to bounds[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of every row, a few megabytes at a time; ``lower`` folds A-Z."""
    data, offsets = text_bytes(column)
    for first, last in split_rows(offsets, limit):
        part = data[offsets[first] : offsets[last]]
        if lower:
            part = _LOWER[part]
        yield words_of(part, offsets[first : last + 1] - offsets[first], first)


def words_of(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Chunk:
    n = len(data)
    word = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = False
        after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = powers(_BASE, n + 1)
    total = np.zeros(n + 1, _U64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))
    return Chunk(first, len(offsets) - 1, data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, by the position of the first; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, _U64)
    up, down = powers(_GRAM, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(hashes) - n + 1] + _U64(n))


def inside(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n consecutive words lie in one row."""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.ones(total - n + 1, bool)
    for back in range(1, n):
        at = bounds[1:-1] - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


def word_hash(word: bytes) -> np.uint64:
    """The hash that ``chunks`` gives this word."""
    data = np.frombuffer(word, np.uint8)
    up, _ = powers(_BASE, len(data) + 1)
    total = np.sum(_BYTE[data] * up[: len(data)], dtype=_U64)
    return mix(np.array([total + _U64(len(data))], _U64))[0]
