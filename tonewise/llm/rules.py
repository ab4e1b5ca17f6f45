"""Quality rules from repetition: characters inside duplicated word n-grams and lines.

Every text is hashed once; the hashes of n consecutive words come from differences of running sums.
Within a text, an n-gram or a line that equals an earlier one is a repetition, and the characters of
all repeated n-grams of one length are measured against the characters of all words. A text stays
if neither any length nor the lines exceed their share and it has at most one symbol in ten words.
All work is local to a row.

Null and empty texts have no words and fail. Rows that share an id are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewise.llm.words import _BASE, _BYTE, Chunk, chunks, grams, inside, mix, powers

#: Largest share of characters in repeated n-grams, by n.
SHARES = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
LINE_SHARE = 0.30
#: Most symbols for each ten words.
SYMBOLS = 1
LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50

_U64 = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which occur more than once."""
    later, several = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        several[order[1:][same]] = True
        several[order[:-1][same]] = True
    return later, several


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of the lines that have a word."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.concatenate([chunk.offsets[:-1], breaks + 1])
    rows = np.concatenate([np.arange(chunk.rows), np.searchsorted(chunk.offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.concatenate([starts[1:] - 1, [0]]) if len(starts) else starts
    last = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(rows) else np.zeros(0, bool)
    ends[last] = chunk.offsets[rows[last] + 1]
    some = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    starts, ends, rows = starts[some], ends[some], rows[some]
    up, down = powers(_BASE, len(chunk.data) + 1)
    total = np.zeros(len(chunk.data) + 1, _U64)
    np.cumsum(_BYTE[chunk.data] * up[: len(chunk.data)], out=total[1:])
    return starts, ends, rows, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))


def measures(chunk: Chunk) -> dict[str, np.ndarray]:
    """All columns of the chunk's rows."""
    n_words = chunk.counts
    lead = np.concatenate([[0], np.cumsum(_LEAD[chunk.data])])
    chars = lead[chunk.ends] - lead[chunk.starts]
    word_chars = _sums(chars, chunk.bounds)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _sums(_SYMBOL[chunk.data], chunk.offsets)}
    starts, ends, rows, key = lines(chunk)
    later, _ = _repeats(mix(key ^ mix(rows.astype(_U64) + _U64(1))))
    out["n_dup_lines"] = np.bincount(rows[later], minlength=chunk.rows)
    held = np.searchsorted(chunk.starts, starts), np.searchsorted(chunk.starts, ends)
    by_word = np.concatenate([[0], np.cumsum(chars)])
    line_chars = np.bincount(rows[later], (by_word[held[1]] - by_word[held[0]])[later], chunk.rows)

    salt = mix(chunk.row_of.astype(_U64) + _U64(1))
    at = inside(chunk.bounds, 3)
    _, several = _repeats(mix(grams(chunk.hashes, 3)[at] ^ salt[at])) if len(at) else (at, np.zeros(0, bool))
    out["n_repeat_words"] = _sums(_covered(at[several], 3, len(chunk.hashes)), chunk.bounds)
    failed = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * n_words)
    of = np.maximum(word_chars, 1)
    kept = ~failed & (line_chars <= LINE_SHARE * of) & (10 * out["n_symbols"] <= SYMBOLS * n_words)
    out["dup_line_share"] = line_chars / of
    for n, most in SHARES.items():
        at = inside(chunk.bounds, n)
        later, _ = _repeats(mix(grams(chunk.hashes, n)[at] ^ salt[at])) if len(at) else (np.zeros(0, bool), at)
        share = _sums(_covered(at[later], n, len(chunk.hashes)) * chars, chunk.bounds) / of
        out[f"dup_{n}gram_share"] = share
        kept &= share <= most
    return out | {"base_failed": failed, "kept": kept}


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with the counts, the repeated shares, ``base_failed`` and ``kept``, which replace columns of these names."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_share", "base_failed", "kept", *(f"dup_{n}gram_share" for n in SHARES)}
    keep = tuple(k for k in keep if k not in made)
    rows = docs.select(*keep, F.col(text).alias("_judged_text"))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(width)):
                part = batch.slice(chunk.first, chunk.rows)
                got = measures(chunk)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *map(pa.array, got.values())], [*keep, *got])

    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    shares = ", ".join(f"{c} double" for c in ("dup_line_share", *(f"dup_{n}gram_share" for n in SHARES)))
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keep)
    return rows.mapInArrow(run, f"{kinds}{counts}, {shares}, base_failed boolean, kept boolean")
