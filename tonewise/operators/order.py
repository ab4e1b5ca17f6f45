"""Order statistics without a global sort: deep pages and exact splits.

A page far down an order needs the rows around one rank only. Splitters from a small sample cut the order into
ranges, one pass counts the rows of each range, the prefix sum of these few counts says which ranges the page
touches, and only they are read again, with the range pushed down to the scan, until few enough rows are left to
sort. The sample decides how even the ranges are, never the result.

The k-th smallest hash is found digit by digit: a pass counts rows by the leading bits, and the next pass looks
into the one range that holds rank k. At most 4,096 counts return to the driver in a pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tonewise.operators.splits import Weights

Order = Sequence[tuple[str, bool]]

SPLITTERS = 63
#: Rows that are sorted at last, or a few pages if these are more.
SORTED_ROWS = 50_000
_SAMPLED = 40 * (SPLITTERS + 1)


def sort_columns(order: Order) -> list[Column]:
    return [F.asc(c) if ascending else F.desc(c) for c, ascending in order]


def before(order: Order, bound: Row) -> Column:
    """Whether a row stands before the bound; nulls come first ascending and last descending."""
    out = F.lit(False)
    for name, ascending in reversed(order):
        value, column = bound[name], F.col(name)
        if value is None:
            first = F.lit(False) if ascending else column.isNotNull()
        else:
            first = column.isNull() | (column < F.lit(value)) if ascending else column > F.lit(value)
        out = F.coalesce(first, F.lit(False)) | (column.eqNullSafe(F.lit(value)) & out)
    return out


def splitters(df: DataFrame, order: Order, rows: int) -> list[Row]:
    """At most SPLITTERS bounds of about equal ranges, from a few thousand sampled rows."""
    sample = df.select(*[c for c, _ in order])
    if rows > _SAMPLED:
        sample = sample.sample(_SAMPLED / rows, seed=7)
    sample = sample.orderBy(*sort_columns(order)).limit(4 * _SAMPLED).collect()
    step = max(1, len(sample) // (SPLITTERS + 1))
    return list(dict.fromkeys(sample[step::step]))[:SPLITTERS]


def range_of(order: Order, bounds: Sequence[Row]) -> Column:
    """Number of bounds a row does not stand before, by binary search."""

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(before(order, bounds[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return pick(0, len(bounds))


def _between(df: DataFrame, order: Order, low: Row | None, high: Row | None) -> DataFrame:
    """Rows from ``low`` on and before ``high``, with plain comparisons of the first column that a scan can use."""
    name, ascending = order[0]
    column = F.col(name)
    ends = [(low, column >= low[name] if ascending else column <= low[name])] if low is not None and low[name] is not None else []
    ends += [(high, column <= high[name] if ascending else column >= high[name])] if high is not None and high[name] is not None else []
    for end, test in ends:
        # Nulls stand before any value ascending and after it descending.
        open_to_nulls = (end is high) if ascending else (end is low)
        df = df.where(test | column.isNull() if open_to_nulls else test)
    if low is not None:
        df = df.where(~before(order, low))
    return df.where(before(order, high)) if high is not None else df


def narrowed(df: DataFrame, order: Order, offset: int, size: int) -> tuple[DataFrame, int]:
    """Few rows that hold ranks offset to offset + size, and the rank of the first one within them."""
    rows, most = df.count(), max(SORTED_ROWS, 4 * size)
    while rows > most:
        bounds = splitters(df, order, rows)
        counts = dict(df.groupBy(range_of(order, bounds).alias("range")).count().collect())
        ends = list(accumulate(counts.get(i, 0) for i in range(len(bounds) + 1)))
        first = next((i for i, end in enumerate(ends) if end > offset), len(bounds))
        last = next((i for i, end in enumerate(ends) if end >= offset + size), len(bounds))
        start = ends[first - 1] if first else 0
        kept = ends[last] - start
        if kept >= rows:  # rows that are equal in the whole order
            break
        df = _between(df, order, bounds[first - 1] if first else None, bounds[last] if last < len(bounds) else None)
        rows, offset = kept, offset - start
    return df, offset


def deep_page(df: DataFrame, page: int, page_size: int, order: Order) -> DataFrame:
    """One page (from 0); rows equal in the whole order have no fixed place, so it should end with a key."""
    few, offset = narrowed(df, order, page * page_size, page_size)
    return few.orderBy(*sort_columns(order)).offset(offset).limit(page_size)


#: Digits of a hash of 32 bits, from the left.
DIGITS = (12, 12, 8)


def hash_of(key: str, seed: int) -> Column:
    """A number below 2**32 that depends on the id and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")


def ranked_hashes(df: DataFrame, key: str, seed: int, ranks: Sequence[int]) -> list[tuple[int, object] | None]:
    """The (hash, key) of each rank (from 1) among all rows, ordered by hash and key; None for rank 0."""
    hashed = df.select(hash_of(key, seed).alias("h"), F.col(key).alias("k"))
    found: dict[int, tuple[int, int]] = {r: (0, r) for r in ranks if r > 0}  # rank -> (leading digits, rank among them)
    done = 0
    for digits in DIGITS:
        prefixes = sorted({p for p, _ in found.values()})
        left = 32 - done
        inside = hashed.where(F.shiftright("h", left).isin(prefixes)) if done else hashed
        done += digits
        counts = sorted(map(tuple, inside.groupBy(F.shiftright("h", 32 - done).alias("d")).count().collect()))
        for rank, (prefix, place) in found.items():
            for d, n in counts:
                if d >> digits == prefix:
                    if place <= n:
                        found[rank] = d, place
                        break
                    place -= n
    out: list[tuple[int, object] | None] = []
    ties = hashed.where(F.col("h").isin([h for h, _ in found.values()])).groupBy("h", "k").count().orderBy("h", "k").collect() if found else []
    for rank in ranks:
        if rank <= 0:
            out.append(None)
            continue
        h, place = found[rank]
        for tie in ties:
            if tie["h"] == h:
                place -= tie["count"]
                if place <= 0:
                    out.append((h, tie["k"]))
                    break
    return out


def split_exact(df: DataFrame, weights: Weights, key: str = "tweet_id", seed: int = 42) -> DataFrame:
    """Parts of exactly the sizes of ``split_sizes``, whatever the partitioning; the rows left over have a null split.

    Rows stand in the order of their hash, and of their key where hashes are equal. Rows that share a key go
    to the same part, so sizes are exact where keys are unique.
    """
    n = df.count()
    sizes = [int(n * w) for w in (weights.train, weights.validation, weights.classification)]
    ends = [min(n, e) for e in accumulate(sizes)]
    bounds = ranked_hashes(df, key, seed, ends)
    number, split = hash_of(key, seed), F.lit(None).cast("string")
    for name, bound in reversed(list(zip(("train", "validation", "classify"), bounds))):
        if bound is not None:
            h, k = bound
            split = F.when((number < h) | ((number == h) & (F.col(key) <= F.lit(k))), name).otherwise(split)
    return df.withColumn("split", split)
