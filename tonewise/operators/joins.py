"""Lookups against a side table: broadcast when it is proven small, salted shuffle join beyond."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 128 * 1024 * 1024
SALTS = 16


@dataclass(frozen=True)
class Lookup:
    """A side table, its join key, and whether it was measured to fit a broadcast."""

    table: DataFrame
    key: str
    small: bool


def measure(table: DataFrame, key: str, limit: int | None = None) -> Lookup:
    """Count rows and bytes of the side table, but never read further than the row limit."""
    limit = BROADCAST_ROWS if limit is None else limit
    text = F.to_json(F.struct(*table.columns))
    size = table.select(F.octet_length(text).alias("bytes")).limit(limit + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    ).first()
    return Lookup(table, key, size["rows"] <= limit and size["bytes"] <= BROADCAST_BYTES)


def lookup(df: DataFrame, on: str, side: Lookup, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``df.on`` with the side's key; the side's key column is dropped.

    A large side goes through a shuffle. Text follows a power law, so one key may hold a third of
    all rows: rows of ``df`` are dealt over ``salts`` copies of each side row.
    """
    if side.small:
        joined = df.join(F.broadcast(side.table), df[on] == side.table[side.key], how)
        return joined if how in ("leftsemi", "left_semi", "left_anti") else joined.drop(side.table[side.key])
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)).cast("int"))
    copies = side.table.withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    condition = (dealt[on] == copies[side.key]) & (dealt["_salt"] == copies["_copy"])
    joined = dealt.join(copies, condition, how)
    if how in ("leftsemi", "left_semi", "left_anti"):
        return joined.drop("_salt")
    return joined.drop(copies[side.key]).drop("_salt", "_copy")


def _hashable(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if not kind.startswith(("map", "variant"))]
