"""Emoji expressions built from an alias table.

The table is the standard set of emoji sequences, a few thousand entries fixed by the Unicode
standard; ``load_aliases`` refuses a table beyond that size, so holding it in the plan is safe.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ALIASES = 20_000
#: Noncharacters, which no text may hold, in place of an emoji.
MARK = "\ufffe\uffff\ufffe"
#: First code points that one look ahead covers.
BLOCK = 16


@dataclass(frozen=True)
class EmojiAliases:
    """emoji -> ":alias:" pairs."""

    names: dict[str, str]

    @property
    def pattern(self) -> str:
        """Longest sequence first, behind a cheap look at the next code point.

        Sequences are grouped by their first code point, and groups in blocks with a look at the
        block's code points, so a match tries a few dozen branches however many aliases there are. Most
        characters fail by the range of all first code points; where every sequence is one code point, no look is needed.
        """
        groups: dict[str, list[str]] = {}
        for name in self.names:
            groups.setdefault(name[0], []).append(name[1:])
        firsts = sorted(groups)
        single = [f for f in firsts if groups[f] == [""]]
        longer = [f for f in firsts if groups[f] != [""]]
        if firsts and not longer:
            return _start(firsts)
        blocks = [longer[i : i + BLOCK] for i in range(0, len(longer), BLOCK)]
        branches = [f"(?=[{_ranges(block)}])(?:{'|'.join(_branch(f, groups[f]) for f in block)})" for block in blocks]
        if single:
            branches.append(f"[{_ranges(single)}]")
        return f"(?={_start(firsts)})(?:{'|'.join(branches)})"

    def alias(self, emoji: Column) -> Column:
        """The alias of an emoji; the names lie in many small maps, found by a hash of the emoji."""
        size = max(1, len(self.names) // 8)
        buckets: list[dict[str, str]] = [{} for _ in range(size)]
        for name, alias in self.names.items():
            buckets[zlib.crc32(name.encode()) % size][name] = alias
        # One literal that is parsed while planning; thousands of literal columns take seconds to build.
        maps = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")
        return F.get(maps, (F.crc32(emoji.cast("binary")) % size).cast("int"))[emoji]


def _ranges(points: list[str]) -> str:
    """Code points in order as the inside of a character class."""
    spans: list[list[int]] = []
    for point in map(ord, points):
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in spans)


def _start(firsts: list[str]) -> str:
    """A class of the code points, in order, that tests their range first."""
    return f"[\\x{{{ord(firsts[0]):X}}}-\\x{{{ord(firsts[-1]):X}}}&&[{_ranges(firsts)}]]" if firsts else "[]"


def _branch(first: str, rests: list[str]) -> str:
    """A first code point and what may follow it, longest first."""
    followed = "|".join(re.escape(r) for r in sorted((r for r in rests if r), key=lambda r: (-len(r), r)))
    return re.escape(first) + (f"(?:{followed})" if "" not in rests else f"(?:{followed})?")


def load_aliases(table: DataFrame) -> EmojiAliases:
    """Read an (emoji, alias) table, refusing anything larger than an emoji set can be."""
    rows = table.select("emoji", "alias").where("emoji <> ''").limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"an emoji alias table has at most {MAX_ALIASES} rows")
    return EmojiAliases({row.emoji: row.alias for row in rows})


def has_emoji(text: Column, aliases: EmojiAliases) -> Column:
    return text.rlike(aliases.pattern)


def strip_emoji(text: Column, aliases: EmojiAliases) -> Column:
    return F.regexp_replace(text, aliases.pattern, "")


def extract_emoji(text: Column, aliases: EmojiAliases) -> Column:
    return F.regexp_extract_all(text, F.lit(aliases.pattern), 0)


def emoji_to_alias(text: Column, aliases: EmojiAliases) -> Column:
    """Replace every emoji by its alias.

    The text is cut at the emoji and put together again with the looked-up names in between; a
    text without emoji is returned untouched.
    """
    # ``split`` compiles its pattern for every row, so the long one only marks the places.
    between = F.split(F.regexp_replace(text, aliases.pattern, MARK), MARK, -1)
    found = F.transform(extract_emoji(text, aliases), aliases.alias)
    rebuilt = F.array_join(F.flatten(F.zip_with(between, found, lambda s, a: F.array(s, F.coalesce(a, F.lit(""))))), "")
    return F.when(has_emoji(text, aliases), rebuilt).otherwise(text)
