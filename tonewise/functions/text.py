"""Text and token expressions. All are row-local, so none of them needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewise.functions import fixed_values as fixed
from tonewise.functions.valence import stops
from tonewise.functions.valence import words as literals

SINGLE_MARKS = "".join(run for run in fixed.PUNCTUATION_RUNS if len(run) == 1)
# The same marks as a pattern: a find over a text costs a fraction of what ``translate`` does.
MARKS = "[" + "".join(f"\\x{{{ord(mark):X}}}" for mark in SINGLE_MARKS) + "]+"
# Upper-case letters of the basic plane: a surrogate pair never counts as upper case.
UPPER_ONLY = r"^[\p{javaUpperCase}&&[\x{0}-\x{FFFF}]]*\z"
UPPER_PAIR = r"[\p{javaUpperCase}&&[\x{0}-\x{FFFF}]]{2}"
# Leading words among which the first repeat is looked for before the whole text is taken.
HEADS = (64, 512)
SENTENCE_END = r"([.!?])[ \t\n\r\f]+"
SENTENCE_MARK = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computed once.

    A column expression used inside a lambda is evaluated again for every element, and Catalyst may
    inline a column that was selected before; a lambda variable is neither.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def two_units(token: Column) -> Column:
    """UTF-16 length above one: two characters, or one character outside the basic plane."""
    return (F.octet_length(token) > 3) | (F.length(token) > 1)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def round_half_up(value: Column, places: int) -> Column:
    """floor(x + 0.5) at ``places`` decimals; F.round differs on negative ties."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5).cast("double") / scale


def space_tokens(text: Column) -> Column:
    """Split on single spaces: trailing empty tokens go, inner ones stay."""
    trimmed = F.rtrim(text)
    return F.when((trimmed == "") & (text != ""), F.array().cast("array<string>")).otherwise(
        F.split(trimmed, " ")
    )


def join_tokens(tokens: Column) -> Column:
    """Every token behind one space; no tokens give the empty string."""
    return F.when(F.size(tokens) == 0, "").otherwise(F.concat(F.lit(" "), F.array_join(tokens, " ")))


def drop_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    """Remove stop words in any case, keeping the order and repeats of the rest."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stop_words))


def hashtags(body: Column) -> Column:
    return F.array_distinct(F.filter(F.split(body, " "), lambda t: t.startswith("#")))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def bare_words(text: Column) -> Column:
    """Words of the text once the single punctuation marks are gone, two units or longer."""
    return F.filter(F.split(without_marks(text), " "), two_units)


def raw_tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), two_units)


def words_before_repeat(words: Column) -> Column:
    """The leading words up to, not including, the first one seen before.

    array_distinct keeps first occurrences in order, so both arrays agree exactly until the first
    repeat; this is linear in the number of words.
    """

    def cut(all_words: Column) -> Column:
        agrees = F.zip_with(all_words, F.array_distinct(all_words), lambda a, b: a.eqNullSafe(b))
        first_repeat = F.array_position(agrees, False).cast("int")
        return F.when(first_repeat > 0, F.slice(all_words, 1, first_repeat - 1)).otherwise(all_words)

    return let(words, cut)


def _known_words(bare: Column) -> Column:
    """``words_before_repeat`` of the words of two units; most texts repeat a word early, so a few leading ones do."""

    def within(heads: tuple[int, ...]) -> Column:
        if not heads:
            return words_before_repeat(F.filter(bare, two_units))
        repeats = lambda words: F.size(F.array_distinct(words)) < F.size(words)
        head = F.filter(F.slice(bare, 1, heads[0]), two_units)
        return let(head, lambda words: F.when(repeats(words), words_before_repeat(words)).otherwise(within(heads[1:])))

    return within(HEADS)


def _edge_run(token: Column, word: Column) -> Column:
    """Whether ``token`` is ``word`` with one known punctuation run in front or behind."""
    behind = token.startswith(word) & F.substr(token, F.length(word) + 1).isin(fixed.PUNCTUATION_RUNS)
    before = token.endswith(word) & F.substr(
        token, F.lit(1), F.length(token) - F.length(word)
    ).isin(fixed.PUNCTUATION_RUNS)
    return behind | before


def strip_runs(text: Column, full_map: bool = False) -> Column:
    """Tokens with one punctuation run stripped where the bare word is a mapped one.

    Mapped are the words before the first repeated word, or all words with ``full_map``. Removing
    punctuation never moves a space, so pieces and bare words line up by position.
    """
    pieces = F.split(text, " ")

    def settle(known: Column | None) -> Callable[[Column, Column], Column]:
        def one(token: Column, word: Column) -> Column:
            stripped = (token != word) & two_units(word) & _edge_run(token, word)
            if known is not None:
                stripped = stripped & F.array_contains(known, word)
            return F.when(stripped, word).when(two_units(token), token).otherwise("")

        return one

    def settled(bare: Column) -> Column:
        if full_map:
            return F.zip_with(pieces, bare, settle(None))
        return let(_known_words(bare), lambda known: F.zip_with(pieces, bare, settle(known)))

    # No settled token is empty, and array_remove needs no call per token.
    return F.array_remove(let(F.split(without_marks(text), " "), settled), "")


def is_upper(token: Column) -> Column:
    return token.rlike(UPPER_ONLY)


def caps_differential(text: Column, tokens: Column) -> Column:
    """Some, but not all, tokens of the text are upper case.

    A token has two units and stands unbroken in the text, so without two neighbouring upper-case letters none is.
    """
    mixed = F.exists(tokens, is_upper) & F.exists(tokens, lambda t: ~is_upper(t))
    return F.when(text.rlike(UPPER_PAIR), mixed).otherwise(F.lit(False))


def lower_tokens(tokens: Column) -> Column:
    """The tokens in lower case, by one call for all of them; an empty list gives one empty token."""
    return F.split(F.lower(F.array_join(tokens, " ")), " ")


def first_stop(tokens: str, lowered: str) -> Column:
    """1-based position of the first stop token in the named column, 0 when there is none.

    ``lowered`` names the column of ``lower_tokens``. array_intersect keeps the order of its first array, so its
    first word is the first degree word; only a text with a "kind" is walked token by token.
    """
    flags = f"zip_with({tokens}, slice({tokens}, 2, size({tokens})), (t, f) -> {stops('t', 'f')})"
    degrees = f"array({literals(fixed.RAISING + fixed.LOWERING)})"
    plain = f"coalesce(array_position({lowered}, get(array_intersect({lowered}, {degrees}), 0)), 0L)"
    walked = f"array_position({flags}, true)"
    return F.expr(f"CAST(CASE WHEN array_contains({lowered}, 'kind') THEN {walked} ELSE {plain} END AS INT)")


def first_but(tokens: Column) -> Column:
    """0-based position of the first BUT, else of the first but, else -1."""
    shouted = F.array_position(tokens, "BUT")
    return (F.when(shouted > 0, shouted).otherwise(F.array_position(tokens, "but")) - 1).cast("int")


def _marks(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def punctuation_emphasis(text: Column) -> Column:
    def weigh(marks: Column) -> Column:
        questions = _marks(marks, "?")
        return F.least(_marks(marks, "!"), F.lit(4)) * F.lit(fixed.EXCLAMATION_STEP) + F.when(
            questions > 3, F.lit(fixed.QUESTION_MAX)
        ).otherwise(questions * F.lit(fixed.QUESTION_STEP))

    # One pass leaves the few marks to count.
    return let(F.regexp_replace(text, "[^!?]+", ""), weigh)


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? followed by white space."""
    marked = F.regexp_replace(text, SENTENCE_END, "$1" + SENTENCE_MARK)
    return F.filter(
        F.transform(F.split(marked, SENTENCE_MARK), lambda s: F.trim(s)), lambda s: s != ""
    )


def longest_sentence(text: Column) -> Column:
    """The longest sentence in UTF-16 units; the first one wins a tie."""
    ranked = F.transform(
        sentences(text),
        lambda s, i: F.struct(utf16_length(s).alias("n"), (-i).alias("first"), s.alias("s")),
    )
    return F.coalesce(F.array_max(ranked)["s"], F.lit(""))
