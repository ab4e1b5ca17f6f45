"""Repair of the turn structure of conversations at the least cost, by an auction over a lattice.

A repaired conversation is empty, or an optional system turn and then one or more pairs of a user and
an assistant turn. A row is kept (K, 0), gets another role (R, 2) or goes (D, 3); an empty user or
assistant turn may be inserted anywhere (I, 2). Blank and repeated rows must go; a truncated row that
stays costs 1 more. Node (i, q) of a conversation's lattice stands before row i in state q: nothing
yet, after the system turn, after a user turn, after an assistant turn.

The auction for shortest paths keeps a price for each node, no higher than the cost of any arc from
it and the price at the arc's end. A path grows from an origin: where the price of its last node is
below the least offer of the arcs, the price rises to it and the path is taken back by one node; else
the path goes on along the best arc, until it meets a node whose price has converged. Origins are
taken from the last row to the first, so a layer is four small auctions against the converged prices
of the next. They depend only on the row's kind and on the differences of the next prices, of which
there are few, so each case is solved once per task. All arcs that are tight under converged prices
lie on cheapest paths; following the least letter among them gives the least cheapest audit.

Rows of one conversation meet in one task as a sorted stream, once as short rows (role, kind and a
128-bit digest of role and text, about 30 bytes held for each row of the open conversation) and once
with their texts, which are never held: the audit stands before them in the stream. One conversation
is not split, because its digest is a sequential hash and its audit is one string.

Nulls: a null role or text is one space; null turns stand first and take no part in gaps; rows with a
null conversation id are one conversation. Rows of one turn stand by role and then by the digest of
role and text, so any order of the input gives the same result; equal rows are repetitions. Gaps
beyond a long are null. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Letter and state that a user or assistant turn leads to.
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
FINE, CUT, GONE = range(3)
_SPACES = " \t\n\x0b\x0c\r"
_ENDS = (START, ASSISTANT)
_LEGAL = {"su", "ua", "au"}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _arcs(state: int, initial: str, kind: int) -> list[tuple[str, bool, int, int]]:
    """(letter, goes to the next row, state, cost) of the arcs at a row."""
    wanted, after = _NEXT[state]
    out = [("D", True, state, DELETE), ("I", False, after, INSERT)]
    if kind != GONE:
        more = TRUNCATED if kind == CUT else 0
        if initial == wanted[0]:
            out.append(("K", True, after, KEEP + more))
        elif initial == "s" and state == START:
            out.append(("K", True, SYSTEM, KEEP + more))
        out.append(("R", True, after, REROLE + more))
    return out


def auction(arcs: dict[int, list[tuple[str, bool, int, int]]], beyond: tuple[int, ...]) -> list[int]:
    """Converged prices of a layer's four states, given those of the next layer, the least of which is 0."""
    price, converged = [0, 0, 0, 0], [False] * 4
    for origin in range(4):
        path = [origin]
        while not converged[path[-1]]:
            last = path[-1]
            offers = [(cost + (beyond[q] if on else price[q]), on, q) for _, on, q, cost in arcs[last]]
            least = min(o[0] for o in offers)
            if price[last] < least:
                price[last] = least
                if len(path) > 1:
                    path.pop()
                continue
            _, on, q = next(o for o in offers if o[0] == least)
            if on:
                break
            path.append(q)
        for q in path:
            converged[q] = True
    return price


@lru_cache(maxsize=1 << 14)
def layer(initial: str, kind: int, beyond: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Shift and differences of a row's prices; for each state the least tight letters up to the next row, and its state there."""
    arcs = {q: _arcs(q, initial, kind) for q in range(4)}
    price = auction(arcs, beyond)
    moves = []
    for origin in range(4):
        q, letters, on = origin, "", False
        while not on:
            letter, on, after, _ = min(a for a in arcs[q] if price[q] == a[3] + (beyond[a[2]] if a[1] else price[a[2]]))
            letters, q = letters + letter, after
        moves.append((letters, q))
    shift = min(price)
    return shift, tuple(p - shift for p in price), tuple(moves)


#: Prices and letters after the last row: inserted turns until the conversation may end.
_LAST = (0, 2 * INSERT, INSERT, 0)
_LAST_MOVES = ("", "II", "I", "")


def audit(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Least cost and least cheapest letters of a conversation's (initial, kind) rows."""
    total, prices, moves = 0, _LAST, []
    for initial, kind in reversed(rows):
        shift, prices, move = layer(initial if initial in ("s", "u", "a") else "", kind, prices)
        total += shift
        moves.append(move)
    state, out = START, []
    for move in reversed(moves):
        letters, after = move[state]
        out.append(letters)
        state = after
    out.append(_LAST_MOVES[state])
    return total + prices[START], "".join(out)


class _Open:
    """What is known of the conversation whose rows are being read."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int]] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: tuple[int, int, int] | None = None  # least, last and number of distinct turns
        self.initial: str | None = None

    def add(self, turn: int | None, initial: str, kind: str, digest: bytes) -> None:
        if turn is not None:
            least, last, n = self.turns or (turn, turn, 1)
            self.turns = (least, turn, n + (turn != last))
        fault = FINE
        if kind == "b":
            self.blank += 1
            fault = GONE
        elif digest in self.seen:
            self.duplicate += 1
            fault = GONE
        elif kind == "t":
            self.truncated += 1
            fault = CUT
        self.seen.add(digest)
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        self.rows.append((initial, fault))

    def result(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        cost, letters = audit(self.rows)
        return gaps if gaps < 1 << 63 else None, self.blank, self.duplicate, self.truncated, self.illegal, cost, letters


def prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None = None) -> DataFrame:
    """conv, turn, role, text, digest, kind (b blank, t truncated, f fine, x not there but its conversation is)."""
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        gone.alias("gone"),
    )
    ended = F.rtrim(F.col("text"), F.lit(_SPACES))
    kind = F.when(F.col("gone"), "x").when(ended == "", "b").when(F.right(ended, F.lit(1)).isin(".", "!", "?"), "f").otherwise("t")
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16)
    return rows.select("conv", "turn", "role", F.when(~F.col("gone"), F.col("text")).otherwise("").alias("text"), digest.alias("digest"), kind.alias("kind"))


_ORDER = ("turn", "role", "digest")


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by conversation, turn, role and digest."""
    names = ["conv", *COUNTS, "audit"]
    conv, state, kind_of = None, None, None
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(names)
        kinds = [kind_of, *[pa.int64()] * len(COUNTS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        kind_of = batch.schema.field("conv").type
        for c, turn, initial, kind, digest in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "initial", "kind", "digest"))):
            if state is None or c != conv:
                if state is not None:
                    out.append((conv, *state.result()))
                conv, state = c, _Open()
            if kind != "x":
                state.add(turn, initial, kind, digest)
        if len(out) >= 4096:
            yield table()
            out = []
    if state is not None:
        out.append((conv, *state.result()))
        yield table()


def audits(ready: DataFrame) -> DataFrame:
    """conv, the counts of faults, gaps, cost and audit of every conversation of ``prepared`` rows."""
    short = ready.select("conv", "turn", "role", F.substring("role", 1, 1).alias("initial"), "kind", "digest")
    sorted_rows = short.repartition("conv").sortWithinPartitions("conv", *_ORDER)
    kind = ready.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return sorted_rows.select("conv", "turn", "initial", "kind", "digest").mapInArrow(_audited, f"conv {kind}, {counts}, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("head", counts) of each conversation and then ("turn", letter, role, text) of its edits, in order."""
    letters, at, state = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            role, state = _NEXT[state]
            at += 1
            yield "turn", "I", role, ""

    for batch in batches:
        heads = batch.column("head").to_pylist()
        for i, (head, role, text) in enumerate(zip(heads, batch.column("role").to_pylist(), batch.column("text").to_pylist())):
            if head:
                yield from inserted()
                row = batch.slice(i, 1).to_pylist()[0]
                letters, at, state = row["audit"], 0, START
                yield "head", row
                continue
            yield from inserted()
            letter, at = letters[at], at + 1
            if letter == "R":
                role, state = _NEXT[state]
            elif letter == "K":
                state = SYSTEM if role[:1] == "s" else _NEXT[state][1]
            yield "turn", letter, role, text
    yield from inserted()


def _stream(ready: DataFrame, found: DataFrame) -> DataFrame:
    """All audits, each before the rows of its conversation, sorted within partitions."""
    rows = ready.where("kind <> 'x'").select("conv", F.lit(False).alias("head"), "turn", "role", "digest", "text", *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("audit"))
    none = {"turn": "long", "role": "string", "digest": "binary", "text": "string"}
    heads = found.select("conv", F.lit(True).alias("head"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], *COUNTS, "audit")
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", F.desc("head"), *_ORDER).select("conv", "head", "role", "text", *COUNTS, "audit")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", *COUNTS, "audit", "repaired_sha256"]
    kinds: list[pa.DataType] = []
    head, digest, first, out = None, None, True, []

    def watched() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[:] = [batch.schema.field("conv").type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            yield batch

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for edit in _edited(watched()):
        if edit[0] == "head":
            if head is not None:
                out.append((*(head[n] for n in names[:-1]), digest.hexdigest()))
            head, digest, first = edit[1], hashlib.sha256(), True
            if len(out) >= 4096:
                yield table()
                out = []
        elif edit[1] != "D":
            digest.update(f"{'' if first else chr(10)}{edit[2]}:{edit[3]}".encode())
            first = False
    if head is not None:
        out.append((*(head[n] for n in names[:-1]), digest.hexdigest()))
        yield table()


def repair_digests(ready: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``, the hash of the repaired "role:text" lines."""
    found = audits(ready)
    stream = _stream(ready, found)
    kind = ready.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return stream.mapInArrow(_digested, f"conv {kind}, {counts}, audit string, repaired_sha256 string")


def repaired(ready: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv, position (from 0), edit (K, R or I), role, text."""
    kind = ready.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, conv, position, kind_of, held = ["conv", "position", "edit", "role", "text"], [], None, 0, [], 0

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind_of[:] = [batch.schema.field("conv").type]
                yield batch

        def table() -> pa.RecordBatch:
            kinds = [kind_of[0], pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for edit in _edited(watched()):
            if edit[0] == "head":
                conv, position = edit[1]["conv"], 0
            elif edit[1] != "D":
                out.append((conv, position, *edit[1:]))
                position, held = position + 1, held + len(edit[3])
                if len(out) >= 4096 or held > 1 << 22:
                    yield table()
                    out, held = [], 0
        if out:
            yield table()

    return _stream(ready, audits(ready)).mapInArrow(run, f"conv {kind}, position long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to (conv_id, turn, role, text), as ``prepared`` rows; dropped rows are marked."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    harm = F.col("harm")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("harm"))
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (harm == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("copy"),
    )
    return prepared(rows, "conv_id", "turn", "role", "text", F.col("gone"))
