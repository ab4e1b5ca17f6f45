"""Conversation repair against a search over all edits, and the registered query against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

import __spark_entry__ as entry
from tonewise.llm import turns

SHAPE = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Dijkstra over (row, initials so far as a state) ordered by cost and then by letters."""
    n = len(rows)
    best: dict[tuple[int, str], tuple[int, str]] = {}
    heap = [(0, "", 0, "")]
    while heap:
        cost, letters, i, state = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = (cost, letters)
        if i == n and state in ("", "a"):
            return cost, letters

        def go(letter, j, initial, more):
            if initial is None:
                heapq.heappush(heap, (cost + more, letters + letter, j, state))
            elif (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                heapq.heappush(heap, (cost + more, letters + letter, j, initial))

        for role in "ua":
            go("I", i, role, 2)
        if i < n:
            initial, kind = rows[i]
            go("D", i + 1, None, 3)
            if kind != turns.GONE:
                more = 1 if kind == turns.CUT else 0
                go("K", i + 1, initial or "-", more)
                for role in "ua":
                    go("R", i + 1, role, 2 + more)
    raise AssertionError


def test_audit_is_the_least_cheapest():
    rng = random.Random(4)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.choice([turns.FINE, turns.FINE, turns.CUT, turns.GONE])) for _ in range(rng.randint(0, 9))]
        assert turns.audit(rows) == cheapest(rows), rows


def test_long_conversation_takes_linear_time():
    rows = [(("u", "a", "t")[i * i % 3], i % 7 == 0 and turns.CUT or turns.FINE) for i in range(200_000)]
    cost, letters = turns.audit(rows)
    assert cost > 0 and len(letters.replace("I", "")) == len(rows)


def brute(rows):
    """The contract on (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if harm == 0:
                continue
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            role = "user" if harm == 4 else role
            kept += [(turn, role, text)] * (2 if harm == 3 else 1)
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()[:16]
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in kept:
            ended = text.rstrip(SPACES)
            if not ended:
                counts[0] += 1
                fault = turns.GONE
            elif (role, text) in seen:
                counts[1] += 1
                fault = turns.GONE
            elif ended[-1] not in ".!?":
                counts[2] += 1
                fault = turns.CUT
            else:
                fault = turns.FINE
            seen.add((role, text))
            faults.append((role[:1], fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faults, faults[1:]))
        some = [t for t, _, _ in kept if t is not None]
        gaps = max(some) - min(some) + 1 - len(set(some)) if some else 0
        cost, letters = cheapest(faults)
        at, lines = 0, []
        for letter in letters:
            last = lines[-1][0][:1] if lines else ""
            wanted = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append((wanted, ""))
                continue
            _, role, text = kept[at]
            at += 1
            if letter != "D":
                lines.append((wanted if letter == "R" else role, text))
        assert at == len(kept) and SHAPE.fullmatch("".join(r[:1] for r, _ in lines))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, letters, sha)
    return out


def result(df):
    rows = df.select("conv", *turns.COUNTS, "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = entry.queries()["op13_conversation_repair"](spark, sf)
    assert got.columns == ["conv_id", *turns.COUNTS, "audit", "repaired_sha256"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "a.", "a", "b!", "b?\n", "x\x1c", "é\x0b", "long " * 30_000, "."]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "unusual", "sable"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(-3, 9)]), rng.choice(roles), rng.choice(texts)) for _ in range(900)]
    rows += rows[:50] + [(77, None, "user", "x."), (77, None, None, None)]
    df = spark.createDataFrame([(*r, "z", 3) for r in rows], "conv_id long, turn long, role string, text string, audit string, conv int")
    want = brute(rows)
    assert result(turns.repair_digests(turns.damaged(df.repartition(5)))) == want
    assert result(turns.repair_digests(turns.damaged(df.coalesce(1)))) == want
    lines: dict = {}
    for r in turns.repaired(turns.damaged(df)).collect():
        lines.setdefault(r["conv"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    for conv, found in want.items():
        mine = [t for _, t in sorted(lines.get(conv, []))]
        assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == found[-1]


def test_empty_table_and_lost_conversations(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert turns.repair_digests(turns.damaged(spark.createDataFrame([], shape))).count() == 0
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = turns.repair_digests(turns.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], shape))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_extreme_turns(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b."), (2, 2**62, "user", "a.")]
    ready = turns.prepared(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    got = {r["conv"]: r["gaps"] for r in turns.audits(ready).collect()}
    assert got == {1: None, 2: 0}


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_id_types(spark, kind):
    rows = spark.createDataFrame([("5", 0, "user", "a."), ("5", 1, "assistant", "b.")], "conv_id string, turn int, role string, text string")
    ready = turns.prepared(rows.withColumn("conv_id", rows.conv_id.cast(kind)), "conv_id", "turn", "role", "text")
    (row,) = turns.repair_digests(ready).collect()
    assert (str(row["conv"]), row["audit"], row["cost"]) == ("5", "KK", 0)
