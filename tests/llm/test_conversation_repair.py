"""Operator 12 against a plain uniform-cost search over whole conversations."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskledger.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """Cheapest edits, ASCII-least: (cost, audit, text). rows: (role, text, fault)."""
    heap, done = [(0, "", 0, 0, "")], set()
    while heap:
        cost, audit, i, q, text = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, text
        if (i, q) in done:
            continue
        done.add((i, q))
        line = lambda role, said, text=text, q=q: f"{role}:{said}" if q == 0 else f"{text}\n{role}:{said}"
        want = "a" if q == 2 else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, GRAMMAR[q][want], line(FULL[want], "")))
        if i < len(rows):
            role, said, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, text))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] in GRAMMAR[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, GRAMMAR[q][role[:1]], line(role, said)))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, GRAMMAR[q][want], line(FULL[want], said)))


def plain(table):
    """The contract's rows, conversation by conversation, from (conv_id, turn, role, text)."""
    out, convs = {}, {}
    for conv, turn, role, text in table:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = plain_repair([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, table, parts=3):
    rows = spark.createDataFrame(table, SCHEMA).repartition(parts)
    got = C.repaired(C.damaged(rows)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def random_rows(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", "sys", "U", None]
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No!", "Well", "", " \t", None, f"T {turn} é.", f"T {turn}", "Why?\n"])
            rows.append((conv, None if rng.random() < 0.05 else turn + 2 * (rng.random() < 0.1), rng.choice(roles), text))
    return rows + rows[: len(rows) // 20]


def test_random_conversations_against_plain_search(spark):
    table = random_rows(5, 120, 12)
    assert found(spark, table) == plain(table)


def damaged_rows(table, conv):
    """A conversation's rows after damage, in order: (turn, role, text)."""
    rows = []
    for c, turn, role, text in table:
        if c == conv:
            fate = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fate == 1 else "".join(x for x in text if x not in ".!?") if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_segments_of_any_length_give_the_same(monkeypatch, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)  # here, not in Spark's workers
    table = random_rows(6, 120, 12)
    for conv, want in plain(table).items():
        talk, seen = C.Conversation(conv), set()
        for turn, role, text in damaged_rows(table, conv):
            talk.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        assert talk.result()[1:] == want


def test_long_conversations_run_through_segments(spark):
    rng = random.Random(9)
    table = [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2], rng.choice([f"Turn {t}.", f"Turn {t}", "Yes."])) for c in (1, 2) for t in range(700)]
    assert found(spark, table) == plain(table)


def test_every_state_to_every_state_costs_what_plain_search_says():
    rng = random.Random(2)
    for _ in range(400):
        rows = "".join(rng.choice("suaxSUAXdd" + "ua" * 4) for _ in range(rng.randint(0, 9)))
        ends = [C.cheapest(rows, C.START, q) for q in C.ACCEPTED]
        best = min(e for e in ends if e)
        plain_rows = [({"s": "system", "u": "user", "a": "assistant"}.get(r.lower(), "tool"), "x", "blank" if r == "d" else "truncated" if r.isupper() else None) for r in rows]
        assert best == plain_repair(plain_rows)[:2]
        for entry in C.STATES:  # an estimate never exceeds what it costs
            costs = [e[0] for q in C.STATES if (e := C.cheapest(rows, entry, q))]
            assert C.estimates(rows)[0][entry] <= min(costs)


def test_edges(spark):
    assert C.repaired(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", empty)}
    table = [(None, None, None, None), (None, 3, "user", "x" * 300_000 + "."), (7, 5, "assistant", "Yes."), (7, 5, "assistant", "Yes."), (7, None, "assistant", "Yes."), (7, None, "user", "No")]
    assert found(spark, table) == plain(table)
    extra = spark.createDataFrame(table, SCHEMA).withColumns({"digest": F.lit(1), "copies": F.lit("x"), "__n": F.lit(0), "audit": F.lit(2)})
    assert C.repaired(C.damaged(extra)).count() == 2


def test_one_turn_repeated_in_many_rows_and_turns(spark):
    table = [(1, t % 40, "user", "Yes.") for t in range(4000)] + [(1, 50, "assistant", "No.")]
    assert found(spark, table, 7) == plain(table)


def test_query_over_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in C.op12_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == plain([tuple(r) for r in rows])
