"""Operator 12, conversation structure repair by iterative-deepening A*.

A conversation's roles should read s?(ua)+ by their initials. The cheapest edits that make
them so are found by a depth-first search in ASCII order of the edits, under a cost bound that rises to the
least cost still possible; what a failed state has shown to cost at least is kept in a table, so the
first path that is accepted is the cheapest, and the first in ASCII order among those.

Rows meet by conversation, sorted, and each task reads them as a stream. A long conversation is searched
segment by segment: for each state of the grammar at a segment's start and end the cheapest edits, of which
the best way to each state goes on. So a task holds one segment's rows and at most four ways.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from riskledger.llm._common import table
from riskledger.llm._words import slices

#: What edits cost, and the white space of the text rules.
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: States of the grammar: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
ACCEPTED = (START, ASSISTANT)
NEVER = 1 << 60
#: Rows of a conversation that are searched at once.
SEGMENT = 64
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


# ---- the search ------------------------------------------------------------------------


def symbol(initial: str, fault: str | None) -> str:
    """A row as the search sees it: d if it must go, else its role's initial (x: none of the
    grammar's), a capital if it is truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


def forced(letter: str, started: bool) -> int:
    """The least that a row costs whatever its neighbours; once started, a system's row can't stay."""
    if letter == "d":
        return DELETE
    cut = TRUNCATED if letter.isupper() else 0
    stays = letter.lower() in ("u", "a") or (letter.lower() == "s" and not started)
    return cut if stays else min(REROLE + cut, DELETE)


def estimates(rows: str) -> list[list[int]]:
    """For each place and state a cost that the rest of rows takes at least: what each row costs by itself,
    and 1 for each two neighbours of one role, as an edit of 2 at least mends two of these at most."""
    out = [[0] * 4 for _ in range(len(rows) + 1)]
    for started in (False, True):
        total, after = 0, ""
        for i in range(len(rows) - 1, -1, -1):
            total += forced(rows[i], started)
            if rows[i] != "d":
                own = rows[i].lower()
                total += own in ("u", "a") and own == after
                after = own
            for q in STATES:
                if started == (q != START):
                    out[i][q] = total
    return out


def moves(rows: str, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next place, next state) in ASCII order."""
    wanted = "a" if q == USER else "u"
    out = []
    if i < len(rows):
        out.append(("D", DELETE, i + 1, q))
    out.append(("I", INSERT, i, NEXT[q][wanted]))
    if i < len(rows) and rows[i] != "d":
        cut = TRUNCATED if rows[i].isupper() else 0
        if (to := NEXT[q].get(rows[i].lower())) is not None:
            out.append(("K", KEEP + cut, i + 1, to))
        out.append(("R", REROLE + cut, i + 1, NEXT[q][wanted]))
    return out


@lru_cache(maxsize=50_000)
def cheapest(rows: str, entry: int, leave: int) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way through rows from one state to another, the ASCII-least of
    these; None if there is none."""
    least = estimates(rows)
    for q in STATES:
        # nothing leads back to the start, and only a system's row to the state after it
        if (leave == START and q != START) or (leave == SYSTEM and q not in (START, SYSTEM)):
            for at in least:
                at[q] = NEVER
    path: list[str] = []

    def reaches(i: int, q: int, left: int) -> bool:
        """Whether a way that costs at most left goes on from here; else the table learns what it costs at least."""
        if i == len(rows) and q == leave:
            return True
        best = NEVER
        for edit, cost, j, p in moves(rows, i, q):
            if cost + least[j][p] <= left and reaches(j, p, left - cost):
                path.append(edit)
                return True
            best = min(best, cost + least[j][p])
        least[i][q] = max(least[i][q], best)
        return False

    bound = least[0][entry]
    while bound < NEVER:
        if reaches(0, entry, bound):
            return bound, "".join(reversed(path))
        bound = least[0][entry]
    return None


# ---- a conversation as a stream ----------------------------------------------------------


class Way:
    """The best way so far to a state: its cost, its edits as a chain of segments, and the hash of what it repaired."""

    def __init__(self, cost: int, edits: str, before: Way | None, digest) -> None:
        self.cost, self.edits, self.before, self.digest = cost, edits, before, digest

    def audit(self) -> str:
        parts, way = [], self
        while way is not None:
            parts.append(way.edits)
            way = way.before
        return "".join(reversed(parts))


def precedes(a: tuple[Way, str], b: tuple[Way, str]) -> bool:
    """Whether way and edits a read before b; only what follows the ways' common part is compared."""
    (p, x), (q, y) = a, b
    while p is not q:
        x, y, p, q = p.edits + x, q.edits + y, p.before, q.before
    return x < y


def write(digest, rows: list[tuple[str, str]], edits: str, state: int) -> None:
    """Add the rows, repaired by edits, to the hash; nothing was written in the starting state."""
    i = 0
    for edit in edits:
        if edit == "D":
            i += 1
            continue
        role, text = rows[i] if edit != "I" else ("", "")
        letter = role[:1] if edit == "K" else "a" if state == USER else "u"
        if edit != "K":
            role = ROLES[letter]
        line = f"{role}:{text}"
        digest.update((line if state == START else f"\n{line}").encode())
        state = NEXT[state][letter]
        i += edit != "I"


class Conversation:
    """Reads one conversation's rows in order and keeps what its result needs."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys(COLUMNS, 0)
        self.first = self.last = self.role = None
        self.turns = 0
        self.rows: list[tuple[str, str]] = []
        self.symbols: list[str] = []
        self.ways = {START: Way(0, "", None, hashlib.sha256())}

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if len(self.rows) == SEGMENT:
            self.advance(STATES)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        end = text.rstrip(BLANKS)[-1:]
        fault = "blank" if not end else "duplicate" if seen else None if end in ENDS else "truncated"
        if fault:
            self.counts[fault] += 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.role = role
        self.rows.append((role, text))
        self.symbols.append(symbol(role[:1], fault))

    def advance(self, leaving: tuple[int, ...]) -> None:
        """Search the segment and keep the best way to each state that it may leave in."""
        rows, ways = "".join(self.symbols), {}
        for leave in leaving:
            best = None
            for entry, way in self.ways.items():
                if (found := cheapest(rows, entry, leave)) is None:
                    continue
                new = (way.cost + found[0], way, found[1], entry)
                if best is None or new[0] < best[0] or (new[0] == best[0] and precedes(new[1:3], best[1:3])):
                    best = new
            if best is not None:
                cost, way, edits, entry = best
                digest = way.digest.copy()
                write(digest, self.rows, edits, entry)
                ways[leave] = Way(cost, edits, way, digest)
        self.ways, self.rows, self.symbols = ways, [], []

    def result(self) -> tuple:
        self.advance(ACCEPTED)
        ended = sorted(self.ways.values(), key=lambda w: (w.cost, w.audit()))[0]
        if self.turns:
            self.counts["gaps"] = self.last - self.first + 1 - self.turns
        self.counts["cost"] = ended.cost
        return (self.conv_id, *[self.counts[c] for c in COLUMNS], ended.audit(), ended.digest.hexdigest())


def repair_pass(schema: pa.Schema):
    """The result of each conversation; batches come sorted by conversation, turn and digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield from zip(*[batch[c].to_pylist() for c in ("conv_id", "turn", "digest", "copies", "role", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, before = None, None
        for conv_id, turn, digest, copies, role, text in rows(batches):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    done.append(now.result())
                now, before = Conversation(conv_id), None
            for _ in range(copies):
                now.add(turn, role, text, digest == before)
                before = digest
            if copies < 0:  # an earlier turn has this role and text
                before = digest
            if len(done) >= 1000:
                yield packed(done)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield packed(done)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


# ---- over all conversations -----------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conversations after the damage that their crc32 names: how many copies of each row stay (0 to 2), its role and text. Nulls are one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(known("text"), ENDS, "")).otherwise(known("text"))
    role = F.when(fate == 4, "user").otherwise(known("role"))
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), copies.alias("copies"), role.alias("role"), text.alias("text"))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows
    (conv_id, turn, copies, role, text; other columns are not read), where a row stands for copies of itself.

    Rows come by turn, nulls first; those of one turn by role, then by the MD5 of role and text. Of
    each row the first fault counts: blank, duplicate (of a role and text before it), truncated. Null conv_ids are
    one conversation; a conversation without copies has zeros, no edits and the hash of nothing; roles
    and texts must not be null (damaged fills them); an empty table gives an empty result. Texts
    are hashed whole, whatever their length. The hash of a conversation is one value over its rows in order, so these
    stream through one task; the audit alone, a byte a row, grows with a conversation.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.select("conv_id", "turn", "copies", "role", "text").withColumn("digest", digest)
    # turns that repeat a role and text of an earlier turn: found in rows without texts
    known = rows.filter("copies > 0").groupBy("conv_id", "turn", "role", "digest").agg(F.lit(-1).alias("copies"))
    first = known.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    first = first.select(F.col("conv_id").alias("__c"), F.col("digest").alias("__d"), "__first")
    again = known.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("digest") == F.col("__d"))).filter(~F.col("turn").eqNullSafe(F.col("__first.turn")))
    marks = again.select("conv_id", "turn", "copies", "role", F.lit(None).cast("string").alias("text"), "digest")
    ordered = rows.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "copies")
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *[StructField(c, LongType()) for c in COLUMNS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])
    return ordered.mapInArrow(repair_pass(arrow), schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
