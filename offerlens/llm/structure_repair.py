"""Operator 11, repair of conversations' structure by a lazily determinised weighted automaton.

A conversation's roles should read (system? (user assistant)+)?. Each row is kept (0), given the role that is due (2) or deleted (3, the only
way for blank and duplicate rows); a user's or assistant's empty turn may be inserted anywhere (2); a truncated row that is not deleted adds 1.
The grammar has four places (nothing yet, behind system, behind user, behind assistant). Reading backwards, the least costs
to the end from all four, less their minimum, are one of a few vectors: each vector is a state of an automaton made as it is met and
cached with its transitions (9 kinds of rows). One scan backwards over the table gives the costs; the trace goes the other way along arcs
that are tight, at each place the edit whose initial comes first (D, I, K, R), also from a cached table. The initials of an optimal
repair fix its roles, so the audit that is least in ASCII is one repair.

Rows are collapsed first (equal rows of a turn become one with a count), duplicates are found by grouping, and rows are dealt by ranges of
(conv_id, turn, role, digest of the text), so a conversation of any size is spread over tasks. A task repairs the conversations that lie
inside its range at once; pieces of those that reach its borders, or exceed PIECE_ROWS or PIECE_BYTES, give their costs from each to each place
(the scan from four unit vectors). These are combined backwards by conversation, then the places where each piece's trace leaves are combined
forwards, and the pieces are traced. Only numbers meet by conversation there; a digest of a whole conversation reads its pieces one by one.

Defined cases: null roles and texts count as one space. Rows that have the same turn are ordered by role, then by SHA-256 of the text;
null turns come first. A role counts by its first character as it is (s, u, a); an empty role has none. Null conv_ids are one conversation.
A row is a duplicate if the same role and text (compared by SHA-256) came before in its conversation. Rows without a text are blank; very long
texts are pieces of their own. A conversation all of whose rows were dropped has zeros. An empty table gives an empty result. Ties as above. Extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read_table, slices

PIECE_ROWS = 20_000
PIECE_BYTES = 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 50
BLANKS = " \t\n\x0b\x0c\r"
#: Faults of a row.
NONE, BLANK, DUPLICATE, CUT, DROPPED = range(5)
#: Places: 0 nothing yet, 1 behind system, 2 behind user, 3 behind assistant. What is due there, and the place behind it.
DUE = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: From a place, by a role's kind (0 s, 1 u, 2 a, 3 other), the place behind a kept row.
NEXT = [{0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2}]
KINDS = {"s": 0, "u": 1, "a": 2}
#: The symbol of a row that must be deleted; others are 2 * kind + truncated.
MUST = 8
LEGAL = {"su", "ua", "au"}

Vector = tuple[int, int, int, int]


def closed(costs: list[int]) -> list[int]:
    """Costs with inserted turns before what follows."""
    out = list(costs)
    for _ in range(3):
        for q in range(4):
            out[q] = min(out[q], INSERT + out[DUE[q][1]])
    return [min(c, FAR) for c in out]


#: Costs at the end of a conversation.
END: Vector = tuple(closed([0, FAR, FAR, 0]))


class Automaton:
    """Vectors of costs to the end as states; transitions and traces are made when first needed."""

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.number: dict[Vector, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, tuple[str, ...], str | None, int]] = {}

    def state(self, costs: list[int] | Vector) -> tuple[int, int]:
        """(state, its minimum) of a vector of costs."""
        low = min(costs)
        vector = tuple(c - low if c < FAR else FAR for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], low

    def _row(self, after: int, symbol: int) -> list[int]:
        """Costs before a row, given the state after it."""
        v = self.vectors[after]
        out = [DELETE + c for c in v]
        if symbol != MUST:
            kind, cut = divmod(symbol, 2)
            for q in range(4):
                if kind in NEXT[q]:
                    out[q] = min(out[q], KEEP + TRUNCATED * cut + v[NEXT[q][kind]])
                out[q] = min(out[q], REROLE + TRUNCATED * cut + v[DUE[q][1]])
        return closed(out)

    def step(self, after: int, symbol: int) -> tuple[int, int]:
        """(state before a row, cost added)."""
        got = self.steps.get((after, symbol))
        if got is None:
            got = self.steps[after, symbol] = self.state(self._row(after, symbol))
        return got

    def trace(self, after: int, symbol: int, q: int) -> tuple[str, tuple[str, ...], str | None, int]:
        """(initials, roles inserted before the row, the row's role if it was rerolled, place behind it): the least tight edits up to and with a row. A kept row's role is ""; a deleted one's None."""
        got = self.traces.get((after, symbol, q))
        if got is None:
            got = self.traces[after, symbol, q] = self._trace(after, symbol, q)
        return got

    def _trace(self, after: int, symbol: int, q: int) -> tuple[str, tuple[str, ...], str | None, int]:
        v, costs = self.vectors[after], self._row(after, symbol)
        kind, cut = divmod(symbol, 2)
        inserted: list[str] = []
        while True:
            done = "I" * len(inserted)
            role, due = DUE[q]
            if costs[q] == DELETE + v[q]:
                return done + "D", tuple(inserted), None, q
            if costs[q] == INSERT + costs[due]:
                inserted.append(role)
                q = due
            elif symbol != MUST and kind in NEXT[q] and costs[q] == KEEP + TRUNCATED * cut + v[NEXT[q][kind]]:
                return done + "K", tuple(inserted), "", NEXT[q][kind]
            else:
                return done + "R", tuple(inserted), role, due

    def scan(self, symbols: bytes, counts: list[int], end: list[int] | Vector = END) -> tuple[list[int], list[int]]:
        """(states after each symbol's run, costs before the first): the scan backwards. counts: how often a symbol repeats; only MUST does."""
        state, total = self.state(end)
        after = [0] * len(symbols)
        step, steps = self.step, self.steps
        for i in range(len(symbols) - 1, -1, -1):
            after[i] = state
            s = symbols[i]
            if s == MUST:
                total += DELETE * counts[i]  # the vector stays: every place pays the same
            else:
                state, cost = steps.get((state, s)) or step(state, s)
                total += cost
        return after, [c + total if c < FAR else FAR for c in self.vectors[state]]

    def leave(self, symbols: bytes, after: list[int], q: int) -> int:
        """The place behind the last row of a trace."""
        for s, a in zip(symbols, after):
            if s != MUST:
                q = self.trace(a, s, q)[3]
        return q

    def walk(self, symbols: bytes, counts: list[int], after: list[int], rows: list[tuple[str, str]], q: int, last: bool) -> tuple[str, list[tuple[str, str]]]:
        """(audit, repaired turns) from place q. rows: the (role, text) of every symbol other than MUST, in order; last: nothing follows."""
        audit: list[str] = []
        turns: list[tuple[str, str]] = []
        given = iter(rows)
        for s, n, a in zip(symbols, counts, after):
            if s == MUST:
                audit.append("D" * n)
                continue
            edits, inserted, role, q = self.trace(a, s, q)
            own = next(given)
            audit.append(edits)
            turns += [(r, "") for r in inserted]
            if role is not None:
                turns.append((role or own[0], own[1]))
        while last and END[q]:
            role, q = DUE[q]
            audit.append("I")
            turns.append((role, ""))
        return "".join(audit), turns


# ---- rows and their faults, by expressions ----


def given_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, dropped) of conversations as they are."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("dropped"))


def damaged(rows: DataFrame) -> DataFrame:
    """given_rows() with faults made by crc32 of conv_id:turn: of 20 values, 0 drops a row, 1 empties its text, 2 removes its marks, 3 repeats it, 4 makes it the user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.col("__d")
    rows = given_rows(rows).withColumn("__d", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20)
    return rows.withColumns({
        "dropped": d == 0, "copies": F.when(d == 3, 2).otherwise(1).cast("long"), "role": F.when(d == 4, "user").otherwise(F.col("role")),
        "text": F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
    }).drop("__d")


def collapsed(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with a count and a digest, what was dropped of a conversation as one row; a table."""
    gone = F.col("dropped")
    blank = lambda c, other: F.when(gone, other).otherwise(F.col(c)).alias(c)
    rows = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), blank("role", ""), blank("text", ""), "copies", "dropped")
    return materialize(rows.groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.sum("copies").alias("n")).withColumn("digest", F.unhex(F.sha2("text", 256))), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, n, fault) of collapsed() rows: the fault of the first of equal ones; DROPPED for what was dropped."""
    gone = F.col("dropped")
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    seen = rows.where(~gone).groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("at"))
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.turn").alias("t"), F.lit(True).alias("new"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    fault = F.when(gone, DROPPED).when(body == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NONE)
    # each key has one row on either side: a turn is part of it
    return rows.join(seen.hint("merge"), same, "left").select("conv_id", "turn", "role", "text", "digest", "n", fault.alias("fault"))


# ---- pieces ----

_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("lone", pa.bool_()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns_n", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("rows_n", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()),
    ("symbols", pa.binary()), ("counts", pa.list_(pa.int64())), ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(_TURN)),
])
_PIECE_SQL = "conv_id long, part long, piece long, lone boolean, first_turn long, last_turn long, turns_n long, blank long, duplicate long, truncated long, illegal long, rows_n long, first_role string, last_role string, symbols binary, counts array<long>, cost long, audit string, turns array<struct<role:string,text:string>>"
_automaton = Automaton()


class Piece:
    """Consecutive rows of a conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.size = conv_id, 0
        self.first_turn = self.last_turn = None
        self.turns_n = self.blank = self.duplicate = self.truncated = self.illegal = self.rows_n = 0
        self.first_role = self.last_role = None
        self.symbols, self.counts, self.rows = bytearray(), [], []

    def add(self, turn: int | None, role: str, text: str, n: int, fault: int) -> None:
        if fault == DROPPED:
            return
        if turn is not None:
            self.turns_n += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.blank += n * (fault == BLANK)
        self.duplicate += n if fault == DUPLICATE else (n - 1) * (fault != BLANK)
        self.truncated += fault == CUT
        initial = role[:1]
        self.illegal += n - 1 + (self.last_role is not None and self.last_role + initial not in LEGAL)
        self.first_role = initial if self.first_role is None else self.first_role
        self.last_role = initial
        self.rows_n += n
        must = n
        if fault in (NONE, CUT):
            self.symbols.append(2 * KINDS.get(initial, 3) + (fault == CUT))
            self.counts.append(1)
            self.rows.append((role, text))
            self.size += len(text) + 64
            must -= 1
        if must and self.symbols and self.symbols[-1] == MUST:
            self.counts[-1] += must
        elif must:
            self.symbols.append(MUST)
            self.counts.append(must)

    def row(self, part: int, piece: int, lone: bool) -> tuple:
        symbols = bytes(self.symbols)
        cost, audit, turns = None, None, self.rows
        if lone:
            after, costs = _automaton.scan(symbols, self.counts)
            cost = costs[0]
            audit, turns = _automaton.walk(symbols, self.counts, after, self.rows, 0, True)
        return (self.conv_id, part, piece, lone, self.first_turn, self.last_turn, self.turns_n, self.blank, self.duplicate, self.truncated, self.illegal, self.rows_n,
                self.first_role, self.last_role, None if lone else symbols, None if lone else self.counts, cost, audit, [{"role": r, "text": t} for r, t in turns])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _flow(rows: Iterator[tuple], part: int, piece_rows: int, piece_bytes: int) -> Iterator[tuple]:
    """Pieces of a task's rows in order: whole conversations repaired, those at the task's borders and parts of long ones as they are."""
    piece, number, lone, begun = None, 0, False, False
    for conv_id, turn, role, text, n, fault in rows:
        if piece is not None and piece.conv_id != conv_id:
            yield piece.row(part, number, lone)
            piece, number, lone, begun = Piece(conv_id), number + 1, True, True
        elif piece is None:
            piece, lone = Piece(conv_id), begun
        elif len(piece.symbols) >= piece_rows or piece.size >= piece_bytes:
            yield piece.row(part, number, False)
            piece, number, lone = Piece(conv_id), number + 1, False
        piece.add(turn, role, text, n, fault)
    if piece is not None:
        yield piece.row(part, number, False)


def pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES, parts: int | None = None) -> DataFrame:
    """All pieces of with_faults() rows, in ranges of their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (r for batch in batches for part in slices(batch) for r in zip(*(c.to_pylist() for c in part.columns)))
        out, size = [], 0
        for row in _flow(given, TaskContext.get().partitionId(), piece_rows, piece_bytes):
            out.append(row)
            size += 200 + sum(len(t["text"]) for t in row[-1])
            if size > 4 << 20:
                yield _batch(out, _PIECE)
                out, size = [], 0
        if out:
            yield _batch(out, _PIECE)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "n", "fault").mapInArrow(run, _PIECE_SQL)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs of a piece from each place to each: 16 numbers, by the place behind it."""
    for batch in batches:
        found = [[c for q in range(4) for c in _automaton.scan(s, n, [0 if q == k else FAR for k in range(4)])[1]] for s, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "units"])


def _ends(table: pa.Table) -> pa.Table:
    """Per piece of a conversation, the costs behind it; the first piece has the conversation's cost."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("part", "piece", "units"))), reverse=True)
    costs, out = list(END), []
    for i, (part, piece, u) in enumerate(rows):
        last = i == len(rows) - 1
        behind, costs = costs, [min(min(u[4 * k + q] + costs[k] for k in range(4)), FAR) for q in range(4)]
        out.append((part, piece, behind, i == 0, costs[0] if last else 0))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64()))], names=["part", "piece", "behind", "is_last", "whole_cost"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the trace through a piece leaves it, by where it enters."""
    for batch in batches:
        found = []
        for s, n, behind in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
            after = _automaton.scan(s, n, behind)[0]
            found.append([_automaton.leave(s, after, q) for q in range(4)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "exits"])


def _entries(table: pa.Table) -> pa.Table:
    """Per piece of a conversation, the place where the trace enters it."""
    q, out = 0, []
    for part, piece, exits in sorted(zip(*(table.column(c).to_pylist() for c in ("part", "piece", "exits")))):
        out.append((part, piece, q))
        q = exits[q]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["part", "piece", "enter"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = {f.name: i for i, f in enumerate(_PIECE)}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            after = _automaton.scan(r["symbols"], r["counts"], r["behind"])[0]
            audit, turns = _automaton.walk(r["symbols"], r["counts"], after, [(t["role"], t["text"]) for t in r["turns"]], r["enter"], r["is_last"])
            row = [r[f.name] for f in _PIECE]
            row[at["symbols"]] = row[at["counts"]] = None
            row[at["cost"]], row[at["audit"]], row[at["turns"]] = r["whole_cost"], audit, [{"role": a, "text": b} for a, b in turns]
            out.append(tuple(row))
        if out:
            yield _batch(out, _PIECE)


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES, parts: int | None = None) -> DataFrame:
    """Repaired pieces of conversations: rows as given_rows() or damaged() make them. `turns` has a piece's repaired roles and texts, `audit` its edits; (part, piece) orders the pieces of a conversation; lone: it is the only one."""
    turns = collapsed(rows)
    faults = materialize(with_faults(turns), "faults")
    discard(turns)
    found = materialize(pieces(faults, piece_rows, piece_bytes, parts), "pieces")
    discard(faults)
    open_ = found.where("not lone")
    key = ["part", "piece"]
    units = open_.select("conv_id", *key, "symbols", "counts").mapInArrow(_units, "conv_id long, part long, piece long, units array<long>")
    ends = materialize(units.groupBy("conv_id").applyInArrow(_ends, "part long, piece long, behind array<long>, is_last boolean, whole_cost long"), "ends")
    exits = open_.select("conv_id", *key, "symbols", "counts").join(ends.select(*key, "behind"), key).select("conv_id", *key, "symbols", "counts", "behind").mapInArrow(_exits, "conv_id long, part long, piece long, exits array<long>")
    entries = materialize(exits.groupBy("conv_id").applyInArrow(_entries, "part long, piece long, enter long"), "entries")
    traced = open_.join(ends, key).join(entries, key).mapInArrow(_traced, _PIECE_SQL)
    return found.where("lone").unionByName(traced)


def repaired_turns(found: DataFrame) -> DataFrame:
    """(conv_id, part, piece, place, role, text): the repaired turns as rows, ordered by (part, piece, place)."""
    return found.select("conv_id", "part", "piece", F.posexplode("turns").alias("place", "turn")).select("conv_id", "part", "piece", "place", "turn.role", "turn.text")


_WHOLE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(found: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its turns, faults, cost, audit and the SHA-256 of its repaired lines. Pieces of a conversation are read in order, one at a time."""
    gaps = lambda lo, hi, n: F.coalesce(F.col(hi) - F.col(lo) + 1 - F.col(n), F.lit(0).cast("long")).alias("gaps")
    lines: Column = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    lone = found.where("lone").select("conv_id", gaps("first_turn", "last_turn", "turns_n"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    names = [c.split()[0] for c in _WHOLE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have = None, None
        for batch in batches:
            for part in slices(batch):
                for r in part.to_pylist():
                    if have is None or r["conv_id"] != now:
                        if have is not None:
                            yield _whole(now, have, names)
                        now, have = r["conv_id"], {"lo": None, "hi": None, "n": 0, "sums": [0] * 5, "audit": [], "sha": hashlib.sha256(), "lines": 0, "role": None}
                    _join(have, r)
        if have is not None:
            yield _whole(now, have, names)

    order = [F.col("conv_id").asc_nulls_first(), "part", "piece"]
    rest = found.where("not lone").drop("symbols", "counts").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, _WHOLE)
    return lone.unionByName(rest)


def _join(have: dict, r: dict) -> None:
    """Adds a piece to what its conversation has so far."""
    if r["first_turn"] is not None:
        have["n"] += r["turns_n"] - (have["hi"] == r["first_turn"])
        have["lo"], have["hi"] = r["first_turn"] if have["lo"] is None else have["lo"], r["last_turn"]
    for i, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
        have["sums"][i] += r[c]
    if r["first_role"] is not None:
        have["sums"][3] += have["role"] is not None and have["role"] + r["first_role"] not in LEGAL
        have["role"] = r["last_role"]
    have["audit"].append(r["audit"])
    for t in r["turns"]:
        have["sha"].update((("\n" if have["lines"] else "") + f"{t['role']}:{t['text']}").encode())
        have["lines"] += 1


def _whole(conv_id: int | None, have: dict, names: list[str]) -> pa.RecordBatch:
    blank, duplicate, truncated, illegal, cost = have["sums"]
    gaps = 0 if have["lo"] is None else have["hi"] - have["lo"] + 1 - have["n"]
    values = [conv_id, gaps, blank, duplicate, truncated, illegal, cost, "".join(have["audit"]), have["sha"].hexdigest()]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c, v in zip(names, values)], names=names)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(repaired(damaged(read_table(spark, sf_dir, "conversations"))))


QUERIES = {"op11_structure_repair": op11_structure_repair}
ORACLES: dict[str, str] = {}
