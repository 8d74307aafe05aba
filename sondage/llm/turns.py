"""Repair of conversation structure by edit scripts, with Four-Russians block tables.

A conversation's rows, by turn, become symbols: must be deleted (blank, or role and text
seen before), or the role's initial with whether the text is cut off. Edits turn them into
roles of the form ``(s?(ua)+)?``; an automaton of four states (nothing yet, after s, after
u, after a) accepts that. The cost to go from each state is a vector of four numbers. Less
its minimum, only a few dozen vectors ever occur, so for every vector and every block of
``LENGTH`` symbols the vector before the block and the cost added are tabulated once; a
conversation is processed from its end, one look-up per block. The trace expands one block
at a time backward from the vector kept at its end, then walks through it, at each place
taking the ASCII-least edit that stays optimal. The edit decides the next state, so the walk
finds the least of all cheapest scripts.

Rows are range-sorted by (conversation, turn, role, text), so that no conversation has to be
gathered. A task finishes the conversations that lie wholly inside its part of that order,
one at a time. The first and last of a part, which may go on elsewhere, and any of more than
``PIECE`` rows take a second way in pieces: symbols per piece, then one look-up pass over a
conversation's symbols (a byte a row, as many as its audit has letters), then the repaired
text per piece, and a hash that streams through the pieces.

Defined results: a null role or text is one space; turns may be null (first) or repeated;
rows of one turn are taken by role, then by the first 256 characters of the text, then by
its hash. All rows without a conversation id are one conversation. Other columns are
ignored; an empty table gives no rows. Roles count by their first character, whatever follows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .frames import pick, saved

LENGTH = 3  # symbols in a block
PIECE = 4096  # rows of a conversation held at a time
PIECE_CHARS = 16 << 20
FAR = 1 << 20  # more than any cost between states
SYMBOLS = 9  # 0: to be deleted; 1 + 4 * truncated + place of the initial in "sua" (3: another)
DELETED = 0
SPACES = " \t\n\x0b\x0c\r"
KEEPS = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})  # state: initial -> state after a kept row
NEXT = (2, 2, 3, 2)  # state after an inserted or rerouted row
ROLES = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
RESULTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Cost vectors close under insertions of the next role."""
    for _ in range(3):
        costs = [min(c, 2 + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


END = _inserted([0, FAR, FAR, 0])


def _before(costs: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs to go before a row from those after it."""
    found = []
    for state in range(4):
        options = [3 + costs[state]]
        if symbol != DELETED:
            late, initial = divmod(symbol - 1, 4)
            options.append(2 + late + costs[NEXT[state]])
            if initial in KEEPS[state]:
                options.append(late + costs[KEEPS[state][initial]])
        found.append(min(options))
    return _inserted(found)


class Tables:
    """Normalised vectors and what one symbol, or a block of them, makes of each."""

    def __init__(self):
        names: dict[tuple[int, ...], int] = {}

        def name(vector: tuple[int, ...]) -> tuple[int, int]:
            low = min(vector)
            key = tuple(v - low for v in vector)
            if key not in names:
                names[key] = len(names)
                self.vectors.append(key)
            return names[key], low

        self.vectors: list[tuple[int, ...]] = []
        self.end, _ = name(END)
        one, cost = [], []
        for vector in self.vectors:  # grows while vectors not seen before turn up
            both = [name(_before(vector, s)) for s in range(SYMBOLS)]
            one.append([n for n, _ in both])
            cost.append([c for _, c in both])
        single, added = np.array(one), np.array(cost)
        # For a block s1 .. sn, coded with s1 as the highest digit, the last symbol is applied first.
        block, total = np.arange(len(one))[:, None], np.zeros((len(one), 1), np.int64)
        for _ in range(LENGTH):
            total = np.concatenate([total + added[block, s] for s in range(SYMBOLS)], axis=1)
            block = np.concatenate([single[block, s] for s in range(SYMBOLS)], axis=1)
        self.one, self.cost = one, cost
        self.block, self.total = block.tolist(), total.tolist()


@cache
def tables() -> Tables:
    return Tables()


def trace(symbols: bytes) -> tuple[str, int]:
    """The ASCII-least of the cheapest scripts, and its cost."""
    t = tables()
    codes = np.frombuffer(symbols, np.uint8).astype(np.int64)
    front = len(codes) % LENGTH
    blocks = codes[front:].reshape(-1, LENGTH) @ SYMBOLS ** np.arange(LENGTH)[::-1]
    ends, cost, vector = array("H"), 0, t.end
    for code in blocks[::-1].tolist():
        ends.append(vector)
        cost += t.total[vector][code]
        vector = t.block[vector][code]
    if front:
        ends.append(vector)
    state, out, start = 0, [], 0
    for place in range(len(ends) - 1, -1, -1):
        stop = start + (front if start == 0 and front else LENGTH)
        inside = [ends[place]]
        for symbol in symbols[start:stop][::-1]:
            inside.append(t.one[inside[-1]][symbol])
        inside.reverse()  # vectors before each symbol, and after the last
        for symbol, now, after in zip(symbols[start:stop], inside, inside[1:]):
            gain = t.cost[after][symbol]
            here, then = t.vectors[now], t.vectors[after]
            late, initial = divmod(symbol - 1, 4)
            while True:
                left = here[state] + gain
                if 3 + then[state] == left:
                    out.append("D")
                    break
                if 2 + here[NEXT[state]] + gain == left:
                    out.append("I")
                    state = NEXT[state]
                    continue
                kept = KEEPS[state].get(initial) if symbol != DELETED else None
                if kept is not None and late + then[kept] == left:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = NEXT[state]
                break
        if start == 0:
            for symbol in symbols[:front][::-1]:
                cost += t.cost[vector][symbol]
                vector = t.one[vector][symbol]
            cost += t.vectors[vector][0]
        start = stop
    while state not in (0, 3):
        out.append("I")
        state = NEXT[state]
    return "".join(out), cost


def edited(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The repaired lines of ``role:text`` from a script that starts in ``state``."""
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield ROLES[state] + ":"
            continue
        role, text = next(rows)
        if edit == "K":
            state = KEEPS[state]["sua".index(role[0])]
            yield f"{role}:{text}"
        elif edit == "R":
            state = NEXT[state]
            yield f"{ROLES[state]}:{text}"


def states(audit: str, state: int, initials: Iterator[int]) -> int:
    """The state that a script ends in; ``initials`` has the place in "sua" of each row's role."""
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            continue
        initial = next(initials)
        if edit != "D":
            state = KEEPS[state][initial] if edit == "K" else NEXT[state]
    return state


def symbol_of(last: str, again: bool, role: str) -> int:
    if not last or again:
        return DELETED
    return 1 + 4 * (last not in ".!?") + ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3)


def faults(rows: list[tuple[str, str, bool]]) -> tuple[bytes, int, int, int, int]:
    """Symbols and numbers of blank, duplicate, truncated and of illegal neighbours, of rows (role, last, again)."""
    symbols = bytes(symbol_of(last, again, role) for role, last, again in rows)
    blank = sum(not last for _, last, _ in rows)
    duplicate = sum(bool(last) and again for _, last, again in rows)
    truncated = sum(s > 4 for s in symbols)
    illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return symbols, blank, duplicate, truncated, illegal


def _finished(turns: list, roles: list, texts: list, lasts: list) -> tuple:
    """gaps, faults, cost, audit and hash of one conversation's rows in order."""
    seen: set[tuple[str, str]] = set()
    rows = []
    for role, text, last in zip(roles, texts, lasts):
        rows.append((role, last, (role, text) in seen))
        seen.add((role, text))
    symbols, *counts = faults(rows)
    audit, cost = trace(symbols)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    digest = hashlib.sha256("\n".join(edited(audit, 0, zip(roles, texts))).encode())
    return gaps, *counts, cost, audit, digest.hexdigest()


def _inner(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations inside a part of the order, and the rows of all others with their place."""
    raw = ["part", "place", "turn", "role", "text", "last"]
    schema = f"conv {kind}, {RESULTS}, repaired_sha256 string, part bigint, place bigint, turn bigint, role string, " \
             "text string, last string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        conv, held, size, first, open_now = None, [], 0, True, False
        results: list[tuple] = []
        loose: list[tuple] = []
        type_of, names = None, []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*[(r[0], *r[1], *[None] * 6) for r in results], *[(c, *[None] * 8, *r) for c, r in loose]))
            if not columns:
                columns = [()] * 15
            types = [type_of, *[pa.int64()] * 6, pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.string()] * 3]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            results.clear()
            loose.clear()
            return out

        for batch in batches:
            type_of = batch.schema.field("conv").type
            names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", *raw]
            waiting = 0
            for row in zip(*[batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "last")]):
                if place == 0:
                    conv, open_now = row[0], True  # the part's first conversation may have begun before it
                elif row[0] != conv:
                    if not open_now:
                        results.append((conv, _finished(*zip(*[h[2:] for h in held]))))
                    conv, held, size, open_now = row[0], [], 0, False
                held.append((part, place, *row[1:]))
                size += len(row[3])
                place += 1
                if open_now or len(held) > PIECE or size > PIECE_CHARS:
                    open_now = True
                    loose.extend((conv, h) for h in held)
                    waiting += size
                    held, size = [], 0
                    if waiting > PIECE_CHARS:
                        yield sent()
                        waiting = 0
            yield sent()
        if names:
            loose.extend((conv, h) for h in held)  # the last may go on in the next part
            yield sent()

    return saved(rows.mapInArrow(task, schema), "conversations")


def _across(rows: DataFrame, kind: str) -> DataFrame:
    """Results of conversations whose rows are spread: the second way, by pieces."""
    piece = F.floor(F.col("place") / PIECE).cast("bigint")
    # The first row of each role and text; the others repeat it. Places are unique, so no key is hot.
    firsts = rows.groupBy("conv", "role", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(
        F.min(F.struct("part", "place")).alias("at")).select("at.part", "at.place", F.lit(False).alias("again"))
    marked = rows.select("conv", "part", "place", "role", "last").join(firsts, ["part", "place"], "left").select(
        "conv", "part", piece.alias("piece"), "place", "role", "last", F.coalesce("again", F.lit(True)).alias("again"))

    def symbols(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        held = list(zip(*[group.column(n).to_pylist() for n in ("role", "last", "again")]))
        found, blank, duplicate, truncated, illegal = faults(held)
        initials = bytes("sua".find(r[:1]) % 4 if r else 3 for r, _, _ in held)
        ends = held[0][0][:1], held[-1][0][:1]
        return pa.Table.from_arrays(
            [group.column("conv").slice(0, 1), group.column("part").slice(0, 1), group.column("piece").slice(0, 1),
             pa.array([found], pa.binary()), pa.array([initials], pa.binary()),
             *[pa.array([x], pa.int64()) for x in (blank, duplicate, truncated, illegal)],
             *[pa.array([x], pa.string()) for x in ends]],
            ["conv", "part", "piece", "symbols", "initials", "blank", "duplicate", "truncated", "illegal", "head", "tail"])

    pieces = marked.groupBy("conv", "part", "piece").applyInArrow(
        symbols, f"conv {kind}, part bigint, piece bigint, symbols binary, initials binary, blank bigint, duplicate bigint, "
                 "truncated bigint, illegal bigint, head string, tail string")

    def scripts(group: pa.Table) -> pa.Table:
        """Each piece's share of its conversation's script, with the state it starts in."""
        group = group.sort_by([("part", "ascending"), ("piece", "ascending")])
        parts = [s.as_py() for s in group.column("symbols")]
        audit, cost = trace(b"".join(parts))
        heads, tails = group.column("head").to_pylist(), group.column("tail").to_pylist()
        joints = [int(a + b not in LEGAL) for a, b in zip(tails, heads[1:])]
        shares, starts, at, state = [], [], 0, 0
        for number, initials in enumerate(group.column("initials").to_pylist()):
            begin, left = at, len(initials)
            while at < len(audit) and (left or number == len(parts) - 1):
                left -= audit[at] != "I"
                at += 1
            shares.append(audit[begin:at])
            starts.append(state)
            state = states(shares[-1], state, iter(initials))
        counts = [group.column("illegal").to_pylist(), joints + [0]]
        return pa.Table.from_arrays(
            [group.column("conv"), group.column("part"), group.column("piece"), pa.array(shares, pa.string()),
             pa.array(starts, pa.int32()), group.column("blank"), group.column("duplicate"), group.column("truncated"),
             pa.array([sum(c) for c in zip(*counts)], pa.int64()), pa.array([cost] * len(parts), pa.int64())],
            ["conv", "part", "piece", "share", "state", "blank", "duplicate", "truncated", "illegal", "cost"])

    shared = saved(pieces.groupBy("conv").applyInArrow(
        scripts, f"conv {kind}, part bigint, piece bigint, share string, state int, blank bigint, duplicate bigint, "
                 "truncated bigint, illegal bigint, cost bigint"), "edit-scripts")

    def rewritten(rows: pa.Table, script: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        lines = edited(script.column("share")[0].as_py(), script.column("state")[0].as_py(),
                       zip(rows.column("role").to_pylist(), rows.column("text").to_pylist()))
        return pa.Table.from_arrays(
            [script.column("conv"), script.column("part"), script.column("piece"),
             pa.array(["\n".join(lines).encode()], pa.binary())],
            ["conv", "part", "piece", "lines"])

    texts = rows.select("conv", "part", piece.alias("piece"), "place", "role", "text").groupBy("conv", "part", "piece").cogroup(
        shared.select("conv", "part", "piece", "share", "state").groupBy("conv", "part", "piece")).applyInArrow(
        rewritten, f"conv {kind}, part bigint, piece bigint, lines binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One hash per conversation, over the pieces as they come."""
        known, conv, digest, empty, type_of = False, None, None, True, None
        done: list[tuple] = []

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], type_of), pa.array([d for _, d in done], pa.string())],
                                             ["conv", "repaired_sha256"])
            done.clear()
            return out

        for batch in batches:
            type_of = batch.schema.field("conv").type
            for this, lines in zip(batch.column("conv").to_pylist(), batch.column("lines")):
                if not known or this != conv:
                    if known:
                        done.append((conv, digest.hexdigest()))
                    known, conv, digest, empty = True, this, hashlib.sha256(), True
                if lines.as_buffer().size:
                    if not empty:
                        digest.update(b"\n")
                    digest.update(lines.as_buffer())
                    empty = False
            yield sent()
        if known:
            done.append((conv, digest.hexdigest()))
            yield sent()

    hashes = texts.repartition("conv").sortWithinPartitions("conv", "part", "piece").mapInArrow(
        hashed, f"conv {kind}, repaired_sha256 string")
    totals = shared.groupBy("conv").agg(
        *[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")], F.first("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "share"))), lambda s: s["share"]), "")
        .alias("audit"))
    turns = rows.groupBy("conv", "turn").count().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"))

    def with_same(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed("conv", "_conv")
        return left.join(other, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")

    return with_same(with_same(totals, turns), hashes)


def repair(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    named = pick(rows, conv=conv_id, turn=turn, role=role, text=text)
    kind = named.schema["conv"].dataType.simpleString()

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    plain = named.select("conv", F.col("turn").cast("bigint").alias("turn"), filled("role"), filled("text"))
    plain = plain.withColumn("last", F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)))
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 256), F.xxhash64("text")]
    # Equal rows may lie in any order; their number in the input lets a range boundary fall between them.
    dealt = plain.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, F.col("_row"))
    found = _inner(dealt.sortWithinPartitions(*order).drop("_row"), kind)
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    inside = found.where("part is null").select(*columns)
    spread = found.where("part is not null").select("conv", "part", "place", "turn", "role", "text", "last")
    return inside.unionByName(_across(spread, kind).select(*columns)).withColumnRenamed("conv", "conv_id")
