"""Repair of conversation structure by Knuth's lightest-derivation agenda.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.  Rows are kept (cost 0), given
the role user or assistant (2) or deleted (3, required where blank or a duplicate), and empty turns are inserted
(2); an undeleted truncated row costs 1 more.  A derivation item is (rows read, state of the roles so far);
every edit is a weighted deduction from one item to another, and its function, which adds its cost and appends
its initial to the audit, is superior and monotone in (cost, audit).  The agenda pops the lightest item, which is
final then, until the goal is popped.  Of two audits of equal cost for one item neither is a prefix of the other
(both have a letter for each row read, and an insertion costs), so the least audit of a whole is made of
least audits of its parts.

Blocks of rows are derived on their own, from and to every state, and what they derive are the deductions of the
next layer, so a conversation with a third of all rows is dealt over many tasks.  Only the repaired rows, whose
digest runs through them in order, pass one task as a sorted stream that holds one row and the audit.

Defined results: null roles and texts are read as one space; rows are taken by turn, null first, ties by a digest
of role and text; null conversation ids are one conversation; a conversation without rows has no edits.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.common import slices
from earshot.llm.numbering import group_key, numbered
from earshot.sources.shared import cut, cut_measured

# States of the roles so far: none, s, ..u, ..ua.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: State after a row whose role begins with the initial.
AFTER = {
    "s": {NONE: SYSTEM},
    "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
    "x": {},
}
#: State after a turn that is made to fit, and its role.
FIT = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (NONE, ASSISTANT)
FOLLOWS = ("su", "ua", "au")

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

#: Classes of initials, and how a row of each is written in a block's code: sound, truncated, to be deleted.
CLASSES, CODES = "suax", ("suax", "SUAX", "0123")

Weight = tuple[int, str]
Deductions = list[list[tuple[int, int, int, str]]]


def row_deductions(code: str) -> list[tuple[int, int, int, str]]:
    """``(state, next state, cost, edit)`` of one row."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if code not in CODES[2]:
        more = TRUNCATED if code in CODES[1] else 0
        out += [(q, to, more, "K") for q, to in AFTER[code.lower()].items()]
        out += [(q, to, REROLE + more, "R") for q, to in FIT.items()]
    return out


def lightest(steps: Deductions, start: int, *, inserts: bool, goal: bool) -> dict[int, Weight]:
    """The lightest (cost, audit) of each state after all steps, or of the goal alone.

    ``steps`` are the deductions of each row or block in order; ``inserts`` adds those of empty turns.
    """
    n = len(steps)
    by_state = [[[e for e in step if e[0] == q] for q in range(4)] for step in steps]
    final: dict[tuple[int, int], Weight] = {}
    best: dict[tuple[int, int], Weight] = {(0, start): (0, "")}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = (cost, audit)
        if goal and i == n and q in ENDS:
            return {q: (cost, audit)}
        found = [(i + 1, to, cost + w, audit + e) for _, to, w, e in by_state[i][q]] if i < n else []
        if inserts:
            found.append((i, FIT[q], cost + INSERT, audit + "I"))
        for j, to, c, a in found:
            if (j, to) not in final and ((j, to) not in best or (c, a) < best[j, to]):
                best[j, to] = (c, a)
                heapq.heappush(agenda, (c, a, j, to))
    return {q: w for (i, q), w in final.items() if i == n}


def _broken(codes: str) -> tuple[str, int]:
    """Classes of a code's rows, and how many neighbours do not follow each other."""
    classes = "".join(CLASSES["0123".find(c)] if c in CODES[2] else c.lower() for c in codes)
    return classes, sum(classes[i : i + 2] not in FOLLOWS for i in range(len(classes) - 1))


_ITEMS = "array<struct<start:int,stop:int,cost:bigint,audit:string>>"
_ITEM_TYPE = pa.list_(
    pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)
_BLOCKS = f"key string, block bigint, first string, last string, illegal bigint, items {_ITEMS}"


def _derived(steps: Deductions, first: bool, inserts: bool) -> list[dict]:
    return [
        {"start": p, "stop": q, "cost": c, "audit": a}
        for p in ([NONE] if first else range(4))
        for q, (c, a) in sorted(lightest(steps, p, inserts=inserts, goal=False).items())
    ]


def _blocks(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    first, last, illegal, items = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(first, pa.string()), pa.array(last, pa.string()),
         pa.array(illegal, pa.int64()), pa.array(items, _ITEM_TYPE)],
        ["key", "block", "first", "last", "illegal", "items"],
    )


def _derive_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, bool], tuple] = {}
    for batch in batches:
        out = []
        for block, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if (codes, block == 0) not in known:
                if len(known) > 20_000:
                    known.clear()
                classes, illegal = _broken(codes)
                items = _derived([row_deductions(c) for c in codes], block == 0, True)
                known[codes, block == 0] = (classes[0], classes[-1], illegal, items)
            out.append(known[codes, block == 0])
        yield _blocks(batch, out)


def _derive_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            one = batch.slice(r, 1)
            parts = one.column(2)[0].as_py()
            steps = [[(x["start"], x["stop"], x["cost"], x["audit"]) for x in p["items"]] for p in parts]
            seams = sum(a["last"] + b["first"] not in FOLLOWS for a, b in zip(parts, parts[1:]))
            illegal = seams + sum(p["illegal"] for p in parts)
            items = _derived(steps, one.column(1)[0].as_py() == 0, False)
            yield _blocks(one, [(parts[0]["first"], parts[-1]["last"], illegal, items)])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The goal of each conversation, from the items of its only block."""
    for batch in batches:
        goals = []
        for items in batch.column(2).to_pylist():
            steps = [[(x["start"], x["stop"], x["cost"], x["audit"]) for x in items]]
            (goal,) = lightest(steps, NONE, inserts=False, goal=True).values()
            goals.append(goal)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([c for c, _ in goals], pa.int64()), pa.array([a for _, a in goals], pa.string())],
            ["key", "illegal", "cost", "audit"],
        )


def _has_word(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def _code(role: Column, fault: Column) -> Column:
    at = F.greatest(F.instr(F.lit(CLASSES[:3]), F.substring(role, 1, 1)), F.lit(0))
    at = F.when((F.length(role) > 0) & (at > 0), at).otherwise(4)
    kind = lambda codes: F.substring(F.lit(codes), at, F.lit(1))
    return F.when(fault.isin("blank", "duplicate"), kind(CODES[2])).when(fault == "truncated", kind(CODES[1])).otherwise(kind(CODES[0]))


def find_faults(rows: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(key, pos, turn, role, text, fault)``: rows in their places, each with its first fault or null.  Written."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    read = rows.select(
        group_key(F.col(conv_col)).alias("key"),
        F.col(turn_col).cast("bigint").alias("turn"),
        blank(role_col).alias("role"),
        blank(text_col).alias("text"),
    )
    mark = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    placed = cut(numbered(read.withColumn("mark", mark), "key", [F.col("turn").asc_nulls_first(), F.col("mark")]), "turns")
    # Equal rows of a conversation: the first is known by its place, so no join has a hot key.
    firsts = placed.groupBy("key", "mark").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    seen = placed.join(firsts, ["key", "pos"], "left")
    fault = (
        F.when(~_has_word(F.col("text")), "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return seen.select("key", "pos", "turn", "role", "text", fault.alias("fault"))


def derive_repairs(faults: DataFrame, *, block_rows: int = 128, fan: int = 32) -> DataFrame:
    """``(key, illegal, cost, audit)`` of each conversation, from rows with ``(key, pos, role, fault)``."""
    block = F.floor(F.col("pos") / block_rows).cast("bigint")
    coded = faults.select("key", block.alias("block"), "pos", _code(F.col("role"), F.coalesce("fault", F.lit(""))).alias("code"))
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "")
    layer = coded.groupBy("key", "block").agg(codes.alias("codes")).mapInArrow(_derive_rows, _BLOCKS)
    while True:
        layer, seen = cut_measured(layer, "derived", most=F.max("block"))
        if not seen["most"]:
            break
        parts = F.sort_array(F.collect_list(F.struct("block", "first", "last", "illegal", "items")))
        above = F.floor(F.col("block") / fan).cast("bigint")
        layer = layer.groupBy("key", above.alias("above")).agg(parts.alias("parts")).mapInArrow(_derive_blocks, _BLOCKS)
    return layer.select("key", "illegal", "items").mapInArrow(_finish, "key string, illegal bigint, cost bigint, audit string")


class Repair:
    """Applies a conversation's audit to its rows, taken one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NONE

    def _fit(self) -> str:
        self.state = FIT[self.state]
        return ROLE[self.state]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._fit(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[role[0]][self.state]
            yield "K", role, text
        elif edit == "R":
            yield "R", self._fit(), text


def _stream(faults: DataFrame, repairs: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, all in one task's sorted stream."""
    audits = repairs.select("key", F.lit(-1).cast("bigint").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = audits.unionAll(faults.select("key", "pos", "role", "text"))
    return both.repartition("key").sortWithinPartitions("key", "pos")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None, str, str]]:
    """``(key, edit, role, text)`` of the repaired rows; a null edit ends a conversation."""
    key, repair = None, None
    for part in (part for batch in batches for part in slices(batch)):
        for own, pos, role, text in zip(*(c.to_pylist() for c in part.columns)):
            if pos < 0:
                if repair:
                    yield from ((key, *x) for x in repair.inserted())
                    yield key, None, "", ""
                key, repair = own, Repair(text)
            else:
                yield from ((key, *x) for x in repair.row(role, text))
    if repair:
        yield from ((key, *x) for x in repair.inserted())
        yield key, None, "", ""


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= 4 << 20 or len(held) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def repaired_rows(faults: DataFrame, repairs: DataFrame) -> DataFrame:
    """``(key, place, edit, role, text)``: the repaired conversations, row by row; ``edit`` is K, R or I."""
    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for key, edit, role, text in _walk(batches):
            if edit is None:
                place = 0
                continue
            yield key, place, edit, role, text
            place += 1

    return _stream(faults, repairs).mapInArrow(
        lambda batches: _batched(rows(batches), schema, lambda r: len(r[4])), "key string, place bigint, edit string, role string, text string"
    )


def repaired_digests(faults: DataFrame, repairs: DataFrame) -> DataFrame:
    """``(key, repaired_sha256)``: the digest of the repaired ``role:text``, joined by line feeds."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        made, begun = hashlib.sha256(), False
        for key, edit, role, text in _walk(batches):
            if edit is None:
                yield key, made.hexdigest()
                made, begun = hashlib.sha256(), False
                continue
            made.update((("\n" if begun else "") + role + ":").encode("utf-8", "surrogatepass"))
            made.update(text.encode("utf-8", "surrogatepass"))
            begun = True

    return _stream(faults, repairs).mapInArrow(lambda batches: _batched(rows(batches), schema, lambda r: 80), "key string, repaired_sha256 string")


def repair_conversations(
    rows: DataFrame,
    *,
    ids: DataFrame | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block_rows: int = 128,
    fan: int = 32,
) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired rows of every conversation.

    ``ids`` names the conversations to be reported (a table with ``conv_col``), also those without rows; by default
    all in ``rows``.
    """
    faults = cut(find_faults(rows, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col), "faults")
    repairs = cut(derive_repairs(faults, block_rows=block_rows, fan=fan), "repairs")
    kinds = ("blank", "duplicate", "truncated")
    by_turn = faults.groupBy("key", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    counts = by_turn.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *[F.sum(k).alias(k) for k in kinds]
    )
    own = (rows if ids is None else ids).select(F.col(conv_col).alias("conv")).distinct()
    found = own.withColumn("key", group_key(F.col("conv")))
    for part in (counts, repairs, repaired_digests(faults, repairs)):
        found = found.join(part, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *kinds, "illegal", "cost")]
    return found.select(
        F.col("conv").alias(conv_col),
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
