"""Conversation structure repair: cheapest edits by a suffix-shared automaton of row signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.llm.common import discard, null_safe_join, salted_lookup, staged

#: The six ASCII white-space characters, as they are trimmed and matched.
SPACES = " \t\n\x0b\f\r"
#: Rows of a conversation that make one signature; longer ones are several signatures.
BLOCK = 4096
#: Output rows a worker holds at a time.
HELD = 2000

# A mark is one letter per row: 4 * the role's class + the fault.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
LEGAL_PAIRS = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ROLES = {USER: "user", ASSISTANT: "assistant"}

# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: What a kept row leads to by (state, class); a rerole or an insertion by state alone.
KEPT = {
    (START, SYSTEM): AFTER_S,
    (START, USER): AFTER_U,
    (AFTER_S, USER): AFTER_U,
    (AFTER_U, ASSISTANT): AFTER_A,
    (AFTER_A, USER): AFTER_U,
}
MADE = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
NEW_ROLE = {AFTER_U: ROLES[USER], AFTER_A: ROLES[ASSISTANT]}
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
FAR = 1 << 40

EDITS = T.StructType().add("conv_id", "long").add("place", "long").add("edit", "string").add("role", "string").add("text", "string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with a fifth of them damaged by a hash of conv_id and turn.

    Nulls become one space where they are part of a string.  Of 20 remainders 0 drops the row, 1
    empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 makes its role user.
    """
    key = F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))
    spoil = F.crc32(key.cast("binary")) % 20
    text = _spaced("text")
    changed = F.when(spoil == 1, "").when(spoil == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(spoil == 4, ROLES[USER]).otherwise(_spaced("role"))
    times = F.when(spoil == 3, 2).otherwise(1)
    kept = rows.filter(spoil != 0)
    return kept.select("conv_id", "turn", role.alias("role"), changed.alias("text"), times.cast("long").alias("times"))


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _known(rows: DataFrame, times: str | None) -> DataFrame:
    """conv_id, turn, role, text, times and the text's MD5."""
    times = F.col(times) if times else F.lit(1)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _spaced("role").alias("role"),
        _spaced("text").alias("text"),
        times.cast("long").alias("times"),
        F.unhex(F.md5(_spaced("text"))).alias("digest"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their text, with role class and flags; ``later`` marks copies of an earlier turn.

    A role and text that occur once need no look at their group; of the others the first turn is
    found map-side and joined back.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    group = F.lit(OTHER)
    for at, letter in enumerate(INITIALS):
        group = F.when(initial == letter, at).otherwise(group)
    flags = [(bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("short"), group.cast("int").alias("class")]
    keyed = staged(rows.select("conv_id", "turn", "role", "digest", "times", *flags), "turns")
    same = ["conv_id", "role", "digest"]
    first = F.min(F.struct(F.isnotnull("turn").alias("known"), "turn")).alias("first")
    repeated = keyed.groupBy(*same).agg(F.sum("times").alias("n"), first).filter("n > 1").drop("n")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return null_safe_join(keyed, repeated, same, "left").withColumn("later", later).drop("first")


def _signatures(marked: DataFrame) -> DataFrame:
    """(conv_id, block, last, marks): the marks of each conversation's rows in order, in blocks.

    Rows stand by turn, nulls first, then role, then the text's MD5.  A worker holds one block.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv, at, marks, before = [], None, 0, [], None
        for batch in batches:
            columns = batch.to_pydict()
            kind = batch.schema.field("conv_id").type
            for c, turn, role, digest, times, blank, short, group, later in zip(*columns.values(), strict=True):
                if marks and c != conv:
                    out.append((conv, at, True, "".join(marks)))
                    marks, at, before = [], 0, None
                conv, own = c, (turn, role, digest)
                again = later or own == before
                before = own
                for _ in range(times):
                    fault = BLANK if blank else DUPLICATE if again else TRUNCATED if short else SOUND
                    again = True
                    if len(marks) == BLOCK:
                        out.append((conv, at, False, "".join(marks)))
                        marks, at = [], at + 1
                    marks.append(chr(65 + 4 * group + fault))
                if len(out) >= HELD:
                    yield _batch(out, kind)
                    out = []
        if marks:
            out.append((conv, at, True, "".join(marks)))
        if out:
            yield _batch(out, kind)

    def _batch(out, kind):
        columns = list(zip(*out, strict=True))
        types = (kind, pa.int32(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "block", "last", "marks"])

    columns = ("conv_id", "turn", "role", "digest", "times", "blank", "short", "class", "later")
    ordered = marked.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.mapInArrow(blocks, "conv_id long, block int, last boolean, marks string")


class Node(NamedTuple):
    """A suffix: cost to go from each grammar state, and the first edits and next state of the best.

    ``costs`` are relative to ``base``.  ``edits`` lead up to and through the suffix's first row.
    """

    costs: tuple[int, ...]
    base: int
    edits: tuple[str, ...]
    states: tuple[int, ...]


def _with_inserts(best: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Options by state, each also by way of an inserted row; ties go to the least edits."""

    def via(option: tuple[int, str, int]) -> tuple[int, str, int]:
        return (min(option[0] + INSERT, FAR), "I" + option[1], option[2])

    u, a = best[AFTER_U], best[AFTER_A]
    u, a = min(u, via(a)), min(a, via(u))
    return [min(best[START], via(u)), min(best[AFTER_S], via(u)), u, a]


def end_node(end: str) -> Node:
    """The empty suffix: '' ends the conversation, 'e2' asks for state 2, '0,2,1,0' are costs beyond."""
    if not end:
        options = _with_inserts([(0, "", START), (FAR, "", AFTER_S), (FAR, "", AFTER_U), (0, "", AFTER_A)])
        return Node(*[tuple(o[0] for o in options)], 0, tuple(o[1] for o in options), tuple(o[2] for o in options))
    costs = [0 if i == int(end[1]) else FAR for i in range(4)] if end[0] == "e" else [int(x) for x in end.split(",")]
    return Node(tuple(costs), 0, ("",) * 4, tuple(range(4)))


def longer(after: tuple[int, ...], mark: str) -> tuple[tuple[int, ...], int, tuple[str, ...], tuple[int, ...]]:
    """The node of a suffix that begins with ``mark``, from the costs of the suffix behind it."""
    group, fault = divmod(ord(mark) - 65, 4)
    options = []
    for state in range(4):
        ways = [(after[state] + DELETE, "D", state)]
        if fault not in (BLANK, DUPLICATE):
            short = CUT_SHORT if fault == TRUNCATED else 0
            if (state, group) in KEPT:
                to = KEPT[state, group]
                ways.append((after[to] + short, "K", to))
            ways.append((after[MADE[state]] + REROLE + short, "R", MADE[state]))
        options.append(min((min(cost, FAR), edit, to) for cost, edit, to in ways))
    options = _with_inserts(options)
    base = min(cost for cost, _, _ in options)
    costs = tuple(FAR if cost >= FAR // 2 else cost - base for cost, _, _ in options)
    return costs, base, tuple(o[1] for o in options), tuple(o[2] for o in options)


class Automaton:
    """The suffixes of signatures that come sorted from their ends: each is one node, made once.

    Only the nodes of the current signature are held; the next one shares those of the common
    suffix.  Costs are kept relative to their least, so that few different steps exist.
    """

    def __init__(self):
        self.end, self.flipped, self.nodes, self.steps = None, "", [], {}

    def enter(self, end: str, marks: str) -> list[Node]:
        """The nodes from the empty suffix to the whole signature."""
        flipped = marks[::-1]
        if end != self.end:
            self.end, self.flipped, self.nodes = end, "", [end_node(end)]
        shared = 0
        for old, new in zip(self.flipped, flipped, strict=False):
            if old != new:
                break
            shared += 1
        del self.nodes[shared + 1 :]
        for mark in flipped[shared:]:
            top = self.nodes[-1]
            step = self.steps.get((top.costs, mark))
            if step is None:
                step = self.steps[top.costs, mark] = longer(top.costs, mark)
            self.nodes.append(Node(step[0], top.base + step[1], step[2], step[3]))
        self.flipped = flipped
        return self.nodes


def best_edits(nodes: list[Node], state: int) -> tuple[int, str, int]:
    """Cost, edits and last state of the cheapest repair from ``state``, ties ASCII-least."""
    cost, out = nodes[-1].costs[state] + nodes[-1].base, []
    for node in reversed(nodes):
        out.append(node.edits[state])
        state = node.states[state]
    beyond = 0 if any(nodes[0].edits) else nodes[0].costs[state]
    return cost - beyond, "".join(out), state


def fault_counts(marks: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated rows, and illegal neighbours."""
    codes = [divmod(ord(mark) - 65, 4) for mark in marks]
    faults = [fault for _, fault in codes]
    illegal = sum((a[0], b[0]) not in LEGAL_PAIRS for a, b in zip(codes, codes[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def _from_the_end(requests: DataFrame) -> DataFrame:
    """Distinct requests (end, marks, …) sorted by end and reversed marks, so that suffixes adjoin."""
    flipped = requests.distinct().withColumn("flipped", F.reverse("marks"))
    ordered = flipped.repartitionByRange("end", "flipped").sortWithinPartitions("end", "flipped")
    return ordered.drop("flipped")


def _costs(requests: DataFrame) -> DataFrame:
    """(marks, end, costs) of requests (marks, end): the cost to go from each state."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            top = [automaton.enter(e, m)[-1] for m, e in zip(*batch.to_pydict().values(), strict=True)]
            costs = pa.array([[min(c + node.base, FAR) for c in node.costs] for node in top], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, costs], ["marks", "end", "costs"])

    return _from_the_end(requests.select("marks", "end")).mapInArrow(solve, "marks string, end string, costs array<long>")


def _ends(blocks: DataFrame) -> DataFrame:
    """Blocks with ``end``, what the rows behind a block cost from each state; '' for the last.

    A conversation of one block needs no more.  Of longer ones every distinct block gives a 4 by 4
    table of costs, and these are folded from the last block to the first.
    """
    one = (F.col("block") == 0) & F.col("last")
    several = blocks.filter(~one)
    inner = several.filter(~F.col("last")).select("marks", F.explode(F.array(*[F.lit(f"e{i}") for i in range(4)])).alias("end"))
    asked = inner.union(several.filter("last").select("marks", F.lit("").alias("end")))
    tables = _costs(asked).groupBy("marks").agg(F.map_from_entries(F.collect_list(F.struct("end", "costs"))).alias("table"))

    names = blocks.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = None
        for batch in batches:
            ends = []
            for last, table in zip(batch.column("last").to_pylist(), batch.column("table").to_pylist(), strict=True):
                table = dict(table)
                if last:
                    ends.append("")
                    costs = table[""]
                else:
                    ends.append(",".join(map(str, costs)))
                    costs = [min(min(table[f"e{j}"][i] + costs[j] for j in range(4)), FAR) for i in range(4)]
                least = min(costs)
                costs = [FAR if c >= FAR // 2 else c - least for c in costs]
            kept = [batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ends, pa.string())], [*names, "end"])

    backwards = salted_lookup(several, staged(tables, "tables"), ["marks"], ["conv_id", "block"])
    backwards = backwards.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    folded = backwards.mapInArrow(fold, T.StructType([*blocks.schema.fields, T.StructField("end", T.StringType())]))
    return blocks.filter(one).withColumn("end", F.lit("")).unionByName(folded)


def _solved(requests: DataFrame) -> DataFrame:
    """Requests (marks, end, head) with the best edits from each state, their costs, last states and
    the counts of faults; the first block of a conversation is entered by the first state only.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(list(requests.schema.fields)).add("edits", T.ArrayType(T.StringType())).add("costs", longs)
    schema = schema.add("states", T.ArrayType(T.IntegerType())).add("counts", longs)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            rows = list(zip(*batch.to_pydict().values(), strict=True))
            for at in range(0, len(rows), HELD):
                part = rows[at : at + HELD]
                found = []
                for marks, end, head in part:
                    nodes = automaton.enter(end, marks)
                    found.append([best_edits(nodes, state) for state in range(1 if head else 4)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[column.slice(at, HELD) for column in batch.columns],
                        pa.array([[e for _, e, _ in f] for f in found], pa.list_(pa.string())),
                        pa.array([[c for c, _, _ in f] for f in found], pa.list_(pa.int64())),
                        pa.array([[s for _, _, s in f] for f in found], pa.list_(pa.int32())),
                        pa.array([fault_counts(marks) for marks, _, _ in part], pa.list_(pa.int64())),
                    ],
                    schema.names,
                )

    return _from_the_end(requests).mapInArrow(solve, schema)


def _with_plans(rows: DataFrame, ids: DataFrame, times: str | None) -> DataFrame:
    """For each conversation, in order: a row for its id, its solved blocks, its own rows."""
    known = _known(rows, times)
    blocks = staged(_signatures(_marked(known)), "signatures")
    ended = staged(_ends(blocks).withColumn("head", F.col("block") == 0), "ends")
    solved = staged(_solved(ended.select("marks", "end", "head")), "edits")
    plans = salted_lookup(ended, solved, ["marks", "end", "head"], ["conv_id", "block"])
    discard(blocks)
    ends = [F.expr(f"(ascii(substring(marks, {at}, 1)) - 65) div 4").cast("int") for at in (1, -1)]
    nothing = {"block": "int", "turn": "long", "role": "string", "digest": "binary", "text": "string", "times": "long",
               "edits": "array<string>", "costs": "array<long>", "states": "array<int>", "counts": "array<long>", "borders": "array<int>"}
    parts = [
        ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("kind", F.lit(0)),
        plans.withColumn("borders", F.array(*ends)).drop("last", "marks", "end", "head").withColumn("kind", F.lit(1)),
        known.withColumn("kind", F.lit(2)),
    ]
    full = [
        part.select("conv_id", "kind", *[F.col(n) if n in part.columns else F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
        for part in parts
    ]
    together = full[0].union(full[1]).union(full[2])
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block", "turn", "role", "digest")


class _Conversation:
    """One conversation as its rows stream by: counts, edits, turns seen and the digest."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.audit, self.cost, self.counts = conv_id, START, [], 0, [0, 0, 0, 0]
        self.border = self.low = self.turn = None
        self.turns, self.sha, self.lines, self.plan, self.at = 0, hashlib.sha256(), 0, None, 0

    def add_block(self, edits, costs, states, counts, borders) -> None:
        state, self.state = self.state, states[self.state]
        self.audit.append(edits[state])
        self.cost += costs[state]
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if self.border is not None:
            self.counts[3] += (self.border, borders[0]) not in LEGAL_PAIRS
        self.border = borders[1]

    def begin_rows(self) -> None:
        self.plan, self.at, self.state = "".join(self.audit), 0, START

    def _made(self, edit: str) -> tuple[str, str, str]:
        self.state = MADE[self.state]
        return edit, NEW_ROLE[self.state], ""

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.plan) and self.plan[self.at] == "I":
            self.at += 1
            yield self._made("I")

    def add_row(self, turn, role, text, times) -> Iterator[tuple[str, str, str]]:
        """The edits of one row: (edit, role, text), a deleted row with its own role and text."""
        if self.plan is None:
            self.begin_rows()
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.turn = turn
        for _ in range(times):
            yield from self.inserts()
            edit = self.plan[self.at]
            self.at += 1
            if edit == "R":
                yield edit, self._made(edit)[1], text
            else:
                if edit == "K":
                    self.state = KEPT[self.state, _class(role)]
                yield edit, role, text

    def take(self, edit: str, role: str, text: str) -> None:
        if edit != "D":
            self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts, self.cost, self.plan or "".join(self.audit), self.sha.hexdigest())


def _class(role: str) -> int:
    return INITIALS.find(role[0]) if role and role[0] in INITIALS else OTHER


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Conversation, tuple[str, str, str] | None]]:
    """Every conversation with each of its edits, and with None once it is over."""
    now = None
    for batch in batches:
        for conv, kind, _, turn, role, _, text, times, edits, costs, states, counts, borders in zip(*batch.to_pydict().values(), strict=True):
            if now is None or now.conv_id != conv:
                if now is not None:
                    yield from ((now, edit) for edit in _over(now))
                now = _Conversation(conv)
            if kind == 1:
                now.add_block(edits, costs, states, counts, borders)
            elif kind == 2:
                yield from ((now, edit) for edit in now.add_row(turn, role, text, times))
    if now is not None:
        yield from ((now, edit) for edit in _over(now))


def _over(now: _Conversation) -> Iterator[tuple[str, str, str] | None]:
    if now.plan is not None:
        yield from now.inserts()
    yield None


def repair(rows: DataFrame, ids: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """One row per conversation of ``ids`` (or of ``rows``): its faults, cheapest edits and digest.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Rows stand by
    turn (nulls first), ties by role and by the text's MD5.  A row's first fault counts: blank, a
    copy of an earlier role and text, or no ``.!?`` at its end.  Edits and their costs: K keeps a
    row, R gives it the role user or assistant (2), D deletes it (3; a must for blank rows and
    copies), I inserts an empty row of either role (2); a truncated row that stays costs 1.  The
    roles' initials then match ``(s?(ua)+)?``; of equally cheap repairs the ASCII-least string of
    edits is taken.  Null roles and texts are one space; a null conv_id is a conversation of its own;
    a conversation without rows has zeros, no edits and the digest of nothing.  Other columns are
    not read; the column named by ``times`` says how often a row stands there.

    Rows become marks of role and fault, blocks of marks signatures; equal signatures are solved
    once for all conversations, and so is every suffix that signatures share.  The digest is one
    SHA-256 over a conversation and its edits are one string, so each conversation streams through
    one task, which holds its edits and no texts.
    """
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    names = [part.split()[0] for part in schema.split(", ")]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conversation, edit in _conversations(batches):
            if edit is not None:
                conversation.take(*edit)
                continue
            out.append(conversation.result())
            size += 200 + len(out[-1][7])
            if size >= 1 << 20:
                yield _rows_batch(out, names, [pa.int64()] * 7 + [pa.string()] * 2)
                out, size = [], 0
        if out:
            yield _rows_batch(out, names, [pa.int64()] * 7 + [pa.string()] * 2)

    return _with_plans(rows, rows if ids is None else ids, times).mapInArrow(digests, schema)


def repaired_rows(rows: DataFrame, times: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text.

    The rules are those of :func:`repair`.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, types = [], 0, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for conversation, edit in _conversations(batches):
            if edit is None or edit[0] == "D":
                continue
            out.append((conversation.conv_id, conversation.lines, *edit))
            conversation.lines += 1
            size += 50 + len(edit[2])
            if size >= 1 << 20:
                yield _rows_batch(out, EDITS.names, types)
                out, size = [], 0
        if out:
            yield _rows_batch(out, EDITS.names, types)

    return _with_plans(rows, rows, times).mapInArrow(written, EDITS)


def _rows_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
