"""Cheapest repairs of the role structure of conversations.

A conversation must read ``(s?(ua)+)?`` in the initials of its roles. What may
be done to a turn depends on its initial and fault alone, so a conversation is
a string of nine symbols. Strings are cut into blocks; equal blocks of all
conversations are one row; Re-Pair turns pairs of symbols that occur twice or
more into rules. Each rule has one min-plus transfer matrix between the four
states of the grammar (nothing yet, after s, after u, after a), whose entries
are the least cost and the audit, as a rope of the two sides' audits; it is
evaluated bottom-up from the two it joins, and shared by all blocks with it.
From a state an audit fixes the next state, and of equal cost none is a
beginning of another, so the least of joined audits is joined of least ones.

Edits: K keeps a turn, R gives it the role user or assistant (1), D deletes it
(2), I inserts an empty turn (5). A truncated turn that stays costs 5 more; a
blank or repeated one must go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.durable import Scratch, cut
from graphloom.llm.crowds import MOST, crowded, meet

#: s, u, a or another initial; the same of a truncated turn; one that must go.
SYMBOLS = "suaoSUAOx"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Ids of a block's turns, a power of two; rules that a round adds; rules in all. What stays unpaired is multiplied symbol by symbol.
BLOCK, PER_ROUND, RULES = 512, 256, 1024
_SPACE = " \t\n\x0b\x0c\r"


class Rope:
    """An audit as two audits in a row; its letters are written out once, when they are asked for."""

    __slots__ = ("left", "right", "written")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, written: str | None = None):
        self.left, self.right, self.written = left, right, written

    def text(self) -> str:
        if self.written is None:
            letters, todo = [], [self]
            while todo:
                one = todo.pop()
                if one.written is not None:
                    letters.append(one.written)
                else:
                    todo += [one.right, one.left]
            self.written = "".join(letters)
        return self.written


#: Of each state, the least cost and audit to each state that can be reached.
Matrix = list[dict[int, tuple[int, Rope]]]


def _better(row: dict, to: int, cost: int, rope: Rope) -> None:
    have = row.get(to)
    if have is None or cost < have[0] or cost == have[0] and rope.text() < have[1].text():
        row[to] = (cost, rope)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [{} for _ in range(4)]
    for start in range(4):
        for mid, (c1, r1) in a[start].items():
            for to, (c2, r2) in b[mid].items():
                _better(out[start], to, c1 + c2, Rope(r1, r2))
    return out


def _step(state: int) -> int:
    """After the user's turn that may follow, or the assistant's after one."""
    return AFTER_A if state == AFTER_U else AFTER_U


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions (more than two in a row gain nothing), and then what may be done to the turn."""
    out: Matrix = [{} for _ in range(4)]
    for start in range(4):
        state = start
        for inserted in range(3):
            audit, cost = "I" * inserted, INSERT * inserted
            _better(out[start], state, cost + DELETE, Rope(written=audit + "D"))
            if symbol != "x":
                stays = cost + (TRUNCATED if symbol.isupper() else 0)
                own = symbol.lower()
                _better(out[start], _step(state), stays + REROLE, Rope(written=audit + "R"))
                if own == "s" and state == START:
                    _better(out[start], AFTER_S, stays, Rope(written=audit + "K"))
                elif own == "u" and state != AFTER_U or own == "a" and state == AFTER_U:
                    _better(out[start], _step(state), stays, Rope(written=audit + "K"))
            state = _step(state)
    return out


#: Cost and audit of what is missing at a conversation's end, from each state.
ENDING = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


# ---- Re-Pair ----------------------------------------------------------------


def _pairs_at(flat: np.ndarray, a: int, b: int) -> np.ndarray:
    """Where a and b stand side by side, from the left and without overlaps."""
    at = np.flatnonzero((flat[:-1] == a) & (flat[1:] == b))
    if a == b and len(at):
        begins = np.flatnonzero(np.append(True, np.diff(at) > 1))
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
    return at


def parse(lines: list[str], rules: list[tuple[int, int]]) -> np.ndarray:
    """All lines as symbols and rules, the rules applied in their order; -1 ends a line."""
    code = np.full(256, -1, np.int32)
    code[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
    flat = code[np.frombuffer("".join(f"{x}\n" for x in lines).encode(), np.uint8)]
    for i, (a, b) in enumerate(rules):
        at = _pairs_at(flat, a, b)
        if len(at):
            flat[at] = len(SYMBOLS) + i
            flat = np.delete(flat, at + 1)
    return flat


def _counts(rules: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = parse(batch.column("line").to_pylist(), rules).astype(np.int64)
            both = (flat[:-1] >= 0) & (flat[1:] >= 0)
            code, n = np.unique(flat[:-1][both] * (1 << 20) + flat[1:][both], return_counts=True)
            a, b = code >> 20, code & ((1 << 20) - 1)
            for i in np.flatnonzero(a == b):
                n[i] = len(_pairs_at(flat, a[i], a[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return run


def grammar(lines: DataFrame, most: int = RULES, per_round: int = PER_ROUND) -> list[tuple[int, int]]:
    """Pairs that become one symbol, in order, of ``lines (line)``: each round takes the most frequent pairs of what the rules so far leave, until none occurs twice.

    The driver gets at most ``per_round`` pairs a round and ``most`` in all.
    """
    rules: list[tuple[int, int]] = []
    while len(rules) < most:
        counts = lines.select("line").mapInArrow(_counts(rules), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        new = [(r["a"], r["b"]) for r in counts.orderBy(F.desc("n"), "a", "b").limit(min(per_round, most - len(rules))).collect()]
        if not new:
            break
        rules += new
    return rules


def rule_matrices(rules: list[tuple[int, int]]) -> list[Matrix]:
    """Of every symbol and rule, bottom-up."""
    out = [symbol_matrix(x) for x in SYMBOLS]
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


_ENTRY = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _evaluate(rules: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rule_matrices(rules)
        for batch in batches:
            flat, tables, begin = parse(batch.column("line").to_pylist(), rules), [], 0
            for end in np.flatnonzero(flat < 0):
                whole = known[flat[begin]]
                for x in flat[begin + 1 : end]:
                    whole = product(whole, known[x])
                tables.append([(start, stop, cost, rope.text()) for start in range(4) for stop, (cost, rope) in whole[start].items()])
                begin = end + 1
            yield pa.RecordBatch.from_arrays([batch.column("line"), pa.array(tables, _ENTRY)], ["line", "moves"])

    return run


# ---- conversations ----------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with planted faults, by crc32(``conv_id:turn``) % 20: 0 drops a turn, 1 empties it, 2 removes its ends of sentences, 3 repeats it, 4 gives it to the user.

    A null is one space in role, text and the hashed text; conv_id and turn stay null.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from its last to its first: of each, the best audit from each state, given what has to follow; and the cost from the start."""
    at: object = _backward
    for batch in batches:
        out = []
        for conv, first, symbols, moves in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first_id", "symbols", "moves")), strict=True):
            if conv != at:
                at, later = conv, ENDING
            best: list = [None] * 4
            for m in moves:
                found = (m["cost"] + later[m["stop"]][0], m["audit"] + later[m["stop"]][1])
                if best[m["start"]] is None or found < best[m["start"]]:
                    best[m["start"]] = found
            later = [(cost, "") for cost, _ in best]
            out.append((conv, first, symbols, best[START][0], [audit for _, audit in best]))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "id", "symbols", "cost", "audits"])


class _Reader:
    """One conversation, turn by turn."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.audits, self.cost = conv_id, START, [], 0
        self.sha, self.any = hashlib.sha256(), False
        self.first = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.symbols, self.audit, self.next, self.step = "", "", 0, 0
        self.turns: list[tuple] = []
        self.place = 0

    def block(self, symbols: str, cost: int, audits: list[str]) -> None:
        if not self.audits:
            self.cost = cost
        self.symbols, self.audit, self.next, self.step = symbols, audits[self.state], 0, 0
        self.audits.append(self.audit)

    def _put(self, role: str, text: str, edit: str, turn: int | None) -> None:
        self.state = AFTER_S if edit == "K" and role[0] == "s" else _step(self.state)
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True
        self.turns.append((self.conv_id, self.place, turn, role, text, edit))
        self.place += 1

    def _role(self) -> str:
        return "assistant" if self.state == AFTER_U else "user"

    def _inserted(self) -> None:
        while self.step < len(self.audit) and self.audit[self.step] == "I":
            self.step += 1
            self._put(self._role(), "", "I", None)

    def turn(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        symbol = self.symbols[self.next]
        self.next += 1
        self.blank += symbol == "b"
        self.duplicate += symbol == "d"
        self.truncated += symbol.isupper()
        initial = role[:1]
        self.illegal += self.initial is not None and (self.initial, initial) not in (("s", "u"), ("u", "a"), ("a", "u"))
        self.initial = initial
        self._inserted()
        edit = self.audit[self.step]
        self.step += 1
        if edit != "D":
            self._put(role if edit == "K" else self._role(), text, edit, turn)
        if self.next == len(self.symbols):
            self._inserted()

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audits), self.sha.hexdigest()


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, turn long, role string, text string, edit string"
_KIND = {"long": pa.int64(), "string": pa.string()}


def _forward(turns: bool):
    """Rows of a conversation in order, each block's audits before its turns: a summary of each conversation, or its repaired turns."""
    fields = [f.split() for f in (_TURNS if turns else _SUMMARY).split(", ")]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, _KIND[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        for batch in batches:
            for conv, kind, turn, role, text, symbols, cost, audits in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "symbols", "cost", "audits")), strict=True):
                if reader is None or conv != reader.conv_id:
                    if reader is not None and not turns:
                        out.append(reader.summary())
                    reader = _Reader(conv)
                if kind == 0:
                    reader.block(symbols, cost, audits)
                elif kind == 1:
                    reader.turn(turn, role, text)
                    if turns:
                        out += reader.turns
                    reader.turns.clear()
            yield table(out)
            out = []
        if reader is not None and not turns:
            yield table([reader.summary()])

    return run


def _ordered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Everything of a conversation in the order in which it is read."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(trimmed == "", "b").otherwise(F.when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), kind).otherwise(F.upper(kind)))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # by ranges, so that a conversation of very many turns is dealt to many tasks; equal rows follow each other
    line = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    line = cut(line.withColumn("id", F.monotonically_increasing_id()).withColumn("key", key).withColumn("kind", kind))
    firsts = cut(line.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    crowds = cut(firsts.where(F.col("n") > MOST).select("key", F.ceil(F.col("n") / MOST).alias("blocks")))
    marked = meet(line.select("conv_id", "id", "key", "kind"), firsts.drop("n"), "key", "id", crowds)
    symbol = F.when((F.col("kind") != "b") & (F.col("id") > F.col("first")), "d").otherwise(F.col("kind"))
    block = F.floor(F.col("id") / BLOCK)  # ids of a conversation in one partition follow each other, so a block is at most so many of its turns
    blocks = marked.groupBy("conv_id", block.alias("block")).agg(F.min("id").alias("first_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", symbol.alias("s")))), lambda x: x["s"]), "").alias("symbols"))
    blocks = cut(blocks.select("conv_id", "first_id", "symbols", F.translate("symbols", "bd", "xx").alias("line")))
    lines = cut(blocks.select("line").distinct())
    moves = lines.mapInArrow(_evaluate(grammar(lines)), "line string, moves array<struct<start: int, stop: int, cost: bigint, audit: string>>")
    solved = meet(blocks, cut(moves), "line", "first_id", crowded(blocks.select("line"), "line"))
    best = solved.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("first_id")).select("conv_id", "first_id", "symbols", "moves").mapInArrow(_backward, "conv_id long, id long, symbols string, cost long, audits array<string>")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    every = ids.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(-1).cast("long").alias("id"), F.lit(-1).alias("kind"), null("long", "turn"), null("string", "role"), null("string", "text"), null("string", "symbols"), null("long", "cost"), null("array<string>", "audits"))
    heads = best.select("conv_id", "id", F.lit(0).alias("kind"), null("long", "turn"), null("string", "role"), null("string", "text"), "symbols", "cost", "audits")
    turns = line.select("conv_id", "id", F.lit(1).alias("kind"), "turn", "role", "text", null("string", "symbols"), null("long", "cost"), null("array<string>", "audits"))
    return every.union(heads).union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "id", "kind")


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation of ``rows (conv_id, turn, role, text)`` and of each of ``ids (conv_id)``.

    Turns go by (turn, role, text), null turns first. A null role or text is
    one space; rows with a null conv_id are one conversation. A repeated row
    is a duplicate, a text without other than white space blank, whatever its
    length; a conversation without rows has zeros, no edits and the digest of
    nothing; no rows and no ids give no rows. Other columns are ignored.
    A conversation's turns are dealt to tasks by ranges and solved in blocks; at
    last one task reads them in order, as the digest goes from turn to turn, and
    keeps nothing of them but the audit.
    """
    with Scratch() as s:
        return s.keep(cut(_ordered(rows, rows if ids is None else ids).mapInArrow(_forward(False), _SUMMARY)))


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv_id, place, turn, role, text, edit)``: the turns of the repaired conversations; see ``audits``. Inserted turns have no turn number."""
    with Scratch() as s:
        return s.keep(cut(_ordered(rows, rows).mapInArrow(_forward(True), _TURNS)))
