"""Repair of conversation structure by a dynamic programme whose layers conversations with a common beginning share.

A row's symbol says what its role begins with and whether it may stay: a conversation's symbols, in order, are its signature. A
task inserts its signatures, sorted, into a prefix trie. A node's layer has, for each state of the output (nothing yet, a
system row, a user row, an assistant row last), the least cost of the edits so far, the order of the least audits among
the states, and the step back; it is computed when the node is made, once for all that share the prefix. Every audit in a
layer ends at the same row, so none begins another, and which of two is less never depends on what follows. Answers
are read at terminal nodes by walking back.

Rows are shuffled once, by conversation, and sorted there by Spark, which spills; a task holds a block of BLOCK bytes. A
conversation above LONG rows or LONG_BYTES isn't held: its layers are computed first, of which two bytes a row stay, then its rows are
read again, each written as it comes. Its rows stay in one task, since their hash is one sequence, but never in memory.

Contract. Rows are ordered by turn, nulls first, then by role and text. Null roles and texts count as one space, a null conv_id
is a conversation. A role that is no longer than zero characters begins with nothing, which no order allows. Equal rows are duplicates.
Every conv_id comes out, also without rows. Gaps beyond 64 bits are held at the largest number. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import discard, stage

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: States of the output, the letters that lead from each to which, and the edits that end it.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
END = ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}
#: A block's bytes of text and rows; a conversation's bytes or rows above which it isn't held; a trie's nodes.
BLOCK, LONG_BYTES, LONG, NODES = 8 << 20, 32 << 20, 50_000, 1 << 20
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults by crc32(conv_id:turn) % 20: 0 drops, 1 empties, 2 takes out ends of sentences, 3 repeats, 4 sets role user. absent marks dropped ones."""
    space = F.lit(" ")
    at = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    k = F.crc32(at.cast("binary")) % 20
    own = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), k.alias("_k"))
    text = F.when(F.col("_k").isin(0, 1), "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = own.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_k") == 0).alias("absent"), "_k")
    return made.withColumn("_twice", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_twice")


@lru_cache(maxsize=None)  # layers are relative, so there are few
def step(layer: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """(the next layer, what its costs are counted from, the step back of each state) after a row.

    layer: for each state (cost, rank of its audit), or None. symbol: "d" for a row that must go, else what its role begins
    with (s, u, a or another letter), in upper case if it is truncated. A step back is (state before, edits).
    """
    best: list[tuple | None] = [None] * 4
    letter = symbol.lower()
    for state, held in enumerate(layer):
        if held is None:
            continue
        now, inserts = state, ""
        for _ in range(3):
            cost = held[0] + INSERT * len(inserts)
            found = [(DELETE, "D", now)]
            if letter != "d":
                extra = TRUNCATED if symbol.isupper() else 0
                if letter in AFTER[now]:
                    found.append((extra, "K", AFTER[now][letter]))
                found += [(REROLE + extra, "R", after) for to, after in AFTER[now].items() if to != "s"]
            for more, edit, after in found:
                option = (cost + more, held[1], inserts + edit, state)
                if best[after] is None or option < best[after]:
                    best[after] = option
            now, inserts = AFTER[now].get("u", ASSISTANT), inserts + "I"
    least = min(b[0] for b in best if b)
    ranks = {s: r for r, (_, s) in enumerate(sorted((best[s][1:3], s) for s in range(4) if best[s]))}
    return tuple((b[0] - least, ranks[s]) if b else None for s, b in enumerate(best)), least, tuple((b[3], b[2]) if b else None for b in best)


ROOT = ((0, 0), None, None, None)


def least(layer: tuple) -> tuple[int, int]:
    """What ending here adds to the costs' base, and the state that it ends from."""
    cost, _, state = min((h[0] + INSERT * len(END[s]), h[1], s) for s, h in enumerate(layer) if h)
    return cost, state


class Trie:
    """Signatures by common prefix; every node has its layer, which is computed once."""

    def __init__(self):
        self.child: dict[tuple[int, str], int] = {}
        self.layer, self.cost, self.back, self.parent = [ROOT], [0], [()], [0]
        self.answers: dict[int, tuple[int, str]] = {}

    def insert(self, signature: str) -> int:
        """The signature's terminal node."""
        node = 0
        for symbol in signature:
            after = self.child.get((node, symbol))
            if after is None:
                after = self.child[node, symbol] = len(self.layer)
                layer, cost, back = step(self.layer[node], symbol)
                self.layer.append(layer)
                self.cost.append(self.cost[node] + cost)
                self.back.append(back)
                self.parent.append(node)
            node = after
        return node

    def answer(self, node: int) -> tuple[int, str]:
        """The least cost, and the least audit of that cost, of the signature that ends here."""
        if node not in self.answers:
            cost, state = least(self.layer[node])
            edits, at = [END[state]], node
            while at:
                state, own = self.back[at][state]
                edits.append(own)
                at = self.parent[at]
            self.answers[node] = self.cost[node] + cost, "".join(reversed(edits))
        return self.answers[node]


class Path:
    """The layers of one long signature: the last is held, and of the others two bytes each to walk back."""

    STEPS: dict[tuple, int] = {}

    def __init__(self):
        self.layer, self.cost, self.backs = ROOT, 0, array("H")

    def append(self, symbol: str) -> None:
        self.layer, more, back = step(self.layer, symbol)
        self.cost += more
        self.backs.append(self.STEPS.setdefault(back, len(self.STEPS)))

    def answer(self) -> tuple[int, str]:
        cost, state = least(self.layer)
        steps, audit = list(self.STEPS), bytearray(END[state], "ascii")
        for i in range(len(self.backs) - 1, -1, -1):
            state, own = steps[self.backs[i]][state]
            audit += own[::-1].encode()
        return self.cost + cost, audit[::-1].decode()


class Conversation:
    """What is known of one conversation while its rows pass."""

    def __init__(self, conv_id, held: bool = True):
        self.conv_id = conv_id
        self.symbols: list[str] | Path = [] if held else Path()
        self.rows: list[tuple[str, str]] = []
        self.size = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        self.size += len(role) + len(text) + 200
        if turn is not None and (self.last is None or turn != self.last):
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        letter = role[:1]
        if self.before is not None and self.before + letter not in LEGAL:
            self.illegal += 1
        self.before = letter
        end = text.rstrip(BLANKS)[-1:]
        symbol = letter if letter in ("s", "u", "a") else "x"
        if not end:
            self.blank += 1
            symbol = "d"
        elif again:
            self.duplicate += 1
            symbol = "d"
        elif end not in ".!?":
            self.truncated += 1
            symbol = symbol.upper()
        self.symbols.append(symbol)

    def report(self, cost: int, audit: str) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def edited(rows: Iterator[tuple[str, str]], audit: Iterator[str], state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired rows (role, text)."""
    for edit in audit:
        own = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            own = ("assistant" if state == USER else "user", own[1])
        state = AFTER[state][own[0][0]]
        yield own


class Output:
    """Rows of the result, gathered into batches of bounded size."""

    NAMES = ("conv_id", "position", "role", "text", *(f.split()[0] for f in REPORT.split(", ")))

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, conv_id, position: int, role, text, report: tuple = (None,) * 7) -> None:
        self.rows.append((conv_id, position, role, text, *report))
        self.size += len(text or "") + 64 + len(report[6] or "")

    def full(self) -> bool:
        return self.size > BLOCK or len(self.rows) > 20_000

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.NAMES)
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, self.schema.types, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _schema(batch: pa.RecordBatch) -> pa.Schema:
    numbers = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("conv_id", batch.schema.field("conv_id").type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), *numbers, ("audit", pa.string())])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            yield from zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "absent", "again")), strict=True)


def _peeked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Schema | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    return (None, batches) if first is None else (_schema(first), chain([first], batches))


def _repaired(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Reports (position 0) with their repaired rows after them; without ``keep``, reports alone, and rows aren't held."""
    schema, batches = _peeked(batches)
    if schema is None:
        return
    trie, out, block, held = Trie(), Output(schema), [], 0

    def answered() -> Iterator[pa.RecordBatch]:
        nonlocal trie
        nodes = {s: trie.insert(s) for s in sorted({"".join(c.symbols) for c in block})} if keep else {}
        for c in block:
            cost, audit = trie.answer(nodes["".join(c.symbols)]) if keep else c.symbols.answer()
            out.add(c.conv_id, 0, None, None, c.report(cost, audit))
            if keep:
                for i, (role, text) in enumerate(edited(iter(c.rows), iter(audit)), 1):
                    out.add(c.conv_id, i, role, text)
            if out.full():
                yield out.batch()
        if len(trie.layer) > NODES:
            trie = Trie()

    now: Conversation | None = None
    for conv_id, turn, role, text, absent, again in _records(batches):
        if now is None or conv_id != now.conv_id:
            if now is not None and ((held := held + now.size) > BLOCK or not keep):
                yield from answered()
                block, held = [], 0
            now = Conversation(conv_id, keep)
            block.append(now)
        if not absent:
            now.add(turn, role, text, again)
            if keep:
                now.rows.append((role, text))
    yield from answered()
    yield out.batch()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows for conversations whose report comes first (as the columns of REPORT), however long they are."""
    out = None
    for batch in batches:
        out = out or Output(_schema(batch))
        for i in range(0, batch.num_rows, 1000):
            for row in batch.slice(i, 1000).to_pylist():
                if row["audit"] is not None:
                    letters, state, position = iter(row["audit"]), START, 0
                    out.add(row["conv_id"], 0, None, None, tuple(row[n] for n in Output.NAMES[4:]))
                    pending = next(letters, None)
                elif not row["absent"]:
                    edits = pending
                    while edits[-1] == "I":
                        edits += next(letters)
                    for role, text in edited(iter([(row["role"], row["text"])]), iter(edits), state):
                        position += 1
                        out.add(row["conv_id"], position, role, text)
                        state = AFTER[state][role[0]]
                    pending = next(letters, None)
                if pending and not row["more"]:  # inserts after the last row
                    for role, text in edited(iter(()), iter(pending + "".join(letters)), state):
                        position += 1
                        out.add(row["conv_id"], position, role, text)
                        state = AFTER[state][role[0]]
                    pending = None
                if out.full():
                    yield out.batch()
    if out:
        yield out.batch()


def _sorted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent, again: each conversation's rows together and in order."""
    dealt = rows.select("conv_id", "turn", "role", "text", "absent").repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "absent", "role", "text").orderBy("turn")) > 1
    return dealt.withColumn("again", seen).sortWithinPartitions("conv_id", "turn", "role", "text", "again")


def repaired(rows: DataFrame) -> DataFrame:
    """A report of each conversation (position 0) and its repaired rows (position from 1): conv_id, position, role, text and the report's columns.

    rows: conv_id, turn, role, text, absent (rows that are counted for their conv_id only). A partition holds whole conversations, each in
    order, its report first.
    """
    spark = rows.sparkSession
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, position long, role string, text string, {REPORT}"
    rows = rows.withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    many = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > LONG) | (F.col("b") > LONG_BYTES))
    long_ones = stage(many.select("conv_id"), "repair-long")
    if long_ones.isEmpty():
        discard(long_ones)
        return _sorted(rows).mapInArrow(lambda b: _repaired(b, True), schema)
    marked = long_ones.withColumnRenamed("conv_id", "_long")
    same = rows["conv_id"].eqNullSafe(marked["_long"])
    short = _sorted(rows.join(marked, same, "left_anti")).mapInArrow(lambda b: _repaired(b, True), schema)
    own = rows.join(marked, same, "left_semi")
    reports = stage(_sorted(own).mapInArrow(lambda b: _repaired(b, False), schema), "repair-reports")
    names = Output.NAMES[4:]
    heads = reports.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("absent"), F.lit(0).alias("_at"), *names)
    empty = [F.lit(None).cast(dict(f.split() for f in REPORT.split(", "))[n]).alias(n) for n in names]
    both = heads.unionByName(own.where("not absent").select("conv_id", "turn", "role", "text", "absent", F.lit(1).alias("_at"), *empty)).repartition("conv_id")
    order = ["_at", "turn", "role", "text"]
    last = F.lead("_at").over(Window.partitionBy("conv_id").orderBy(*order)).isNotNull()
    streamed = both.withColumn("more", last).sortWithinPartitions("conv_id", *order).drop("_at").mapInArrow(_streamed, schema)
    return short.unionByName(streamed)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, report, h, first = Output.NAMES[4:], None, hashlib.sha256(), True
    done: list[tuple] = []
    schema = None
    for batch in batches:
        if schema is None:
            full = _schema(batch)
            schema = pa.schema([full.field("conv_id"), *[full.field(n) for n in names], ("repaired_sha256", pa.string())])
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            for row in zip(*(part.column(c).to_pylist() for c in Output.NAMES), strict=True):
                if row[1] == 0:
                    if report:
                        done.append((*report, h.hexdigest()))
                    report, h, first = (row[0], *row[4:]), hashlib.sha256(), True
                else:
                    h.update(f"{'' if first else chr(10)}{row[2]}:{row[3]}".encode())
                    first = False
        if len(done) > 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), schema.types, strict=True)], schema=schema)
            done = []
    if report:
        done.append((*report, h.hexdigest()))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), schema.types, strict=True)], schema=schema)


def digests(repairs: DataFrame) -> DataFrame:
    """The reports with the hash of each conversation's repaired rows as lines of role:text; repairs as ``repaired`` returns them."""
    return repairs.mapInArrow(_digests, f"conv_id {repairs.schema['conv_id'].dataType.simpleString()}, {REPORT}, repaired_sha256 string")
