"""Operator 13: repair of conversation structure by a secondary-sorted stream.

Rows are repartitioned by conversation, sorted by turn, and read once by ``mapInPandas``, which carries the state of an
exact dynamic program from row to row and over Arrow batches. A repaired conversation's role initials are
``(s?(ua)+)?``; the states are what has been written so far: nothing, a system row, a user row, an assistant row. Each
state has the least cost and, by a rank, the least of the cheapest audits so far. A row moves the four states at once:
the move depends on the (normalised) states and the row's class alone, so moves are computed once and looked up. What a
move chose is 5 bits a state, 20 bits a row.

A conversation of up to ``HELD_ROWS`` rows and ``HELD_CHARS`` characters is traced back and written where it ends. A
longer one lets its texts go and spills its choices as rows of the staged result, ``CHUNK`` a row; a second stream reads
the chunks from last to first and follows the choices, and a third one, over that conversation's rows in order, writes
audit and hash. So a task holds a bounded number of rows whatever a conversation's length; its audit alone grows with it.

Rows of one turn come in the order of role and text (a fixed order, so that reruns agree); null turns come first; null
ids are one conversation; null roles and texts count as one space, so a null text is blank. Repeated rows are duplicates.
Roles other than those that begin with s, u or a must be changed or deleted. An empty table gives an empty result; extra
columns are ignored. ``repair`` works on any rows; ``op13_conversation_repair`` damages the table's rows first.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notelab.llm.common import Scratch, read, reachable

HELD_ROWS, HELD_CHARS, CHUNK = 20_000, 8_000_000, 65_536
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"
LETTER = "DKR"
ROLE = {2: "user", 3: "assistant"}
#: State after an inserted row, and after keeping a row of class s, u, a; states are 0 nothing, 1 system, 2 user, 3 assistant.
_INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_END = {0: "", 1: "II", 2: "I", 3: ""}
#: No two states' cheapest endings differ by more than 9 (delete a system row, insert a pair, insert one): what costs more than that above the least can't win.
_FAR = 12
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


class Moves:
    """The dynamic program's moves, by state vector and row class, filled as they occur."""

    def __init__(self):
        self.vectors: list[tuple] = [((0, None, None, None), (0, 0, 0, 0))]
        self.number = {self.vectors[0]: 0}
        self.known: dict[int, tuple[int, int, int]] = {}

    def __call__(self, vector: int, kind: int) -> tuple[int, int, int]:
        """(new vector, cost that all states share, choices); kind is 4 * initial + fault."""
        key = vector * 16 + kind
        if (found := self.known.get(key)) is None:
            found = self.known[key] = self._move(*self.vectors[vector], *divmod(kind, 4))
        return found

    def _move(self, costs: tuple, ranks: tuple, initial: int, fault: int) -> tuple[int, int, int]:
        best: dict[int, tuple] = {}
        for p, c in enumerate(costs):
            if c is None:
                continue
            options = [(p, DELETE, "D", 0, 0)]
            if fault not in (BLANK, DUPLICATE):
                more = CUT_SHORT if fault == TRUNCATED else 0
                for j in (0, 1):  # a second insert before a row leads back to a state that costs less
                    q, paid = (_INSERTED[p], INSERT) if j else (p, 0)
                    if (q, initial) in _KEPT:
                        options.append((_KEPT[q, initial], paid + more, "I" * j + "K", j, 1))
                    options.append((_INSERTED[q], paid + REROLE + more, "I" * j + "R", j, 2))
            for to, cost, letters, j, action in options:
                new = (c + cost, ranks[p], letters, p | j << 2 | action << 3)
                best[to] = min(best.get(to, new), new)
        least = min(b[0] for b in best.values())
        near = {s: b for s, b in best.items() if b[0] - least <= _FAR}
        order = sorted(near, key=lambda s: near[s][1:3])
        vector = (tuple(near[s][0] - least if s in near else None for s in range(4)), tuple(order.index(s) if s in near else 0 for s in range(4)))
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least, sum(near[s][3] << 5 * s for s in near)

    def end(self, vector: int) -> tuple[int, int]:
        """(state, cost) of the cheapest ending."""
        costs, ranks = self.vectors[vector]
        cost, _, _, state = min((c + INSERT * len(_END[s]), ranks[s], _END[s], s) for s, c in enumerate(costs) if c is not None)
        return state, cost


def trace(choices, state: int) -> tuple[bytearray, int]:
    """Each row's choice (5 bits) from the last row's state back to the first, and the state before the first row."""
    out = bytearray(len(choices))
    for i in range(len(choices) - 1, -1, -1):
        out[i] = choice = choices[i] >> 5 * state & 31
        state = choice & 3
    return out, state


def edit(choice: int, role: str, text: str) -> tuple[str, list[str]]:
    """(letters of the audit, repaired lines) of a row."""
    state, inserted, action = choice & 3, choice >> 2 & 1, choice >> 3
    lines = []
    if inserted:
        state = _INSERTED[state]
        lines.append(ROLE[state] + ":")
    if action:
        lines.append(f"{role if action == 1 else ROLE[_INSERTED[state]]}:{text}")
    return "I" * inserted + LETTER[action], lines


def ending(state: int) -> tuple[str, list[str]]:
    return _END[state], [f"{r}:" for r in ("user", "assistant")[-len(_END[state]):] if _END[state]]


RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, chunk long, choices binary"
_FIELDS = [f.split()[0] for f in RESULT.split(", ")]
_LEGAL = {(0, 1), (1, 2), (2, 1)}


class Conversation:
    """What is carried of the conversation that the stream is in."""

    def __init__(self, conv):
        self.conv, self.counts, self.illegal = conv, [0] * 4, 0
        self.low = self.high = None
        self.turns, self.before, self.vector, self.cost = 0, None, 0, 0
        self.rows, self.chars, self.held, self.chunk = 0, 0, [], 0
        self.choices = array("I")

    def row(self, values: dict) -> tuple:
        return tuple({"conv": self.conv, "chunk": None, "choices": None, "audit": None, "repaired_sha256": None} .get(f) if f not in values else values[f] for f in _FIELDS)

    def add(self, moves: Moves, turn, initial: int, fault: int, role: str, text: str, limits: tuple[int, int, int]) -> list[tuple]:
        """Takes a row; returns choices to spill, if any."""
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.illegal += self.before is not None and (self.before, initial) not in _LEGAL
        self.before = initial
        self.counts[fault] += 1
        self.vector, paid, choices = moves(self.vector, 4 * initial + fault)
        self.cost += paid
        self.choices.append(choices)
        self.rows += 1
        if self.held is not None:
            self.held.append((role, text))
            self.chars += len(role) + len(text)
            if self.rows > limits[0] or self.chars > limits[1]:
                self.held = None
        return self.spill() if self.held is None and len(self.choices) >= limits[2] else []

    def spill(self) -> list[tuple]:
        """The choices so far as a row whose chunk is the number of their first row."""
        out = [self.row({"chunk": self.chunk, "choices": np.array(self.choices, dtype="<u4").tobytes()})]
        self.chunk, self.choices = self.chunk + len(self.choices), array("I")
        return out

    def close(self, moves: Moves) -> list[tuple]:
        """The result row; of a conversation that was not held, its last choices and a row with its last state as ``choices``."""
        values = {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
                  "illegal": int(self.illegal), "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        if not self.rows:
            return [self.row(values)]
        state, paid = moves.end(self.vector)
        values["cost"] = self.cost + paid
        if self.held is None:
            out = self.spill() if self.choices else []
            return [*out, self.row(values | {"audit": None, "repaired_sha256": None, "chunk": self.chunk, "choices": bytes([state])})]
        done, _ = trace(self.choices, state)
        letters, lines = [], []
        for choice, (role, text) in zip(done, self.held, strict=True):
            made = edit(choice, role, text)
            letters.append(made[0])
            lines += made[1]
        made = ending(state)
        return [self.row(values | {"audit": "".join(letters) + made[0], "repaired_sha256": hashlib.sha256("\n".join(lines + made[1]).encode()).hexdigest()})]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_FIELDS, dtype=object)
    return out


def _stream(limits: tuple[int, int, int]):
    """Sorted rows (conv, turn, initial, fault, role, text) to result rows and spilled choices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves, now, out = Moves(), None, []
        for batch in batches:
            for conv, turn, none, initial, fault, role, text in zip(*(batch[c].tolist() for c in ("conv", "turn", "no_turn", "initial", "fault", "role", "text")), strict=True):
                if now is None or conv != now.conv:
                    out += now.close(moves) if now is not None else []
                    now = Conversation(conv)
                if fault >= 0:
                    out += now.add(moves, None if none else turn, initial, fault, role, text, limits)
                if len(out) >= 1000:
                    yield _frame(out)
                    out = []
        out += now.close(moves) if now is not None else []
        if out:
            yield _frame(out)

    return run


def _backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of choices, last first, to one row per conversation row: (conv, at, choice); the last state comes as at = -1."""
    conv, state = (), 0
    for batch in batches:
        for c, chunk, choices in zip(batch["conv"], batch["chunk"], batch["choices"], strict=True):
            if (c,) != conv:
                conv, state = (c,), choices[0]
                yield pd.DataFrame({"conv": [c], "at": [-1], "choice": [state]}, dtype=object)
                continue
            done, state = trace(np.frombuffer(choices, dtype="<u4").tolist(), state)
            yield pd.DataFrame({"conv": pd.Series([c] * len(done), dtype=object), "at": np.arange(len(done)) + int(chunk), "choice": np.frombuffer(bytes(done), dtype=np.uint8).astype(np.int32)})


def _forwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (conv, at, choice, role, text) to (conv, audit, repaired_sha256); at = -1 has the last state."""
    conv, state, letters, sha, first = (), 0, [], None, True

    def write(lines):
        nonlocal first
        for line in lines:
            sha.update((("" if first else "\n") + line).encode())
            first = False

    def close():
        made = ending(state)
        write(made[1])
        return pd.DataFrame({"conv": [conv[0]], "audit": ["".join(letters) + made[0]], "repaired_sha256": [sha.hexdigest()]}, dtype=object)

    for batch in batches:
        for c, at, choice, role, text in zip(*(batch[k].tolist() for k in ("conv", "at", "choice", "role", "text")), strict=True):
            if (c,) != conv:
                if conv:
                    yield close()
                conv, state, letters, sha, first = (c,), choice, [], hashlib.sha256(), True
                continue
            made = edit(choice, role, text)
            letters.append(made[0])
            write(made[1])
    if conv:
        yield close()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, live) of the damaged rows; a dropped row stays as one that isn't live, so that its conversation is known."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    made = rows.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(filled("role")).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).when(kind != 0, filled("text")).otherwise("").alias("text"))
    live = F.col("kind") != 0
    return made.withColumn("copies", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(live, F.col("role")).otherwise("").alias("role"), "text", live.alias("live"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of (conv, turn, role, text, live) by conversation and turn with their class; one exchange, two sorts."""
    key = Window.partitionBy("conv", "live", F.xxhash64("role", "text"), "role", "text").orderBy(F.asc_nulls_first("turn"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    again = F.row_number().over(key).alias("again")
    initial = F.substring("role", 1, 1)
    fault = F.when(~F.col("live"), -1).when(end == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(F.right(end, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    numbered = rows.repartition("conv").select("*", again)
    return numbered.sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text", "again").select(
        "conv", F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), F.col("turn").isNull().alias("no_turn"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"), fault.alias("fault"), "role", "text", "again", "live")


def _giants(rows: DataFrame, spilled: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, audit, repaired_sha256) of the conversations whose choices were spilled."""
    chunks = spilled.select("conv", "chunk", "choices").repartition("conv").sortWithinPartitions("conv", F.desc("chunk"))
    choices = scratch.stage(chunks.mapInPandas(_backwards, "conv string, at long, choice int"), "choices")
    keys = spilled.select("conv").distinct()
    own = rows.where("live").alias("r").join(keys.alias("k"), F.expr("r.conv <=> k.conv"), "left_semi")
    place = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = own.repartition("conv").select("conv", (F.row_number().over(place) - 1).cast("long").alias("at"), "role", "text")
    joined = choices.alias("c").join(placed.alias("p"), F.expr("c.conv <=> p.conv AND c.at = p.at"), "left").select("c.conv", "c.at", "c.choice", "p.role", "p.text")
    return joined.repartition("conv").sortWithinPartitions("conv", "at").mapInPandas(_forwards, "conv string, audit string, repaired_sha256 string")


def repair(rows: DataFrame, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS, chunk: int = CHUNK) -> DataFrame:
    """A row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows has conv (string), turn (long), role, text (strings, not null) and live (false: a row that only names its conversation).
    """
    reachable(rows.sparkSession)
    scratch, limits = Scratch(rows.sparkSession, "conversations"), (held_rows, held_chars, chunk)
    made = scratch.stage(_ordered(rows).drop("again", "live").mapInPandas(_stream(limits), RESULT), "repaired")
    fields = [f for f in _FIELDS if f not in ("chunk", "choices")]
    done, spilled = made.where(F.col("chunk").isNull()).select(fields), made.where(F.col("chunk").isNotNull())
    if spilled.isEmpty():
        return done
    long = spilled.where(F.col("cost").isNotNull()).drop("audit", "repaired_sha256")
    written = _giants(rows, spilled, scratch)
    return done.unionByName(long.alias("a").join(written.alias("w"), F.expr("a.conv <=> w.conv")).select(*[f"a.{f}" for f in fields[:-2]], "w.audit", "w.repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = repair(damaged(read(spark, sf_dir, "conversations")))
    return made.select(F.col("conv").cast("long").alias("conv_id"), *[c for c in made.columns if c != "conv"])
