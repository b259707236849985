"""Conversation structure repair: the cheapest edits that make turns alternate again.

Each row has one fault at most: ``blank`` (no word character), else ``duplicate`` (its
role and text were there earlier in the conversation), else ``truncated`` (its last
character that is no blank does not end a sentence). Edits are Keep (0), Rerole to user or
assistant (3), Delete (4; the only edit of blank and duplicate rows) and Insert an empty
turn of the user or assistant (3); a truncated row that is not deleted adds 3. The initials
of the roles that result have the form ``(s?(ua)+)?``. Of edits of equal cost, those whose
initials are least in ASCII are taken.

These edits are a weighted automaton of four states over nine kinds of rows. It is
determinised lazily: what it costs from each state to the end, less the least of these, is
one state of the deterministic automaton, and a step read once is kept in a transition
table, with what was taken off. So a conversation is read from its last row to its first
by table look-ups alone, which gives the cost; then the arcs on which costs are tight are
followed back from its first row, the least initial first, which gives the audit. The
differences of costs are bounded by a few inserts, so the table stays small (under 100
states) however many conversations there are.

Rows are dealt by ranges of (conversation, turn, role, first characters) and sorted. A
conversation inside a range is repaired there; one that goes on in the next range, as one
that holds a third of all rows, leaves a part in each, written in the same pass, and the
parts are put together. Its finished row, which holds its texts, is in one place.

Order of rows: by turn (nulls first), then role and text. A null role or text is one
blank, so such a row is blank or of an unknown role; roles are known by their first
character, an empty one has none. Rows of a null conversation are one conversation. A
range of turns that no bigint holds gives the largest bigint as gaps. Very long texts are
whole; other columns are not used, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mediashoal.llm.arrow import BLANKS
from mediashoal.storage import materialize, small_batches

#: What edits cost.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: before everything, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the turn that each state asks for, and that turn's role.
NEXT, ASKED = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
#: Kinds of rows: twice the role's place here, and one more if truncated; or one to delete.
INITIALS = "sua"
GONE = 2 * len(INITIALS) + 2
#: Code points of a text that ranges look at, and rows and characters of an output batch.
HEAD, OUT_ROWS, OUT_CHARS = 64, 256, 4 << 20
LEGAL = {"su", "ua", "au"}
MOST = 2**63 - 1

TURNS = "array<struct<role:string,text:string>>"
MADE = f"gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns {TURNS}"
PARTS = f"part int, open boolean, lo bigint, hi bigint, n_turns bigint, first bigint, last bigint, {MADE}"


class Automaton:
    """The deterministic automaton, as far as conversations have asked for it."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._ids: dict[tuple[int, ...], int] = {}
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._traces: dict[tuple[int, int, int], tuple[str, tuple[str | None, ...], int]] = {}
        self.end, self.end_cost = self._state(self._inserts([0, MOST, MOST, 0]))

    @staticmethod
    def _inserts(costs: list[int]) -> list[int]:
        """With turns inserted before the first row."""
        for _ in range(2):
            costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
        return costs

    def _state(self, costs: list[int]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self._ids:
            self._ids[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._ids[vector], least

    @staticmethod
    def _edits(kind: int, q: int) -> Iterator[tuple[str, int, int]]:
        """What may be done with a row: letter, cost, next state; in order of letters."""
        yield "D", DELETE, q
        if kind != GONE:
            initial, cut = INITIALS[kind // 2 : kind // 2 + 1], CUT * (kind % 2)
            if initial == ASKED[q][0]:
                yield "K", cut, NEXT[q]
            elif initial == "s" and q == START:
                yield "K", cut, SYSTEM
            yield "R", REROLE + cut, NEXT[q]

    def step(self, after: int, kind: int) -> tuple[int, int]:
        """The state before a row, from that after it, and what was taken off."""
        found = self._steps.get((after, kind))
        if found is None:
            costs = self.vectors[after]
            found = self._steps[after, kind] = self._state(self._inserts([min(c + costs[to] for _, c, to in self._edits(kind, q)) for q in range(4)]))
        return found

    def trace(self, after: int, kind: int, q: int) -> tuple[str, tuple[str | None, ...], int]:
        """The least letters on tight arcs that take in one row from state ``q``; the turns
        they write (None: the row as it is, a role with ``+``: the row in it, a role: a new
        one); the next state."""
        found = self._traces.get((after, kind, q))
        if found is None:
            before, less = self.step(after, kind)
            here, there, letters, turns, at = self.vectors[before], self.vectors[after], "", [], q
            while True:
                tight = [e for e in self._edits(kind, at) if e[1] + there[e[2]] == here[at] + less]
                if here[at] == INSERT + here[NEXT[at]] and not (tight and tight[0][0] == "D"):
                    letters, turns, at = letters + "I", [*turns, ASKED[at]], NEXT[at]
                    continue
                letter, _, to = tight[0]
                if letter != "D":
                    turns.append(None if letter == "K" else ASKED[at] + "+")
                found = self._traces[after, kind, q] = (letters + letter, tuple(turns), to)
                break
        return found

    def repair(self, kinds: list[int], rows: list[tuple[str, str]]) -> tuple[int, str, list[dict[str, str]]]:
        """Cost, audit and turns of one conversation."""
        states, cost = [self.end], self.end_cost
        for kind in reversed(kinds):
            before, less = self.step(states[-1], kind)
            states.append(before)
            cost += less
        at, audit, turns = START, [], []
        cost += self.vectors[states[-1]][START]
        for k, (kind, row) in enumerate(zip(kinds, rows, strict=True)):
            letters, made, at = self.trace(states[len(kinds) - 1 - k], kind, at)
            audit.append(letters)
            for role in made:
                if role is None:
                    turns.append({"role": row[0], "text": row[1]})
                elif role[-1] == "+":
                    turns.append({"role": role[:-1], "text": row[1]})
                else:
                    turns.append({"role": role, "text": ""})
        while at not in (START, ASSISTANT):
            audit.append("I")
            turns.append({"role": ASKED[at], "text": ""})
            at = NEXT[at]
        return cost, "".join(audit), turns


class _Conversation:
    """Rows in order, and what is counted over their turns."""

    def __init__(self):
        self.kinds: list[int] = []
        self.rows: list[tuple[str, str]] = []
        self.lo = self.hi = self.first = self.last = None
        self.n_turns = self.size = 0

    def turns(self, lo: int | None, hi: int | None, first: int | None, last: int | None, n: int) -> None:
        """Take in turn numbers that come after those so far."""
        if n:
            self.n_turns += n - (self.n_turns > 0 and first == self.last)
            self.lo, self.first = (lo, first) if self.lo is None else (self.lo, self.first)
            self.hi, self.last = hi, last

    def add(self, turn: int | None, role: str, text: str, kind: int, copies: int) -> None:
        for _ in range(copies):
            self.kinds.append(kind)
            self.rows.append((role, text))
            self.size += len(text)
        if copies and turn is not None:
            self.turns(turn, turn, turn, turn, 1)

    def made(self, automaton: Automaton) -> tuple:
        seen, kinds, blank, duplicate, truncated = set(), [], 0, 0, 0
        for kind, row in zip(self.kinds, self.rows, strict=True):
            if kind == GONE:
                blank += 1
            elif row in seen:
                kind, duplicate = GONE, duplicate + 1
            else:
                truncated += kind % 2
            seen.add(row)
            kinds.append(kind)
        initials = [role[:1] for role, _ in self.rows]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        gaps = min(MOST, self.hi - self.lo + 1 - self.n_turns) if self.n_turns else 0
        return gaps, blank, duplicate, truncated, illegal, *automaton.repair(kinds, self.rows)

    def part(self) -> tuple:
        """As a part: the kinds in place of the audit, the rows in place of the turns."""
        return None, None, None, None, None, None, "".join(map(str, self.kinds)), [{"role": r, "text": t} for r, t in self.rows]

    def go_on(self, part: dict) -> None:
        self.kinds += map(int, part["audit"])
        self.rows += [(r["role"], r["text"]) for r in part["turns"]]
        self.turns(part["lo"], part["hi"], part["first"], part["last"], part["n_turns"])


def kind_of(role: Column, text: Column) -> Column:
    """The kind of a row, but for what depends on other rows."""
    body = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    place = F.lit(len(INITIALS))
    for k, i in enumerate(INITIALS):
        place = F.when(initial == i, F.lit(k)).otherwise(place)
    return F.when(body == "", F.lit(GONE)).otherwise(2 * place + F.when(F.right(body, F.lit(1)).isin(*".!?"), F.lit(0)).otherwise(F.lit(1)))


def damage(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: faults dealt by the CRC-32 of ``conv:turn``, of
    20 one each: 0 drops the row (no copies), 1 empties its text, 2 takes the ends of its
    sentences out, 3 repeats it, 4 makes it the user's. Nulls count as one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    return conversations.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.when(dealt == 4, F.lit("user")).otherwise(blank(role)).alias("role"),
        F.when(dealt == 1, F.lit("")).when(dealt == 2, F.translate(blank(text), ".!?", "")).otherwise(blank(text)).alias("text"),
        F.when(dealt == 0, F.lit(0)).when(dealt == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns)`` of each
    conversation; ``turns`` are the repaired ones. ``copies``: a column that says how often a
    row is there; of one that is there 0 times, only its conversation is known.
    """
    small_batches(rows.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies")
    ).withColumn("kind", kind_of(F.col("role"), F.col("text")))
    dealt = own.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("conv_id", "turn", "role", "text")
    key = f"conv_id {own.schema['conv_id'].dataType.simpleString()}"
    schema = StructType.fromDDL(f"{key}, {PARTS}")
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    wanted = StructType.fromDDL(f"{key}, {MADE}")
    made_names, made_types = wanted.names, [to_arrow_type(f.dataType) for f in wanted.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, automaton, out, size = TaskContext.get().partitionId(), Automaton(), [], 0
        ident, current, first = None, None, True

        def row(is_open: bool) -> tuple:
            c = current
            return (ident, part, is_open, c.lo, c.hi, c.n_turns, c.first, c.last, *(c.part() if is_open else c.made(automaton)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for c, *values in zip(*(x.to_pylist() for x in batch.select(["conv_id", "turn", "role", "text", "kind", "copies"]).columns), strict=True):
                if current is None or c != ident:
                    if current is not None:
                        out.append(row(first))
                        size, first = size + current.size, False
                        if len(out) >= OUT_ROWS or size >= OUT_CHARS:
                            yield batch_of(out)
                            out, size = [], 0
                    ident, current = c, _Conversation()
                current.add(*values)
        if current is not None:
            yield batch_of([*out, row(True)])

    found = materialize(dealt.mapInArrow(run, f"{key}, {PARTS}"), "repaired")

    def together(key: tuple, group: pa.Table) -> pa.Table:
        whole = _Conversation()
        for part in group.sort_by("part").to_pylist():
            whole.go_on(part)
        return pa.table([pa.array([x], t) for x, t in zip((key[0].as_py(), *whole.made(Automaton())), made_types, strict=True)], made_names)

    joined = found.where("open").groupBy("conv_id").applyInArrow(together, f"{key}, {MADE}")
    return found.where("not open").select(made_names).unionAll(joined)
