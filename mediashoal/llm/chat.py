"""Preference formatting: one prompt and two masked completions for each pair.

The turns of the chosen and of the rejected conversation of a pair are in order of turn
number, role and text. The longest common prefix of turns is rendered once, as the prompt;
what follows it on either side is that side's completion, with a mask: the spans, in code
points of the completion, of the assistant's texts and end marks.

Turns of both sides are dealt by ranges of (pair, turn, role, first characters) and sorted,
so a text moves once, equal turns of two sides stand beside each other, and the common
prefix ends at the first turn that one side lacks. Each range is read once, as a stream, and
what it makes is written: the pairs inside it, and the first and the last, which may go on
in other ranges, as parts. A pair that holds a third of all turns leaves a part in each of
its ranges; these parts, as many as ranges, are put together with their masks moved on by
the lengths before them. So no pair is sorted or searched in one task; only its finished
row, which holds its text, is in one place.

Nulls: a null pair id is left out, a null turn number comes first, a null role is
``unknown``, a null text is empty. A row repeated in one conversation counts once;
different rows with one turn number are ordered by role and text. A pair with one side
missing has no common prefix and an empty completion there; equal sides give a prompt
and two empty completions. Very long texts are whole; a pair is one row, however many
turns it has. Markers inside texts are broken up, so none can be forged. Other columns
are not used, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from mediashoal.storage import materialize, small_batches

LEARNED = "assistant"
END = "<|end|>\n"
#: Bits of ``sides``.
CHOSEN, REJECTED = 1, 2
#: Code points of a text that ranges look at.
HEAD = 64
SPANS = "array<struct<start:int,end:int>>"
MADE = f"prompt string, chosen string, rejected string, chosen_mask {SPANS}, rejected_mask {SPANS}, n_common int"
PARTS = f"part int, open boolean, differs boolean, common_mask {SPANS}, {MADE}"
#: Rows and characters of an output batch.
OUT_ROWS, OUT_CHARS = 256, 4 << 20


class _Text:
    """Rendered turns with the spans to learn."""

    def __init__(self):
        self.texts: list[str] = []
        self.spans: list[dict[str, int]] = []
        self.size = 0

    def add(self, head: str, body: str, learned: bool) -> None:
        self.append(head + body, [{"start": len(head), "end": len(head) + len(body) - 1}] if learned else [])

    def append(self, text: str, spans: list[dict[str, int]]) -> None:
        self.spans += [{k: v + self.size for k, v in s.items()} for s in spans]
        self.texts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.texts)


class _Pair:
    """What is known of a pair, or of its part in a range."""

    def __init__(self):
        self.common, self.chosen, self.rejected = _Text(), _Text(), _Text()
        self.differs, self.n = False, 0

    def turn(self, role: str, text: str, sides: int) -> None:
        if not sides:
            return
        head, body, learned = f"<|{role.replace('<|', '< |')}|>\n", text.replace("<|", "< |") + END, role == LEARNED
        self.differs = self.differs or sides != CHOSEN | REJECTED
        if not self.differs:
            self.common.add(head, body, learned)
            self.n += 1
            return
        if sides & CHOSEN:
            self.chosen.add(head, body, learned)
        if sides & REJECTED:
            self.rejected.add(head, body, learned)

    def go_on(self, part: dict) -> None:
        """Take up the part of the next range."""
        if self.differs:
            self.chosen.append(part["prompt"], part["common_mask"])
            self.rejected.append(part["prompt"], part["common_mask"])
        else:
            self.common.append(part["prompt"], part["common_mask"])
            self.n += part["n_common"]
        self.chosen.append(part["chosen"], part["chosen_mask"])
        self.rejected.append(part["rejected"], part["rejected_mask"])
        self.differs = self.differs or part["differs"]

    def made(self) -> tuple:
        return self.common.text(), self.chosen.text(), self.rejected.text(), self.chosen.spans, self.rejected.spans, self.n


def _pairs(pair: str, schema: str):
    """Rows of the pairs of a sorted range; ``open`` ones may go on in another."""

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(f"{schema}, {PARTS}").fields]
    names = [pair, *[f.name for f in StructType.fromDDL(PARTS).fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, size, first = TaskContext.get().partitionId(), [], 0, True
        key = own = entry = None
        adds = takes = 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def row(is_open):
            return (key, part, is_open, own.differs, own.common.spans, *own.made())

        for batch in batches:
            for k, turn, role, text, sides, without in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own is not None and entry != (k, turn, role, text):
                    own.turn(entry[2], entry[3], adds & ~takes)
                    if k != key:
                        size += own.common.size + own.chosen.size + own.rejected.size
                        out.append(row(first))
                        if len(out) >= OUT_ROWS or size >= OUT_CHARS:
                            yield batch_of(out)
                            out, size = [], 0
                        first = False
                if own is None or k != key:
                    key, own = k, _Pair()
                if entry != (k, turn, role, text):
                    entry, adds, takes = (k, turn, role, text), 0, 0
                adds |= sides
                takes |= without
        if own is not None:
            own.turn(entry[2], entry[3], adds & ~takes)
            out.append(row(True))
        if out:
            yield batch_of(out)

    return run


def turns(side: DataFrame, sides: int, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", without: int = 0) -> DataFrame:
    """``(pair, turn, role, text, sides, without)``: the sides that have the turns, or lose them."""
    return side.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair"),
        F.coalesce(F.col(turn).cast("bigint"), F.lit(-(2**63))).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.lit(sides).alias("sides"),
        F.lit(without).alias("without"),
    )


def format_turns(rows: DataFrame, pair: str = "pair_id") -> DataFrame:
    """``(pair, prompt, chosen, rejected, chosen_mask, rejected_mask, n_common)`` of ``turns``.

    A turn belongs to the sides that any of its rows gives it and none takes from it.
    Masks are arrays of ``struct<start, end>``; ``n_common`` counts the prompt's turns.
    """
    small_batches(rows.sparkSession)
    kind = f"`{pair}` {rows.schema['pair'].dataType.simpleString()}"
    dealt = rows.repartitionByRange("pair", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("pair", "turn", "role", "text")
    # written once: both halves below are of the same ranges, however Spark plans them
    found = materialize(dealt.mapInArrow(_pairs(pair, kind), f"{kind}, {PARTS}"), "pairs")
    wanted = [f.name for f in StructType.fromDDL(f"{kind}, {MADE}").fields]
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(f"{kind}, {MADE}").fields]

    def together(key: tuple, group: pa.Table) -> pa.Table:
        own = _Pair()
        for part in group.sort_by("part").to_pylist():
            own.go_on(part)
        return pa.table([pa.array([x], t) for x, t in zip((key[0].as_py(), *own.made()), types, strict=True)], wanted)

    joined = found.where("open").groupBy(pair).applyInArrow(together, f"{kind}, {MADE}")
    return found.where("not open").select(wanted).unionAll(joined)


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``format_turns`` of two tables of turns."""
    return format_turns(turns(chosen, CHOSEN, pair, turn, role, text).unionAll(turns(rejected, REJECTED, pair, turn, role, text)), pair)


def turns_of(conversations: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: each conversation is chosen; rejected is
    the same with its last turn answered by the text that ends its neighbour (ids 2k
    and 2k + 1), where there is one. Only last turns meet in a join.
    """
    rows = turns(conversations, CHOSEN | REJECTED, "conv_id")
    ends = rows.groupBy("pair").agg(F.max(F.struct("turn", "role", "text")).alias("end"))
    other = ends.select(F.col("pair").bitwiseXOR(F.lit(1)).alias("pair"), F.col("end.text").alias("reply"))
    swapped = ends.join(other, "pair").where("end.text <> reply").select("pair", "end.turn", "end.role", F.col("end.text").alias("own"), "reply")
    gone = turns(swapped, 0, "pair", text="own", without=REJECTED)
    return rows.unionAll(gone).unionAll(turns(swapped, REJECTED, "pair", text="reply"))
