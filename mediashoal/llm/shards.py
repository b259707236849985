"""Resharding by minimum-cost flow: new capacities are met by moving the fewest bytes.

A layout is a set of immutable blocks, each one Parquet file of one shard, and a small
table that says which shard each block belongs to. A row's place (``slot``) is its block's
first slot plus its row in the file, so neither a shard's number nor its slots are in any
file: a block that changes shards is not rewritten, its entry is.

``reshard`` takes the sizes of the old shards and the capacities of the new ones, and
solves the transport problem between them by successive shortest paths with potentials:
bytes that stay cost nothing, others what ``cost`` says (1 if not given), so the cheapest
flow moves the fewest bytes. Each flow is then made of whole blocks, and of a part of one
block at its end. Only these blocks, at most one for each arc of the flow, are read and
written again, each in one task of at most a block's bytes, its rows dealt from the largest
to the smallest to the shard that lacks most. The new files hold what the old blocks' held.

Rows of an eighth of a shard and more can't be dealt so finely. There are at most eight
times as many as shards; their sizes alone meet in the driver, and each stays at home if
it fits and else goes where most room is. Capacities for the rest are what these leave.

Sizes are the UTF-8 bytes of a text and 16 (a null one: 16). Blocks are dealt by hashes of id and text,
more of them for a shard of more bytes, so one that holds a third of all rows is many
tasks; rows equal in both are in one block. A null id is an id like others. All columns of
the table are kept in one struct, so none can clash. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.storage import fresh_path, small_batches

ROW_BYTES = 16
#: Blocks: at most so many bytes and some so many a shard, but not under so few bytes, nor more than MOST_BLOCKS in all.
BLOCK_BYTES, BLOCKS_A_SHARD, LEAST_BYTES, MOST_BLOCKS = 64 << 20, 16, 64 << 10, 1 << 20
#: Rows of a shard's size divided by this are placed one by one.
LARGE = 8


@dataclass(frozen=True)
class Block:
    ident: int
    shard: int
    rows: int
    bytes: int


@dataclass
class Layout:
    """``paths``: folders of blocks; a block is in one of them. ``large``: the block of each
    shard that holds rows to be placed one by one."""

    spark: SparkSession
    paths: list[str]
    blocks: list[Block]
    schema: str
    large: set[int] = field(default_factory=set)

    def sizes(self, shards: int) -> list[int]:
        out = [0] * shards
        for b in self.blocks:
            out[b.shard] += b.bytes
        return out

    def files(self) -> DataFrame:
        """``(row, size, block, at)`` of all files, also of blocks no longer in the layout."""
        read = self.spark.read.schema(f"row {self.schema}, size bigint, block int")
        parts = [read.parquet(p).select("row", "size", "block", F.col("_metadata.row_index").alias("at")) for p in self.paths]
        return reduce(DataFrame.unionAll, parts)

    def read(self) -> DataFrame:
        """``(row, size, shard, slot)``."""
        first, entries = {}, []
        for b in sorted(self.blocks, key=lambda b: (b.shard, b.ident)):
            entries.append((b.ident, b.shard, first.get(b.shard, 0)))
            first[b.shard] = first.get(b.shard, 0) + b.rows
        table = self.spark.createDataFrame(entries, "block int, shard int, first bigint")
        # at most MOST_BLOCKS entries of 16 bytes
        return self.files().join(F.broadcast(table), "block").select("row", "size", "shard", (F.col("first") + F.col("at")).alias("slot"))


@dataclass
class Plan:
    """``flow``: bytes from old to new shards; ``moves``: the new shard of whole blocks;
    ``splits``: bytes of a block for each new shard; ``singles``: the new shard of large
    rows by block and row of its file."""

    flow: dict[tuple[int, int], int]
    moves: dict[int, int]
    splits: dict[int, dict[int, int]]
    singles: dict[tuple[int, int], int]
    #: Bytes that change shards, large rows included.
    moved: int


def transport(supply: Sequence[int], capacity: Sequence[int], cost: np.ndarray) -> dict[tuple[int, int], int]:
    """The cheapest flow of all supplies into the capacities, which hold them.

    Successive shortest paths over the residual graph; reduced costs stay at or over 0, so
    each path is one dense Dijkstra of as many steps as nodes, over arrays.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    left, room = np.array(supply, np.int64), np.array(capacity, np.int64)
    flow, cost = np.zeros((n, m), np.int64), np.asarray(cost, np.int64)
    high = np.zeros(n + m, np.int64)  # potentials
    far = np.iinfo(np.int64).max // 4
    while left.any():
        dist, before, open_ = np.full(n + m, far), np.full(n + m, -1), np.ones(n + m, bool)
        dist[:n][left > 0] = 0
        while True:
            at = int(np.where(open_, dist, far + 1).argmin())
            if at >= n and room[at - n] > 0 or dist[at] >= far:
                break
            open_[at] = False
            if at < n:
                new, to = dist[at] + cost[at] + high[at] - high[n:], slice(n, None)
            else:
                back = flow[:, at - n] > 0
                new, to = np.where(back, dist[at] - cost[:, at - n] + high[at] - high[:n], far), slice(0, n)
            better = open_[to] & (new < dist[to])
            dist[to] = np.where(better, new, dist[to])
            before[to] = np.where(better, at, before[to])
        end = at
        high += np.minimum(dist, dist[end])
        path = [end]
        while before[path[-1]] >= 0:
            path.append(int(before[path[-1]]))
        start, arcs = path[-1], list(zip(path[1:], path))
        amount = min(int(left[start]), int(room[end - n]), *[int(flow[v, u - n]) for u, v in arcs if u >= n] or [int(left[start])])
        for u, v in arcs:
            if u < n:
                flow[u, v - n] += amount
            else:
                flow[v, u - n] -= amount
        left[start] -= amount
        room[end - n] -= amount
    return {(int(i), int(j)): int(flow[i, j]) for i, j in np.argwhere(flow)}


def even(total: int, used: Sequence[int], weights: Sequence[int]) -> list[int]:
    """``total`` more bytes into shards that hold ``used``, so that sums are in proportion to
    ``weights`` wherever a shard does not hold more already."""
    low, high = 0.0, float(max([total, *used], default=0) + total + 1)
    for _ in range(200):
        level = (low + high) / 2
        got = sum(max(0, math.floor(level * w) - u) for w, u in zip(weights, used, strict=True))
        low, high = (level, high) if got <= total else (low, level)
    out = [max(0, math.floor(low * w) - u) for w, u in zip(weights, used, strict=True)]
    ends = [k for _, k in sorted((u + o, k) for k, (u, o, w) in enumerate(zip(used, out, weights, strict=True)) if w)]
    rest = total - sum(out)
    for turn, k in enumerate(ends):
        share = rest // (len(ends) - turn)
        share += rest % (len(ends) - turn) > 0
        out[k] += share
        rest -= share
    return out


def plan(old: list[list[Block]], singles: list[tuple[int, int, int, int]], weights: Sequence[int], cost: np.ndarray | None = None) -> Plan:
    """``old``: the blocks of each old shard, without those of large rows; ``singles``: (shard,
    block, row, size) of these; ``weights``: what each new shard should hold, in proportion."""
    n, m = len(old), len(weights)
    total = sum(b.bytes for blocks in old for b in blocks) + sum(s[3] for s in singles)
    wanted, used = even(total, [0] * m, weights), [0] * m
    cost = np.ones((n, m), np.int64) - np.eye(n, m, dtype=np.int64) if cost is None else np.asarray(cost)
    placed, moving, moved = {}, [], 0
    for shard, block, row, size in sorted(singles, key=lambda s: (-s[3], s)):
        if shard < m and weights[shard] and (used[shard] == 0 or used[shard] + size <= wanted[shard]):
            placed[block, row] = shard
            used[shard] += size
        else:
            moving.append((shard, block, row, size))
    for shard, block, row, size in moving:
        to = max((k for k in range(m) if weights[k]), key=lambda k: (wanted[k] - used[k], -cost[shard][k], -k))
        placed[block, row] = to
        used[to] += size
        moved += size * (to != shard)
    supply = [sum(b.bytes for b in blocks) for blocks in old]
    flow = transport(supply, even(sum(supply), used, weights), cost)
    moves, splits = {}, {}
    for i, blocks in enumerate(old):
        quotas = sorted(([j, x] for (k, j), x in flow.items() if k == i), key=lambda q: (q[0] != i, q[0]))
        moved += sum(x for j, x in quotas if j != i)
        for b in blocks:
            parts, need = {}, b.bytes
            while need:
                j, x = quotas[0]
                took = min(need, x)
                parts[j] = parts.get(j, 0) + took
                need -= took
                quotas[0][1] -= took
                if not quotas[0][1]:
                    quotas.pop(0)
            if len(parts) == 1:
                moves[b.ident] = next(iter(parts))
            else:
                splits[b.ident] = parts
    return Plan(flow, moves, splits, placed, moved)


def deal(sizes: np.ndarray, quotas: dict[int, int]) -> np.ndarray:
    """The shard of each row of a block: from the largest row to the smallest, to the shard
    that lacks most."""
    heap = [(-q, j) for j, q in sorted(quotas.items())]
    heapq.heapify(heap)
    out = np.zeros(len(sizes), np.int32)
    for k in np.argsort(-sizes, kind="stable").tolist():
        lacks, j = heap[0]
        out[k] = j
        heapq.heapreplace(heap, (lacks + int(sizes[k]), j))
    return out


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("bigint") + ROW_BYTES


def by_key(ident: Column, shards: int) -> Column:
    """A shard by a hash of the id."""
    return F.pmod(F.xxhash64(ident), F.lit(shards)).cast("int")


def _write(rows: DataFrame, label: str, tasks: int) -> str:
    """One file a block: all rows of a block are in one task."""
    path = fresh_path(rows.sparkSession, label)
    rows.repartition(tasks, "block").write.option("maxRecordsPerFile", 0).partitionBy("block").parquet(path)
    return path


def _tasks(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BLOCK_BYTES))


def _measured(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """``(block, rows, bytes)``: one row a block, from the column of sizes alone."""
    found = spark.read.schema("size bigint, block int").parquet(path).groupBy("block").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    return [(r["block"], r["rows"], r["bytes"]) for r in found.collect()]


def lay_out(docs: DataFrame, shards: int, shard: Column | None = None, text: str = "text", ident: str = "doc_id", later: int | None = None) -> Layout:
    """Writes a table as blocks of ``shards`` shards; ``shard`` is by hash of the id if not
    given. ``later``: how many shards it will have, which decides what a large row is."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size_of(F.col(text)).alias("size"), (by_key(F.col(ident), shards) if shard is None else shard).alias("shard"))
    known = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    total, schema = sum(known.values()), rows.schema["row"].dataType.simpleString()
    if not total:
        return Layout(spark, [_write(rows.select("row", "size", F.lit(0).alias("block")), "shards", 1)], [], schema)
    limit = max(LARGE * ROW_BYTES, total // (max(shards, later or 0) * LARGE))
    target = max(min(BLOCK_BYTES, total // (shards * BLOCKS_A_SHARD)), total // (MOST_BLOCKS - shards * 2), LEAST_BYTES)
    counts = [max(1, math.ceil(known.get(k, 0) / target)) for k in range(shards)]
    firsts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    place = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("shard"))
    hashed = F.pmod(F.xxhash64(F.col(f"row.`{ident}`"), F.col(f"row.`{text}`")), place(counts))
    block = F.when(F.col("size") > limit, F.lit(firsts[-1]) + F.col("shard")).otherwise(place(firsts) + hashed).cast("int")
    path = _write(rows.select("row", "size", block.alias("block")), "shards", _tasks(spark, total))
    owner = [k for k, n in enumerate(counts) for _ in range(n)] + list(range(shards))
    blocks = [Block(b, owner[b], n, x) for b, n, x in _measured(spark, path)]
    return Layout(spark, [path], sorted(blocks, key=lambda b: b.ident), schema, {b.ident for b in blocks if b.ident >= firsts[-1]})


def reshard(layout: Layout, weights: Sequence[int], cost: np.ndarray | None = None) -> tuple[Layout, Plan]:
    """The layout with a shard for each weight, and what was moved. Shards hold bytes in
    proportion to weights as near as rows allow; a weight of 0 empties a shard."""
    spark = layout.spark
    small_batches(spark)
    if not sum(weights) > 0:
        raise ValueError("some shard must have a weight")
    old = [[] for _ in range(max([b.shard for b in layout.blocks], default=-1) + 1)]
    by_id = {b.ident: b for b in layout.blocks}
    for b in layout.blocks:
        if b.ident not in layout.large:
            old[b.shard].append(b)
    singles = []
    if layout.large:  # at most LARGE rows a shard
        found = layout.files().where(F.col("block").isin(sorted(layout.large))).select("block", "size", "at").collect()
        singles = [(by_id[r["block"]].shard, r["block"], r["at"], r["size"]) for r in found]
    made = plan(old, singles, weights, cost)
    pieces, blocks, large = {}, [], set()
    number = max(by_id, default=-1) + 1
    ends: dict[int, set[int]] = {}
    for (block, _), to in made.singles.items():
        ends.setdefault(block, set()).add(to)
    for b in layout.blocks:
        targets = ends.get(b.ident) or made.splits.get(b.ident) or {made.moves[b.ident]}
        if len(targets) == 1:
            blocks.append(Block(b.ident, next(iter(targets)), b.rows, b.bytes))
            large |= {b.ident} & layout.large
            continue
        for to in sorted(targets):
            pieces[b.ident, to] = number
            large |= {number} if b.ident in layout.large else set()
            number += 1
    if not pieces:
        return Layout(spark, layout.paths, blocks, layout.schema, large), made
    shared = spark.sparkContext.broadcast((made.splits, made.singles, pieces))  # arcs and large rows: bounded by shards
    affected = sorted({b for b, _ in pieces})

    def split(key: tuple, group: pa.Table) -> pa.Table:
        splits, one_by_one, new = shared.value
        block, group = key[0].as_py(), group.sort_by("at")
        if block in splits:
            to = deal(group.column("size").to_numpy(), splits[block])
        else:
            to = [one_by_one[block, at] for at in group.column("at").to_pylist()]
        return pa.table({"row": group.column("row"), "size": group.column("size"), "block": pa.array([new[block, int(t)] for t in to], pa.int32())})

    written = layout.files().where(F.col("block").isin(affected)).groupBy("block").applyInArrow(split, f"row {layout.schema}, size bigint, block int")
    path = _write(written, "shards", _tasks(spark, sum(by_id[b].bytes for b in affected)))
    owner = {n: to for (_, to), n in pieces.items()}
    blocks += [Block(b, owner[b], n, x) for b, n, x in _measured(spark, path)]
    return Layout(spark, [*layout.paths, path], sorted(blocks, key=lambda b: b.ident), layout.schema, large), made
