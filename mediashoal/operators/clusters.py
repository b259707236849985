"""Clusters of similar vectors: an exact self-join in cells around pivots, then components.

Equal vectors are one class from the start, so a vector that a third of all rows share is
compared once. A class visits only the cells whose bounds allow a match (``pivots``), and of
two cells one visits the other; tiles of blocks are multiplied as matrices, so a task
holds two blocks whatever the table's size. Only pairs at or over the threshold leave a
task, and for clusters only a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.operators import pivots
from mediashoal.operators.graph import connected_components, spanning_labels
from mediashoal.operators.ranking import ordered_index
from mediashoal.schemas import FACE_THRESHOLD
from mediashoal.storage import materialize

PAIR = "a bigint, b bigint, score double"
#: Visitors whose scores are in memory at once.
CHUNK = 512


def _met(rows: DataFrame, threshold: float, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int | None, met: list[pivots.Met] | None, cell_rows: int | None, more: tuple[str, ...] = ()) -> DataFrame:
    """``kernel(visitors, at home)`` over classes (id, v and ``more``), so that two that may match meet once."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + pivots.SLACK

    def wanted(a: np.ndarray, own: dict[str, np.ndarray], cells: pivots.Cells) -> np.ndarray:
        cell = own["own"][:, None]
        other = np.arange(a.shape[1])[None]
        # also at least half the difference of the angles to both pivots, as the other is nearer to its own
        reached = (cells.least(a) <= reach) & ((a - own["a"][:, None]) / 2 <= reach)
        return (cell == other) | (reached & ((cell < other) == ((cell + other) % 2 == 0)))

    made = []
    for r in rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect():
        same_size = rows.where(F.size("v") == r["size"]).select("id", "v", *more)
        chosen = pivots.choose(same_size, pivots.pivots_for(r["n"], cell_rows))
        home = materialize(pivots.assign(same_size, chosen).withColumn("own", F.col("cell")), "cells")
        visitors = pivots.visits(home.drop("cell"), pivots.cells_of(home, chosen), wanted, ("own", "a")).drop("a")
        counts = pivots.Met()
        made.append(pivots.meet(home.select("id", "v", *more, "own", "cell"), visitors, kernel, schema, block_rows, counts))
        if met is not None:
            met.append(counts)
    return reduce(DataFrame.unionAll, made) if made else rows.sparkSession.createDataFrame([], schema)


def similar_pairs(vectors: DataFrame, threshold: float = FACE_THRESHOLD, ident: str = "id", vector: str = "vector", block_rows: int | None = None, forest: bool = False, met: list[pivots.Met] | None = None, cell_rows: int | None = None) -> DataFrame:
    """``(a, b, score)`` with a < b and cosine at or over the threshold (over zero), between the
    least ids of equal vectors; ``pivots.members`` has the membership. Vectors of different
    sizes, without a direction or with numbers that are not finite match none.

    With ``forest``, of each tile a spanning forest of such pairs: each id with the least
    one of its component there, whose own score may be lower (and is not given).
    """
    def kernel(visitors: pa.Table, home: pa.Table) -> pa.Table:
        ids, there, own = visitors.column("id").to_numpy(), home.column("id").to_numpy(), visitors.column("own").to_numpy()
        x, y = pivots.unit(pivots.matrix(visitors.column("v"))), pivots.unit(pivots.matrix(home.column("v")))
        same, found = home.column("own").to_numpy(), []
        for first in range(0, len(x), CHUNK):
            scores = x[first : first + CHUNK] @ y.T
            i, j = np.nonzero(scores >= threshold)
            s, i = scores[i, j], i + first
            keep = (own[i] != same[j]) | (ids[i] < there[j])
            i, j, s = i[keep], j[keep], s[keep]
            a, b = np.minimum(ids[i], there[j]), np.maximum(ids[i], there[j])
            if forest:
                known, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = spanning_labels(len(known), where[: len(a)], where[len(a) :])
                moved = np.flatnonzero(label != np.arange(len(known)))
                a, b, s = known[label[moved]], known[moved], np.full(len(moved), np.nan)
            found.append((a, b, s))
        a, b, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "score": s})

    return _met(pivots.classes(vectors, ident, vector), threshold, kernel, PAIR, block_rows, met, cell_rows)


def links(vectors: DataFrame, threshold: float = FACE_THRESHOLD, ident: str = "id", vector: str = "vector", block_rows: int | None = None, cell_rows: int | None = None) -> DataFrame:
    """``(id, class_id, n_links)``, one row for each row: the least id of its equal vectors,
    and how many other rows have a cosine at or over the threshold, equal ones among them.

    Tiles count their pairs and give one row for each class, so what leaves them grows with
    the classes and not with the pairs. Vectors that are null, without a direction or with
    numbers that are not finite are classes of their own (``class_id`` is their id), without
    links; vectors of different sizes are not linked. Vectors that only rows with a null
    id have are left apart: a null class, no links. Ids that are there twice count as rows. An empty table gives no rows.
    """
    rows = pivots.classes(vectors, ident, vector).where("id is not null")

    def kernel(visitors: pa.Table, home: pa.Table) -> pa.Table:
        ids, there = visitors.column("id").to_numpy(), home.column("id").to_numpy()
        own, same = visitors.column("own").to_numpy(), home.column("own").to_numpy()
        weight, other = visitors.column("times").to_numpy().astype(np.float64), home.column("times").to_numpy().astype(np.float64)
        x, y = pivots.unit(pivots.matrix(visitors.column("v"))), pivots.unit(pivots.matrix(home.column("v")))
        left, right = np.zeros(len(x)), np.zeros(len(y))
        for first in range(0, len(x), CHUNK):
            part = slice(first, first + CHUNK)
            scores = x[part] @ y.T
            hit = scores >= threshold
            hit &= (own[part, None] != same[None]) | (ids[part, None] < there[None])
            np.copyto(scores, hit)
            left[part] = scores @ other
            right += weight[part] @ scores
        n, named = np.concatenate([left, right]).astype(np.int64), np.concatenate([ids, there])
        return pa.table({"id": named[n > 0], "n": n[n > 0]})

    counted = _met(rows, threshold, kernel, "id bigint, n bigint", block_rows, None, cell_rows, ("times",)).groupBy("id").agg(F.sum("n").alias("n"))
    of_class = rows.join(counted, "id", "left").select("v", F.col("id").alias("class_id"), (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    every = vectors.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"))
    alone = every.where(~pivots.directed(F.col("v"))).select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return every.where(pivots.directed(F.col("v"))).join(of_class, "v", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")).unionAll(alone)


def clusters(vectors: DataFrame, threshold: float = FACE_THRESHOLD, ident: str = "id", vector: str = "vector") -> DataFrame:
    """``(id, component, cluster_id)``; cluster ids from 0 by first id."""
    edges = similar_pairs(vectors, threshold, ident, vector, forest=True)
    found = connected_components(edges, "a", "b")
    ids = vectors.select(F.col(ident).cast("bigint").alias("id"))
    own = pivots.members(vectors.where(pivots.directed(F.col(vector))), ident, vector).select("id", "first")
    linked = own.join(found, own["first"] == found["node"], "left").select("id", F.coalesce("component", "first").alias("component"))
    named = materialize(ids.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "clustered")
    numbers = ordered_index(named.select("component").distinct(), "component", name="cluster_id")
    return named.join(numbers, "component").select("id", "component", "cluster_id")
