"""Vectors in cells around pivots, so that searches and joins by cosine skip what can't match.

The angle between two vectors is a metric, so angles to a few pivots bound the angle
between any two vectors: what lies at ``a`` from a pivot is at least ``|a - b|`` from what lies at
``b``, and a cell whose vectors are at most ``far`` from its pivot is at least ``b - far`` away.

``PivotIndex`` keeps a table of vectors by cells, with the angle of each to its pivot, for
exact top-k searches that read few cells and rows. ``assign`` and ``meet`` do joins: each
vector lives in the cell of its nearest pivot, and visits the cells that its bound lets it.
Cells of any size are met by blocks, so a task holds two blocks at any skew.

Pivots are chosen farthest first among a sample of at most SAMPLE vectors, taken by a hash of
the id; at most PIVOTS of them, so they and the cells' bounds fit each executor. All vectors
are assigned; the choice moves only how much is skipped. Angles carry a slack for rounding.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.functions.vectors import cosine_to, norm
from mediashoal.storage import materialize, small_batches

SAMPLE, PIVOTS = 4096, 1024
#: Rows that a cell should have, and rows of a block: two of these meet in a task.
CELL_ROWS, BLOCK_ROWS = 4096, 16384
#: Radians that rounding may move an angle (of nearly equal vectors: the square root of a rounding).
SLACK = 1e-6
#: Ranges of angles in the condition that reaches the files.
RANGES = 32
#: Cells of an index for vectors without a direction, and of those of another size.
PLAIN, OTHER = -1, -2


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one size as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1))
    return rows / np.where(length > 0, length, 1)[:, None]


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(rows) @ pivots.T, -1, 1))


def directed(v: Column) -> Column:
    """Vectors of finite numbers, not all of them 0."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (norm(v) > 0), F.lit(False))


def choose(rows: DataFrame, n: int, ident: str = "id", vector: str = "v") -> np.ndarray:
    """At most ``n`` unit pivots: the first by hash, then always the one farthest from those so far."""
    sample = rows.select(ident, vector).orderBy(F.xxhash64(ident), ident).limit(SAMPLE).select(vector).collect()
    if not sample:
        return np.zeros((0, 0))
    found = unit(np.array([r[0] for r in sample], np.float64))
    chosen = [0]
    far = np.arccos(np.clip(found @ found[0], -1, 1))
    while len(chosen) < min(n, len(found)) and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.arccos(np.clip(found @ found[chosen[-1]], -1, 1)))
    return found[chosen]


def pivots_for(rows: int, cell_rows: int | None = None) -> int:
    return max(1, min(PIVOTS, math.ceil(rows / (cell_rows or CELL_ROWS))))


def assign(rows: DataFrame, pivots: np.ndarray, vector: str = "v") -> DataFrame:
    """With ``cell``, the nearest pivot, and ``a``, the angle to it."""
    small_batches(rows.sparkSession)
    shared, names = rows.sparkSession.sparkContext.broadcast(pivots), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = angles(matrix(batch.column(vector)), shared.value) if batch.num_rows else np.zeros((0, 1))
            cell = a.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(a)), cell])], [*names, "cell", "a"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, cell int, a double")


@dataclass
class Cells:
    """Bounds of cells; those that hold nothing have no rows."""

    pivots: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def least(self, a: np.ndarray) -> np.ndarray:
        """Least angle to what each cell holds, from angles to pivots."""
        bound = np.maximum(np.maximum(a - self.far, self.near - a), 0)
        return np.where(self.rows > 0, bound, np.inf)


def cells_of(assigned: DataFrame, pivots: np.ndarray) -> Cells:
    """One row a cell leaves the executors."""
    n = len(pivots)
    out = Cells(pivots, np.zeros(n, np.int64), np.zeros(n), np.zeros(n))
    for r in assigned.where("cell >= 0").groupBy("cell").agg(F.count("*").alias("n"), F.min("a").alias("near"), F.max("a").alias("far")).collect():
        out.rows[r["cell"]], out.near[r["cell"]], out.far[r["cell"]] = r["n"], r["near"], r["far"]
    return out


def visits(rows: DataFrame, cells: Cells, wanted: Callable[[np.ndarray, dict[str, np.ndarray], Cells], np.ndarray], more: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` once for each cell that ``wanted`` (angles to pivots, columns ``more``, cells)
    marks for it, as ``visits``."""
    small_batches(rows.sparkSession)
    shared, names = rows.sparkSession.sparkContext.broadcast(cells), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = shared.value
            marked = wanted(angles(matrix(batch.column("v")), own.pivots), {c: batch.column(c).to_numpy(zero_copy_only=False) for c in more}, own)
            at, to = np.nonzero(marked)
            for first in range(0, len(at), 4096):
                part = pa.array(at[first : first + 4096])
                yield pa.RecordBatch.from_arrays([*[c.take(part) for c in batch.columns], pa.array(to[first : first + 4096].astype(np.int32))], [*names, "visits"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, visits int")


#: Cells that were met by visitors, rows at home in them, visitors, and tiles.
@dataclass
class Met:
    cells: int = 0
    at_home: int = 0
    visitors: int = 0
    tiles: int = 0
    shuffled: int = 0


def meet(home: DataFrame, visitors: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int | None = None, met: Met | None = None) -> DataFrame:
    """``kernel(visitors, at home)`` for each cell, by tiles of blocks.

    ``home`` has columns id, v, cell and further ones, ``visitors`` id, v, visits and the same
    further ones. A cell of many rows or visitors is dealt into blocks of both by a hash of
    ids, each block of one against each of the other. ``met`` is filled with counts.
    """
    block = block_rows or BLOCK_ROWS
    spark = home.sparkSession
    there = {r["cell"]: r["n"] for r in home.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    comers = {r["visits"]: r["n"] for r in visitors.groupBy("visits").agg(F.count("*").alias("n")).collect()}
    tiles = [(c, math.ceil(there[c] / block), math.ceil(n / block)) for c, n in comers.items() if c in there]
    if met is not None:
        met.cells, met.at_home, met.visitors = len(tiles), sum(there[c] for c, _, _ in tiles), sum(comers[c] for c, _, _ in tiles)
        met.tiles, met.shuffled = sum(i * j for _, i, j in tiles), sum(there[c] * j + comers[c] * i for c, i, j in tiles)
    plan = F.broadcast(spark.createDataFrame(tiles, "cell int, _own int, _other int"))  # at most PIVOTS rows
    columns = [c for c in home.columns if c not in ("cell", "a")]
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = home.join(plan, "cell").select(*columns, F.lit(True).alias("home"), "cell", part(F.col("_own")).alias("i"), spread(F.col("_other")).alias("j"))
    right = visitors.withColumnRenamed("visits", "cell").join(plan, "cell").select(*columns, F.lit(False).alias("home"), "cell", spread(F.col("_own")).alias("i"), part(F.col("_other")).alias("j"))

    def tile(group: pa.Table) -> pa.Table:
        at_home = group.column("home")
        return kernel(group.filter(pa.compute.invert(at_home)), group.filter(at_home))

    return left.unionAll(right).groupBy("cell", "i", "j").applyInArrow(tile, schema)


# --- searches


@dataclass
class Searched:
    """What a search read: rows scored of rows there are, and cells."""

    scored: int = 0
    rows: int = 0
    cells_read: int = 0
    cells: int = 0


def joined(ranges: list[tuple[float, float]], most: int) -> list[tuple[float, float]]:
    """Sorted ranges that cover the given sorted ones: those that meet are one, then those with
    the least gaps between them, until there are ``most``."""
    apart: list[tuple[float, float]] = []
    for low, high in ranges:
        if apart and low <= apart[-1][1]:
            apart[-1] = (apart[-1][0], max(apart[-1][1], high))
        else:
            apart.append((low, high))
    gaps = sorted(range(1, len(apart)), key=lambda k: apart[k][0] - apart[k - 1][1], reverse=True)
    cuts = [0, *sorted(gaps[: most - 1]), len(apart)]
    return [(apart[i][0], apart[j - 1][1]) for i, j in zip(cuts, cuts[1:])] if apart else []


class PivotIndex:
    """Vectors by cells, in a folder: ``cell=<n>`` sorted by the angle to the pivot, and the
    pivots and bounds in ``cells.json``. Vectors without a direction are always scored;
    those of another size than most of the sample never match and are kept apart."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        made = json.loads(spark.read.text(f"{self.folder}/cells.json", wholetext=True).first()[0])
        self.size, self.plain, self.kinds = made["size"], made["plain"], made["schema"]
        self.cells = Cells(*(np.array(made[k], t) for k, t in (("pivots", float), ("rows", np.int64), ("near", float), ("far", float))))

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, vector: str = "vector", ident: str = "media_item_id", cell_rows: int = CELL_ROWS) -> PivotIndex:
        spark, folder = vectors.sparkSession, folder.rstrip("/")
        ok = vectors.where(directed(F.col(vector)))
        sizes = ok.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "size").first()
        size = sizes["size"] if sizes else 0
        fits = directed(F.col(vector)) & (F.size(vector) == size)
        pivots = choose(ok.where(F.size(vector) == size), pivots_for(sizes["n"], cell_rows) if sizes else 1, ident, vector)
        near = assign(vectors.where(fits), pivots, vector)
        rest = vectors.where(~F.coalesce(fits, F.lit(False))).withColumn("cell", F.when(F.size(vector) == size, F.lit(PLAIN)).otherwise(F.lit(OTHER))).withColumn("a", F.lit(0.0))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a hot cell is dealt over tasks by angle, so its files are ranges of it
        near.unionAll(rest).repartitionByRange(tasks, "cell", "a").sortWithinPartitions("cell", "a").write.partitionBy("cell").parquet(f"{folder}/rows")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", a double, cell int"
        written = spark.read.schema(kinds).parquet(f"{folder}/rows").select("cell", "a")
        cells = cells_of(written, pivots)
        plain = written.where(F.col("cell") == PLAIN).count()
        text = json.dumps({"size": size, "plain": plain, "schema": kinds} | {k: getattr(cells, k).tolist() for k in ("pivots", "rows", "near", "far")})
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/cells.json")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(text.encode())
        out.close()
        return cls(spark, folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.kinds).parquet(f"{self.folder}/rows")

    def within(self, query: list[float], reach: float | None, taken: list[int] | None = None) -> tuple[DataFrame, list[int]]:
        """Rows that may lie within ``reach`` of the query (None: of the cells ``taken``), and
        the cells they are in. Conditions on the partition and on the sorted angle reach the
        files; each cell's own range of angles is joined to what they leave."""
        a = np.arccos(np.clip(self.cells.pivots @ (np.array(query) / np.linalg.norm(query)), -1, 1))
        rows = self.rows()
        if reach is None:
            return rows.where(F.col("cell").isin([PLAIN, *taken])), taken
        read = np.flatnonzero(self.cells.least(a) <= reach).tolist()
        bounds = [(c, float(a[c] - reach), float(a[c] + reach)) for c in read]
        ranges = F.lit(False)  # of all cells read, without the partition, so that these reach the files too
        for low, high in joined(sorted((low, high) for _, low, high in bounds), RANGES):
            ranges = ranges | F.col("a").between(low, high)
        # a table and no condition a cell: hundreds of these, one in the other, are deeper than a plan can be
        own = F.broadcast(self.spark.createDataFrame(bounds, "cell int, _low double, _high double"))  # at most PIVOTS rows
        found = rows.where(F.col("cell").isin(read) & ranges).join(own, "cell").where(F.col("a").between(F.col("_low"), F.col("_high"))).select(rows.columns)
        return (found.unionAll(rows.where(F.col("cell") == PLAIN)) if self.plain else found), read

    def top_k(self, query: list[float], k: int, ident: str = "media_item_id", vector: str = "vector", scope: DataFrame | None = None, where: Column | None = None, searched: Searched | None = None) -> DataFrame:
        """``(ident, score)``: the ``k`` best, ties by id, as a scan of all scores gives. Reads
        the nearest cells until they hold ``k`` rows in scope, then only what the k-th
        score found there leaves open. ``scope``: ids to search in; ``where``: on the rows.
        """

        def scored(rows: DataFrame) -> DataFrame:
            rows = rows if where is None else rows.where(where)
            out = rows.select(ident, cosine_to(F.col(vector), query).alias("score")).where("score is not null")
            return out if scope is None else out.join(scope.select(ident), ident, "left_semi")

        best = lambda rows: scored(rows).orderBy(F.col("score").desc(), ident).limit(k)
        length = float(np.linalg.norm(query))
        if len(query) != self.size or not len(self.cells.pivots) or not length > 0 or not math.isfinite(length):
            return best(self.rows())
        a = np.arccos(np.clip(self.cells.pivots @ (np.array(query) / length), -1, 1))
        order, need, reach = np.argsort(np.where(self.cells.rows > 0, a, np.inf), kind="stable"), k, None
        filled = int((self.cells.rows > 0).sum())
        while reach is None:
            first = int(np.searchsorted(np.cumsum(self.cells.rows[order]), need)) + 1
            found = best(self.within(query, None, order[: min(first, filled)].tolist())[0]).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            if found["n"] >= k and found["least"] == found["least"]:
                reach = float(np.arccos(np.clip(found["least"], -1, 1))) + SLACK
            elif first >= filled:
                reach = math.pi + SLACK
            need *= 4
        rows, read = self.within(query, reach)
        if searched is not None:
            searched.scored, searched.rows = rows.count(), int(self.cells.rows.sum()) + self.plain
            searched.cells_read, searched.cells = len(read), filled
        return best(rows)


def members(vectors: DataFrame, ident: str = "id", vector: str = "vector") -> DataFrame:
    """``(id, v, first)``: equal vectors are one class, whose least id stands for it."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"))
    first = rows.groupBy("v").agg(F.min("id").alias("first"))
    return rows.join(first, "v").select("id", "v", "first")


def classes(vectors: DataFrame, ident: str = "id", vector: str = "vector") -> DataFrame:
    """``(id, v, times)`` of one vector of each class, those with a direction, written once."""
    rows = vectors.where(F.col(vector).isNotNull() & directed(F.col(vector))).select(F.col(ident).cast("bigint").alias("id"), F.col(vector).alias("v"))
    return materialize(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("times")).select("id", "v", "times"), "vector-classes")
