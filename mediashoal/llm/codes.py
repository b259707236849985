"""Product-quantised vector codes by a Lloyd iteration that is kept up by differences.

Each component becomes the integer ``floor(4096 * x)``; vectors are cut into ``PARTS`` equal
parts, each with a codebook of ``ENTRIES`` entries that begins as that part of the vectors
with the smallest ids. A round assigns every part to the nearest entry (squared Euclidean
distance, of equal ones the lowest index) and moves each entry to the floor of its parts'
mean; an entry without parts stays.

Between rounds a table keeps each vector with its assignments, and the driver keeps the
running sum and count of each entry, as whole numbers of any size. A round reads the table
once, writes the new assignments, and of parts whose assignment changed, and only of
these, adds their components to the new entry and takes them from the old one. These
differences are summed in each task, at most two rows' worth for an entry, so what is
shuffled is a bounded number of rows a task, and little but the first time; vectors are
never shuffled. Codebooks are ``PARTS * ENTRIES`` short vectors whatever the input's size,
and all sums are of integers, so results do not depend on the order of rows.

Left out: vectors that are null or have null or non-finite components. Vectors of
another size than the first kept one (of the smallest id, whose size is a multiple of
``PARTS`` and not 0), or with components of 2**15 and more, take no part in codebooks and
come back without a code or error. A null id comes last in order; vectors of one id are
ordered by components. With under ``ENTRIES`` vectors, codebooks are shorter. Labels are
summed wherever their rows are; rows without a label together. Other columns are not
used, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashoal.storage import fresh_path, materialize, release, small_batches

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components beyond this (as integers) are not taken, so that distances fit 64 bits.
MOST = 1 << 27
#: Labels up to which their sums are sent to all executors.
FEW_LABELS = 100_000
STATE = "vec_id {id}, label {label}, ints array<int>, codes array<tinyint>, part int, entry int, n bigint, sums array<bigint>"


@dataclass
class Codebooks:
    """``entries``: (PARTS, entries, components of a part) as integers."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's entry, both (rows, PARTS)."""
        parts, _, width = self.entries.shape
        own = ints.reshape(len(ints), parts, width)
        codes, far = np.zeros((len(ints), parts), np.int8), np.zeros((len(ints), parts), np.int64)
        for p in range(parts):
            apart = own[:, p, None, :] - self.entries[p][None]
            squares = np.einsum("rew,rew->re", apart, apart)
            codes[:, p] = squares.argmin(1)
            far[:, p] = squares[np.arange(len(ints)), codes[:, p]]
        return codes, far


def integers(vector: Column) -> Column:
    """Floors of the scaled components; null if any is too large."""
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) < MOST / SCALE)
    return F.when(small, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def kept(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, ints)`` of vectors whose components are all finite numbers."""
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & whole)
    return rows.select(F.col(ident).alias("vec_id"), F.col(label).alias("label"), integers(F.col(vector)).alias("ints"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one size as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _fitting(rows: DataFrame, dimension: int) -> Column:
    return F.col("ints").isNotNull() & (F.size("ints") == dimension)


def first_codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> Codebooks | None:
    """From the first vectors by id; None if there are none."""
    usable = rows.where(F.col("ints").isNotNull() & (F.size("ints") > 0) & (F.size("ints") % parts == 0))
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints").alias("n")).first()
    if first is None:
        return None
    head = usable.where(F.size("ints") == first["n"]).orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    found = np.array([r["ints"] for r in head], np.int64)
    return Codebooks(np.ascontiguousarray(found.reshape(len(found), parts, -1).transpose(1, 0, 2)))


def _round(state: DataFrame, books: Codebooks) -> DataFrame:
    """Rows with their new assignments, and the differences of sums that these make, as
    rows of (part, entry, n, sums) without a vector."""
    shared = state.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, sums, schema = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64), None
        for batch in batches:
            schema = batch.schema
            ints = _matrix(batch.column("ints"), parts * width)
            was = _matrix(batch.column("codes"), parts)
            codes, _ = own.nearest(ints)
            pieces = ints.reshape(-1, parts, width)
            for p in range(parts):
                moved = np.flatnonzero(codes[:, p] != was[:, p])
                gone = moved[was[moved, p] >= 0]
                np.add.at(n[p], codes[moved, p], 1)
                np.add.at(sums[p], codes[moved, p], pieces[moved, p])
                np.subtract.at(n[p], was[gone, p], 1)
                np.subtract.at(sums[p], was[gone, p], pieces[gone, p])
            lists = pa.ListArray.from_arrays(np.arange(0, len(codes) * parts + 1, parts, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([lists if f.name == "codes" else batch.column(f.name) for f in schema], schema.names)
        at = np.argwhere((n != 0) | (sums != 0).any(2))
        if len(at):
            p, e = at.T
            columns = {"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(n[p, e]), "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(at), f.type)) for f in schema], schema.names)

    return state.where("part is null").mapInArrow(run, state.schema)


def _differences(state: DataFrame) -> list:
    """At most one row for each component of each entry."""
    rows = state.where("part is not null")
    flat = rows.select("part", "entry", "n", F.posexplode("sums").alias("k", "x"))
    return flat.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()


@dataclass
class Trained:
    """``state``: ``(vec_id, label, ints, codes)`` as of the last round; ``changed`` counts
    the parts whose assignment changed in each round."""

    books: Codebooks | None
    state: DataFrame
    path: str | None = None
    odd: DataFrame | None = None


def train(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> Trained:
    """Codebooks after so many rounds, with the table that the last round left."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = kept(vectors, ident, vector, label)
    books = first_codebooks(rows, entries, parts)
    if books is None:
        return Trained(None, rows.limit(0), None, rows)
    kind = STATE.format(id=rows.schema["vec_id"].dataType.simpleString(), label=rows.schema["label"].dataType.simpleString())
    empty = {"part": "int", "entry": "int", "n": "bigint", "sums": "array<bigint>"}
    fitting = _fitting(rows, books.dimension)
    state = rows.where(fitting).select("vec_id", "label", "ints", F.array_repeat(F.lit(-1).cast("tinyint"), parts).alias("codes"), *[F.lit(None).cast(t).alias(c) for c, t in empty.items()])
    state = spark.createDataFrame([], kind).unionAll(state)
    width = books.entries.shape[2]
    counts = [[0] * books.entries.shape[1] for _ in range(parts)]
    sums = [[[0] * width for _ in range(books.entries.shape[1])] for _ in range(parts)]
    path = None
    for _ in range(rounds):
        old, path = path, fresh_path(spark, "lloyd")
        state = materialize(_round(state, books), "lloyd", path)
        if old:
            release(spark, old)
        for r in _differences(state):
            sums[r["part"]][r["entry"]][r["k"]] += int(r["x"])
            if r["k"] == 0:
                counts[r["part"]][r["entry"]] += r["n"]
        moved = books.entries.copy()
        for p in range(parts):
            for e, n in enumerate(counts[p]):
                if n:
                    moved[p, e] = [x // n for x in sums[p][e]]
        books = Codebooks(moved)
    return Trained(books, state.where("part is null").select("vec_id", "label", "ints", "codes"), path, rows.where(~F.coalesce(fitting, F.lit(False))))


def encode(trained: Trained) -> DataFrame:
    """``(vec_id, label, codes, code, error)``: assignments to the final codebooks. ``code``
    has two hexadecimal digits a part."""
    schema = {n: trained.odd.schema[n].dataType.simpleString() for n in ("vec_id", "label")}
    ddl = f"vec_id {schema['vec_id']}, label {schema['label']}, codes array<tinyint>, code string, error bigint"
    odd = trained.odd.select("vec_id", "label", F.lit(None).cast("array<tinyint>").alias("codes"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    if trained.books is None:
        return odd
    books = trained.books
    shared = trained.state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts = own.entries.shape[0]
        for batch in batches:
            codes, far = own.nearest(_matrix(batch.column("ints"), own.dimension))
            lists = pa.ListArray.from_arrays(np.arange(0, len(codes) * parts + 1, parts, dtype=np.int32), pa.array(codes.ravel()))
            text = [r.tobytes().hex() for r in codes.view(np.uint8)]
            columns = [batch.column("vec_id"), batch.column("label"), lists, pa.array(text, pa.string()), pa.array(far.sum(1))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "codes", "code", "error"])

    return trained.state.mapInArrow(run, ddl).unionAll(odd)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Also ``label_error``: the errors of each label's rows added up before they meet.
    Sums of few labels go to all executors; more are joined by sorting, where a label of
    very many rows is split by Spark."""
    coded = materialize(coded, "coded")
    sums = materialize(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    found = sums.select(F.col("label").alias("_label"), "label_error")
    found = F.broadcast(found) if found.count() <= FEW_LABELS else found.hint("merge")
    return coded.join(found, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
