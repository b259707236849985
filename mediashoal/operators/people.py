"""People and faces: counts, listings, identification by face vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.functions.vectors import cosine_to
from mediashoal.operators import pivots
from mediashoal.schemas import FACE_THRESHOLD
from mediashoal.storage import materialize

#: New faces whose scores are in memory at once.
CHUNK = 512


def list_people(people: DataFrame, faces: DataFrame) -> DataFrame:
    """Each person with the number of faces, zero included, by name. Faces are counted
    before the join, so it moves one row a person."""
    counts = faces.groupBy("person_id").agg(F.count("*").alias("face_count"))
    joined = people.join(counts, people["id"] == counts["person_id"], "left")
    return joined.select("id", "name", "created_at", F.coalesce("face_count", F.lit(0)).cast("bigint").alias("face_count")).orderBy("name", "id")


def list_faces(faces: DataFrame, people: DataFrame, media_item_id: int | None = None, person_id: int | None = None) -> DataFrame:
    rows = faces
    if media_item_id is not None:
        rows = rows.where(F.col("media_item_id") == media_item_id)
    if person_id is not None:
        rows = rows.where(F.col("person_id") == person_id)
    names = people.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return rows.join(names, "person_id", "left")


def named_faces(faces: DataFrame, vector: str = "vector") -> DataFrame:
    return faces.where(F.col("person_id").isNotNull()).select(F.col("id").alias("named_id"), "person_id", F.col(vector).alias("named_vector"))


BEST = "id bigint, person_id bigint, named_id bigint, score double"


def best_person(new_faces: DataFrame, named: DataFrame, threshold: float = FACE_THRESHOLD, block_rows: int | None = None, met: list[pivots.Met] | None = None, cell_rows: int | None = None) -> DataFrame:
    """``(id, person_id, score)``: for each new face the best named face at or over the
    threshold; of scores equal to 12 places the lowest face id wins.

    Named faces live in cells around pivots. A first pass gives each new face the best of
    the nearest cell, a lower bound; a second takes it only to those cells whose bounds
    allow as good a score. One row a new face leaves each tile. Equal vectors of either
    side are compared once. Vectors of different sizes are never compared; those without a
    direction or with numbers that are not finite match none.
    """
    spark = new_faces.sparkSession
    left = pivots.members(new_faces.where(pivots.directed(F.col("vector"))))
    left = materialize(left.withColumn("v", F.col("v").cast("array<double>")), "new-faces")
    ok = named.where(pivots.directed(F.col("named_vector"))).select(F.col("named_id").cast("bigint").alias("id"), F.col("person_id").cast("bigint").alias("person_id"), F.col("named_vector").cast("array<double>").alias("v"))
    right = materialize(ok.groupBy("v").agg(F.min_by("person_id", "id").alias("person_id"), F.min("id").alias("id")).select("id", "v", "person_id"), "named-faces")
    once = left.where("id = first").select("id", "v", F.lit(None).cast("bigint").alias("person_id"))
    most = float(np.arccos(np.clip(threshold, -1, 1)))

    def kernel(visitors: pa.Table, home: pa.Table) -> pa.Table:
        home = home.sort_by("id")  # so that the first maximum is the lowest id
        there, persons = home.column("id").to_numpy(), home.column("person_id").to_numpy()
        x, y = pivots.unit(pivots.matrix(visitors.column("v"))), pivots.unit(pivots.matrix(home.column("v")))
        best, top = np.zeros(len(x), np.int64), np.zeros(len(x))
        for first in range(0, len(x) if len(y) else 0, CHUNK):
            scores = x[first : first + CHUNK] @ y.T
            at = np.round(scores, 12).argmax(1)
            best[first : first + CHUNK], top[first : first + CHUNK] = at, scores[np.arange(len(at)), at]
        if not len(y):
            visitors, best, top = visitors.slice(0, 0), best[:0], top[:0]
        return pa.table({"id": visitors.column("id"), "person_id": persons[best], "named_id": there[best], "score": top})

    nearest = lambda a, more, cells: np.arange(a.shape[1])[None] == a.argmin(1)[:, None]

    def open_ones(a: np.ndarray, more: dict[str, np.ndarray], cells: pivots.Cells) -> np.ndarray:
        reach = np.minimum(np.arccos(np.clip(more["lower"], -1, 1)), most) + pivots.SLACK
        return (cells.least(a) <= reach[:, None]) & (np.arange(a.shape[1])[None] != a.argmin(1)[:, None])

    one = lambda rows: rows.groupBy("id").agg(F.max_by(F.struct("person_id", "named_id", "score"), F.struct(F.round("score", 12), -F.col("named_id"))).alias("b")).select("id", "b.*")
    found = []
    sizes = {r["size"]: r["n"] for r in right.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()}
    for size, n in sizes.items():
        chosen = pivots.choose(right.where(F.size("v") == size), pivots.pivots_for(n, cell_rows))
        home = materialize(pivots.assign(right.where(F.size("v") == size), chosen), "named-cells")
        cells, faces, counts = pivots.cells_of(home, chosen), once.where(F.size("v") == size), [pivots.Met(), pivots.Met()]
        first = one(pivots.meet(home, pivots.visits(faces, cells, nearest), kernel, BEST, block_rows, counts[0])).select("id", "person_id", "named_id", "score")
        if len(chosen) > 1:
            first = materialize(first, "first-best")
            bounded = materialize(faces.join(first.select("id", F.col("score").alias("lower")), "id"), "bounded")
            found.append(pivots.meet(home, pivots.visits(bounded, cells, open_ones, ("lower",)).drop("lower"), kernel, BEST, block_rows, counts[1]))
        found.append(first)
        if met is not None:
            met += counts
    rows = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], BEST)
    best = one(rows.where(F.col("score") >= threshold)).withColumnRenamed("id", "first")
    kind = new_faces.schema["id"].dataType
    return left.select("id", "first").join(best, "first").select(F.col("id").cast(kind).alias("id"), "person_id", "score")


def best_person_for(vector: list[float], named: DataFrame, threshold: float = FACE_THRESHOLD) -> DataFrame:
    """For one vector: a scan and a top-1."""
    scored = named.withColumn("score", cosine_to(F.col("named_vector"), vector)).where(F.col("score") >= threshold)
    return scored.orderBy(F.col("score").desc(), "named_id").limit(1).select("person_id", "score")


def propagate(faces: DataFrame, seed: list[float], own_media: int, threshold: float = FACE_THRESHOLD) -> DataFrame:
    """``(id, score)`` of unnamed faces on other media that are like the seed."""
    other = faces.where(F.col("person_id").isNull() & (F.col("media_item_id") != own_media))
    return other.withColumn("score", cosine_to(F.col("vector"), seed)).where(F.col("score") >= threshold).select("id", "score")
