"""Connected components of an edge table, without collecting any part of it.

Alternating large-star and small-star steps (Kiveris et al., SoCC 2014): each
round groups edges by node with map-side combined minima only, so a node of very
high degree never becomes a group inside one task, and the number of rounds is
logarithmic in the longest chain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.storage import fresh_path, materialize, release


def spanning_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for the edges that one task holds."""
    label = np.arange(n)
    while len(i):
        old = label.copy()
        low = np.minimum(label[i], label[j])
        for at in (i, j, old[i], old[j]):
            np.minimum.at(label, at, low)
        label = label[label]
        if (label == old).all():
            break
    return label


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Each node is the end of one edge, or a centre and no end."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("end"), F.lit(0).alias("centre"))
    both = ends.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("end").alias("end"), F.sum("centre").alias("centre"))
    return both.where("end > 1 or (end > 0 and centre > 0)").isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` for every node of an edge; component = least node.

    Self-loops give their node a component; edges with a null end are left out;
    direction and repeats do not matter. An empty edge table gives no rows.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("node"))
    path = fresh_path(spark, "cc")
    pairs = materialize(
        ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", path
    )
    for _ in range(max_rounds):
        if _is_stars(pairs):
            break
        old, path = path, fresh_path(spark, "cc")
        pairs = materialize(_small_star(_large_star(pairs)), "cc", path)
        release(spark, old)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().join(found.select("node").unionAll(roots.select("node")).distinct(), "node", "left_anti")
    return found.unionAll(roots).unionAll(alone.select("node", F.col("node").alias("component")))
