"""Exact and visual duplicate groups, and which file of a group to keep.

Groups are tables of members, so that a group of any size is many rows and no array;
``nested`` makes the record with a list of candidates for groups that fit one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashoal.functions.dates import sort_ts
from mediashoal.operators.ranking import ordered_index
from mediashoal.storage import materialize

#: Largest distances of visual duplicates, whose ahashes are equal.
PHASH_MOST, DHASH_MOST = 6, 8
FAR = 2**63 - 1


def keeper_order() -> Column:
    """Earliest date, most pixels, largest file, first path; no date comes last."""
    return F.struct(
        F.coalesce(sort_ts(), F.lit(FAR)).alias("date"),
        (-F.coalesce(F.col("width") * F.col("height"), F.lit(0))).alias("pixels"),
        (-F.coalesce("size_bytes", F.lit(0))).alias("size"),
        F.col("path"),
    )


def keepers(members: DataFrame, group: str) -> DataFrame:
    """``(group, n, keep_path, group_bytes)`` by one combined aggregate."""
    return members.groupBy(group).agg(F.count("*").alias("n"), F.min_by("path", keeper_order()).alias("keep_path"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("group_bytes"))


def exact_groups(files: DataFrame, digest: str = "sha256") -> DataFrame:
    """``(digest, n, keep_path, group_bytes)`` of digests that two files or more have."""
    return keepers(files.where(F.col(digest).isNotNull()), digest).where("n > 1")


def exact_members(files: DataFrame, digest: str = "sha256") -> DataFrame:
    groups = exact_groups(files, digest)
    return files.join(groups, digest).withColumn("is_keeper", F.col("path") == F.col("keep_path"))


def numbered(groups: DataFrame, kind: str) -> DataFrame:
    """With ids ``exact-1``, ``exact-2``... by the path that is kept."""
    out = ordered_index(groups, "keep_path", name="number")
    return out.withColumn("group_id", F.concat(F.lit(f"{kind}-"), (F.col("number") + 1).cast("string"))).drop("number")


def nested(members: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A row a group with its candidates, by path; for groups that fit a row."""
    return members.groupBy(group, "keep_path").agg(F.array_sort(F.collect_list(F.struct("path", *[c for c in columns if c != "path"]))).alias("candidates"))


READABLE = "^[0-9a-fA-F]{1,16}$"


def print_classes(prints: DataFrame) -> DataFrame:
    """``(ahash, p, d, first, files)`` of files with three equal, readable hashes; the
    first path stands for all. Hashes that can't be read are near no other."""
    value = lambda c: F.conv(c, 16, -10).cast("bigint").alias(c[0])
    rows = prints.where(" and ".join(f"{c} rlike '{READABLE}'" for c in ("ahash", "phash", "dhash")))
    return rows.select("path", "ahash", value("phash"), value("dhash")).groupBy("ahash", "p", "d").agg(F.min("path").alias("first"), F.count("*").alias("files"))


def visual_pairs(prints: DataFrame) -> DataFrame:
    """``(path_a, path_b, score)`` of the classes with one ahash and near other hashes, by
    their first paths; ``print_classes`` has the membership.

    Two phashes within PHASH_MOST bits agree on one of PHASH_MOST + 1 blocks, so classes
    meet in buckets of (ahash, block); a pair counts in the first block it agrees on.
    """
    near = _near(print_classes(prints).select("ahash", "p", "d", F.col("first").alias("at")))
    return near.select(F.col("a").alias("path_a"), F.col("b").alias("path_b"), "score")


def _near(earlier: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """``(a, b, score)``: the ``at`` of near classes of one ahash, a before b; of one table or,
    with ``later``, of two. Columns ahash, p, d, at."""
    n = PHASH_MOST + 1
    masks = [sum(1 << b for b in range(k, 64, n)) for k in range(n)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), F.col("p").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])
    dealt = [x.select("ahash", "p", "d", "at", F.explode(blocks).alias("b")).select("ahash", "p", "d", "at", "b.k", "b.bits") for x in (earlier, earlier if later is None else later)]
    both = dealt[0].alias("a").join(dealt[1].alias("b"), ["ahash", "k", "bits"]).where("a.at < b.at")
    differ = F.col("a.p").bitwiseXOR(F.col("b.p"))
    before = F.lit(False)
    for k, m in enumerate(masks[:-1]):
        before = before | ((F.col("k") > k) & (differ.bitwiseAND(F.lit(m)) == 0))
    near = both.where(~before).select(F.col("a.at").alias("a"), F.col("b.at").alias("b"), F.bit_count(differ).alias("x"), F.bit_count(F.col("a.d").bitwiseXOR(F.col("b.d"))).alias("y"))
    return near.where((F.col("x") <= PHASH_MOST) & (F.col("y") <= DHASH_MOST)).select("a", "b", (F.col("x") + F.col("y")).alias("score"))


def greedy(p: np.ndarray, d: np.ndarray, files: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor grouping of classes in order of path: each free class takes the free ones
    near it. Gives indexes of taken classes and anchors, anchors' indexes, and scores:
    the largest distance in the group. Only groups of two files or more.
    """
    free, taken, anchors, scores = np.arange(len(p)), [], [], []
    while len(free):
        i, rest = free[0], free[1:]
        x, y = np.bitwise_count(p[rest] ^ p[i]).astype(np.int32), np.bitwise_count(d[rest] ^ d[i])
        near = (x <= PHASH_MOST) & (y <= DHASH_MOST)
        hit = rest[near]
        if len(hit) or files[i] > 1:
            taken.append(np.concatenate([[i], hit]))
            anchors.append(np.full(len(hit) + 1, i))
            scores.append(np.full(len(hit) + 1, (x[near] + y[near]).max(initial=0)))
        free = rest[~near]
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (taken, anchors, scores))


#: Classes of one ahash that a task groups at once.
BUCKET_ROWS = 1 << 16
FOUND = "first string, anchor string, score int"


def _grouped(rows: DataFrame) -> DataFrame:
    """``greedy`` over the classes of each ahash, at most BUCKET_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for classes in batch.column(0):
                own = pa.table(classes.values.flatten(), ["first", "p", "d", "files"]).sort_by("first")
                p, d, files = (own.column(c).to_numpy() for c in ("p", "d", "files"))
                taken, anchors, scores = greedy(p.view(np.uint64), d.view(np.uint64), files)
                names = own.column("first").combine_chunks()
                yield pa.RecordBatch.from_arrays([names.take(pa.array(taken)), names.take(pa.array(anchors)), pa.array(scores.astype(np.int32))], ["first", "anchor", "score"])

    lists = rows.groupBy("ahash").agg(F.collect_list(F.struct("first", "p", "d", "files")).alias("classes"))
    return lists.select("classes").mapInArrow(run, FOUND)


def _taken(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``(b)``: classes that an earlier anchor takes, by rounds over ``(a, b)``, a before b.

    A class without an earlier undecided one near it is an anchor; what is near an anchor
    and later is taken, so is no anchor and holds back none. All that can be decided is
    decided in a round, so rounds are as many as the longest chain of such dependencies.
    """
    alive, taken, n = edges.select("a", "b"), edges.select("b").limit(0), 0
    while not alive.isEmpty():
        heads = alive.select("a").distinct().join(alive.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = materialize(alive.join(heads, "a", "left_semi").select("b").distinct(), "taken-now")
        taken, n = taken.unionAll(gone), n + 1
        left = alive.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti")
        alive = materialize(left.join(heads, "a", "left_anti"), "undecided")
    if rounds is not None:
        rounds.append(n)
    return taken


def _hot(rows: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """``greedy`` for an ahash of any number of classes: by stretches in order of path, each
    twice as long as all before it together, so there are as many as the logarithm of the
    classes. The first, of BUCKET_ROWS, is grouped in a task; in a later one, near
    pairs among what is still free decide who is an anchor (``_taken``). Anchors of a stretch
    take from all later ones before the next is looked at, so few pairs are left there.
    ``rounds`` is filled with the rounds of each stretch.
    """
    rows = ordered_index(rows, "ahash", "first", name="at")
    start = rows.groupBy("ahash").agg(F.min("at").alias("start"), F.max("at").alias("end"))
    rows = materialize(rows.join(start, "ahash").withColumn("place", F.col("at") - F.col("start")).drop("start", "end"), "hot-prints")
    last, until, free, found = rows.agg(F.max("place")).first()[0], BUCKET_ROWS, rows.select("ahash", "p", "d", "at", "place", "files"), []

    def first_stretch(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        p, d, at = (group.column(c).to_numpy() for c in ("p", "d", "at"))
        took, anchors, scores = greedy(p.view(np.uint64), d.view(np.uint64), np.full(len(p), 2))  # singles too: each may be an anchor for later ones
        own = np.zeros(len(took), np.int32)
        moved = took != anchors
        own[moved] = scores[moved]
        return pa.table({"a": at[anchors], "b": at[took], "score": own})

    while True:
        own, later = free.where(F.col("place") < until), free.where(F.col("place") >= until)
        if until == BUCKET_ROWS:
            links = materialize(own.select("ahash", "p", "d", "at").groupBy("ahash").applyInArrow(first_stretch, "a bigint, b bigint, score int"), "hot-anchors")
            anchors = own.join(links.where("a = b").select(F.col("a").alias("at")), "at", "left_semi")
        else:
            edges = materialize(_near(own), "hot-edges")
            anchors = own.join(_taken(edges, rounds).select(F.col("b").alias("at")), "at", "left_anti")
            by = edges.join(anchors.select(F.col("at").alias("a")), "a", "left_semi").groupBy("b").agg(F.min_by("score", "a").alias("score"), F.min("a").alias("a"))
            links = materialize(by.select("a", "b", "score").unionAll(anchors.select(F.col("at").alias("a"), F.col("at").alias("b"), F.lit(0))), "hot-anchors")
        found.append(links)
        if until > last:
            break
        more = materialize(_near(anchors, later).groupBy("b").agg(F.min("a").alias("a"), F.min_by("score", "a").alias("score")).select("a", "b", "score"), "hot-taken")
        found.append(more)
        free, until = materialize(later.join(more.select(F.col("b").alias("at")), "at", "left_anti"), "hot-free"), until * 3
    links = reduce(DataFrame.unionAll, found)
    scored = links.groupBy("a").agg(F.max("score").alias("score"), F.count("*").alias("members"))
    names = rows.select("at", "first", "files")
    grouped = links.select("a", "b").join(scored, "a").join(names.select(F.col("at").alias("b"), "first", "files"), "b").join(names.select(F.col("at").alias("a"), F.col("first").alias("anchor")), "a")
    return grouped.where("members > 1 or files > 1").select("first", "anchor", "score")


def visual_members(prints: DataFrame) -> DataFrame:
    """``(path, anchor, score)`` of every file in a visual group.

    Files with three equal hashes are always grouped together, so a bucket has one
    entry for each different pair of the other two hashes: a thousand flat images are
    one entry. The anchor is its group's first path.
    """
    classes = materialize(print_classes(prints), "print-classes")
    counts = materialize(classes.groupBy("ahash").agg(F.count("*").alias("n"), F.sum("files").alias("all")).where("all > 1"), "print-buckets")
    hot = counts.where(F.col("n") > BUCKET_ROWS).select("ahash")
    groups = _grouped(classes.join(counts.where(F.col("n") <= BUCKET_ROWS).select("ahash"), "ahash", "left_semi"))
    if not hot.isEmpty():
        groups = groups.unionAll(_hot(classes.join(hot, "ahash", "left_semi")))
    named = classes.join(groups, "first").select("ahash", "p", "d", "anchor", "score")
    value = lambda c: F.conv(F.when(F.col(c).rlike(READABLE), F.col(c)), 16, -10).cast("bigint")
    rows = prints.select("path", "ahash", value("phash").alias("p"), value("dhash").alias("d"))
    return rows.join(named, ["ahash", "p", "d"]).select("path", "anchor", "score")
