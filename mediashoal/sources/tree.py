"""Folder trees: digests folded from the leaves up, and listings that go only where something changed.

A folder's digest is a sum of the hashes of what it holds (four sums of 60 bits, hashed
again), not a hash of a sorted list: sums combine on the map side, so a folder with a third
of all files is gathered in no task. A change of a name, size, time or error anywhere below
changes the digest of every folder above it, and the own digest of its folder alone.

Rows without a path or parent are left out. Repeated rows count as often as they come. A
null size or time is a value of its own. Columns beside those of a listing are not used. A
folder that is only named by what it holds is one all the same. An empty listing has no
folders.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.functions import rules
from mediashoal.operators.incremental import scan_diff
from mediashoal.sources import files
from mediashoal.storage import materialize

_SUMS = [f"s{k}" for k in range(4)]


def depth(path: str) -> Column:
    """Number of slashes, of the top folder none."""
    return F.when(F.col(path) == "/", 0).otherwise(F.length(path) - F.length(F.replace(F.col(path), F.lit("/"), F.lit(""))))


def folder_of(path: str = "path") -> Column:
    cut = F.expr(f"substring({path}, 1, length({path}) - locate('/', reverse({path})))")
    return F.when(cut == "", "/").otherwise(cut)


def _pieces(text: Column) -> list[Column]:
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)").alias(s) for k, s in enumerate(_SUMS)]


def _summed() -> list[Column]:
    return [F.sum(s).cast("decimal(38,0)").alias(s) for s in _SUMS]


def _digest() -> Column:
    return F.sha2(F.concat_ws(",", *[F.col(s).cast("string") for s in _SUMS]).cast("binary"), 256)


def folder_digests(entries: DataFrame) -> DataFrame:
    """``(path, depth, n_files, own, digest)`` of every folder of a listing.

    ``own`` covers the entries directly in it that are no folders, ``digest`` all below;
    ``n_files`` counts these. Levels are folded one after the other, deepest first.
    """
    known = entries.where("path is not null and parent is not null").withColumn("parent", F.when(F.col("path") == F.col("root"), F.col("root")).otherwise(F.col("parent")))
    leaf = ~(F.col("is_dir") & F.col("error").isNull())
    fields = [rules.file_name(F.col("path")), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("size_bytes", "modified_at", "error")]]
    leaves = known.where(leaf).select(F.col("parent").alias("path"), *_pieces(F.concat_ws("/", F.lit("f"), *fields)))
    direct = leaves.groupBy("path").agg(F.count("*").alias("n_files"), *_summed())

    named = known.select("root", F.col("parent").alias("folder")).unionAll(known.where(~leaf).select("root", F.col("path").alias("folder"))).distinct()
    up = named.select("root", "folder", F.explode(F.sequence(depth("root"), depth("folder"))).alias("depth"))
    ancestors = up.select("root", "depth", F.coalesce(F.nullif(F.expr("substring_index(folder, '/', depth + 1)"), F.lit("")), F.lit("/")).alias("path"))
    folders = ancestors.groupBy("path", "depth").agg(F.bool_or(F.col("path") == F.col("root")).alias("top"))
    sums = [F.coalesce(s, F.lit(0)).cast("decimal(38,0)").alias(s) for s in _SUMS]
    base = folders.join(direct, "path", "left").select("path", "depth", "top", F.coalesce("n_files", F.lit(0)).alias("n_files"), *sums)
    base = materialize(base.withColumn("own", _digest()), "folders")

    first, last = base.agg(F.min("depth"), F.max("depth")).first()
    made, below = base.sparkSession.createDataFrame([], "path string, depth int, n_files bigint, own string, digest string"), None
    for level in range(last, first - 1, -1) if last is not None else ():
        rows = base.where(F.col("depth") == level).drop("depth")
        if below is not None:
            rows = rows.unionByName(below, allowMissingColumns=True).groupBy("path").agg(F.max("top").alias("top"), F.max("own").alias("own"), F.sum("n_files").alias("n_files"), *_summed())
        whole = materialize(rows.select("path", F.lit(level).alias("depth"), "n_files", "own", _digest().alias("digest"), "top"), "digests")
        made = made.unionAll(whole.drop("top"))
        below = whole.where("not top").select(folder_of().alias("path"), "n_files", *_pieces(F.concat_ws("/", F.lit("d"), rules.file_name(F.col("path")), "digest")))
    return made


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, state)`` of the folders that differ between two results of
    ``folder_digests``: new, gone, own (its own entries did, and maybe more) or below."""
    old, new = before.select("path", F.col("own").alias("o1"), F.col("digest").alias("d1")), after.select("path", F.col("own").alias("o2"), F.col("digest").alias("d2"))
    state = F.when(F.col("d1").isNull(), "new").when(F.col("d2").isNull(), "gone").when(F.col("o1") != F.col("o2"), "own").when(F.col("d1") != F.col("d2"), "below")
    return old.join(new, "path", "full").select("path", state.alias("state")).where("state is not null")


def rescan_diff(listing: DataFrame, media: DataFrame, changed: DataFrame) -> DataFrame:
    """``scan_diff``, where only files of changed folders are compared with the catalog.

    ``changed`` is between the digests of the catalog's files that are not missing and
    those of the listing; files of other folders are unchanged.
    """
    # written, so that Spark knows the size
    touched = materialize(changed.where("state <> 'below'").select(F.col("path").alias("_folder")), "touched")
    inside = folder_of() == F.col("_folder")
    compared = scan_diff(listing.join(touched, inside, "left_semi"), media.join(touched, inside, "left_semi"))
    return compared.unionByName(listing.join(touched, inside, "left_anti").withColumn("action", F.lit("unchanged")))


@dataclass
class Relisted:
    """``entries`` as ``files.listing`` gives them; ``folders`` (path, state): kept (not
    listed again), listed, or gone."""

    entries: DataFrame
    folders: DataFrame


def relist(spark: SparkSession, roots: list[str], known: DataFrame, scanned_at: int, check_files: bool = True, quiet: int = 2) -> Relisted:
    """A listing from an earlier one, ``known``, begun at ``scanned_at``.

    A folder's time of change is that of its set of names. Folders with the time they had
    are not listed again, if that time was more than ``quiet`` seconds before the earlier
    listing began and nothing in them was an error. With ``check_files``, their files are
    looked at one by one, and the result equals a full listing; without, files that were
    written in place keep their old size and time. Roots are always listed, as are folders
    that are new, level by level. Folders that became links are gone.
    """
    errors, tops = files.split_roots(spark, roots)
    own = known.where(F.col("path").isNotNull()).join(F.broadcast(tops.select("root")), "root", "left_semi")  # as many as roots are given
    bad = own.where("error is not null")
    bad = materialize(bad.select("path").unionAll(bad.select(F.col("parent").alias("path"))).distinct().withColumn("bad", F.lit(True)), "errors")
    dirs = own.where("is_dir and error is null").join(bad, "path", "left")
    quiet_then = F.coalesce(F.col("modified_at") < scanned_at - quiet, F.lit(False)) & F.col("bad").isNull()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linked = lru_cache(1 << 14)(os.path.islink)
        for batch in batches:
            out = []
            for root, path, parent, before, trusted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                between = path[len(root) :].strip("/").split("/")[:-1]
                try:
                    s = os.lstat(path)
                    real = stat.S_ISDIR(s.st_mode) and not any(linked(os.path.join(root, *between[: k + 1])) for k in range(len(between)))
                except OSError:
                    real = False
                if real:
                    row = files.entry(root, path, parent, True, s)
                    out.append((*row[:-1], "kept" if trusted and row[-2] == before else "listed"))
                else:
                    out.append((root, path, parent, True, None, None, None, "gone"))
            yield from files.packed(out)

    tasks = spark.sparkContext.defaultParallelism
    seen = dirs.select("root", "path", "parent", "modified_at", quiet_then.alias("trusted")).repartition(tasks, "path")
    states = materialize(seen.mapInArrow(look, files.ENTRY).withColumnRenamed("error", "state"), "states")
    alive = states.where("state <> 'gone'")

    found = files.read_folders(alive.where("state = 'listed'").select("root", "path").unionAll(tops))
    new = found.where("is_dir and error is null").join(alive.select("path"), "path", "left_anti").select(*files.NAMES)
    below = files.walk(new.select("root", "path"))
    kept = own.where("not is_dir and error is null").join(alive.where("state = 'kept'").select(F.col("path").alias("parent")), "parent", "left_semi").select(*files.NAMES)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for root, path, here in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    s = os.lstat(path)
                except OSError:
                    continue
                if stat.S_ISREG(s.st_mode):
                    yield files.entry(root, path, here, False, s)

        for batch in batches:
            yield from files.packed(rows(batch))

    if check_files:
        kept = kept.repartition(tasks, "path").mapInArrow(check, files.ENTRY)
    still = alive.select(*files.NAMES[:-1], F.lit(None).cast("string").alias("error"))
    entries = errors.unionAll(kept).unionAll(still).unionAll(found.where("not is_dir or error is not null")).unionAll(new).unionAll(below)
    listed = new.select("path", F.lit("listed").alias("state")).unionAll(below.where("is_dir and error is null").select("path", F.lit("listed").alias("state")))
    return Relisted(files.once(entries), states.select("path", "state").unionAll(listed).unionAll(tops.select("path", F.lit("listed").alias("state"))))
