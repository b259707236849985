"""Cleanup plans: what could go, what may go, and a manifest of what goes.

A plan is three tables. Applying one never deletes by itself: it checks a request and
returns a manifest; ``execute`` carries a manifest out on local files when asked to.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.functions.rules import under_root
from mediashoal.operators import duplicates
from mediashoal.operators.incremental import fresh_entries
from mediashoal.plans.catalog import CatalogError
from mediashoal.plans.filters import cleanup_scope
from mediashoal.storage import materialize


@dataclass
class CleanupPlan:
    """``ignored`` (path, size_bytes, reason), ``empty_folders`` (path), and ``members``
    (group_id, kind, path, size_bytes, keep_path, is_keeper, score)."""

    ignored: DataFrame
    empty_folders: DataFrame
    members: DataFrame
    plan_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def totals(self) -> DataFrame:
        """Counts and bytes; a path that is ignored and a duplicate counts in both
        figures, and once in ``distinct_bytes``."""
        extra = self.members.where(~F.col("is_keeper")).select("path", "size_bytes")
        both = self.ignored.select("path", "size_bytes").unionAll(extra)
        size = F.coalesce(F.sum("size_bytes"), F.lit(0))
        ignored = self.ignored.agg(F.count("*").alias("ignored_files"), size.alias("ignored_bytes"))
        folders = self.empty_folders.agg(F.count("*").alias("empty_folders"))
        groups = self.members.agg(F.count_distinct("group_id").alias("duplicate_groups"), F.count_if(~F.col("is_keeper")).alias("duplicate_files"), F.coalesce(F.sum(F.when(~F.col("is_keeper"), F.coalesce("size_bytes", F.lit(0)))), F.lit(0)).alias("duplicate_bytes"))
        distinct = both.groupBy("path").agg(F.max("size_bytes").alias("size_bytes")).agg(size.alias("distinct_bytes"))
        return ignored.crossJoin(folders).crossJoin(groups).crossJoin(distinct).withColumn("total_bytes", F.col("ignored_bytes") + F.col("duplicate_bytes"))  # one row each


def generate(media: DataFrame, cache: DataFrame, ignored: DataFrame, empty_folders: DataFrame, roots: list[str] | None = None, hashes: DataFrame | None = None, prints: DataFrame | None = None) -> CleanupPlan:
    """From the media in scope; digests and fingerprints come from the cache where it is
    fresh, else from ``hashes`` (path, sha256) and ``prints`` (path, width, height,
    ahash, dhash, phash) made in this run. Exact duplicates leave the visual pass. The
    plan is written, so what is shown is what can be applied.
    """
    items = cleanup_scope(media)
    if roots:
        hit = F.lit(False)
        for root in roots:
            hit = hit | under_root(F.col("path"), root)
        items = items.where(hit)
    known = fresh_entries(cache, items.select("path", "size_bytes", "created_at", "modified_at", "captured_at"))
    none = items.select("path").limit(0)
    hashes = hashes if hashes is not None else none.withColumn("sha256", F.lit(None).cast("string"))
    if prints is None:
        prints = none.select("path", *[F.lit(None).cast(t).alias(c) for c, t in (("width", "bigint"), ("height", "bigint"), ("ahash", "string"), ("dhash", "string"), ("phash", "string"))])
    rows = known.alias("k").join(hashes.alias("h"), "path", "left").join(prints.alias("p"), "path", "left")
    files = rows.select(
        "path", "k.size_bytes", "k.created_at", "k.modified_at", "k.captured_at", F.coalesce("k.cached_sha256", "h.sha256").alias("sha256"),
        *[F.coalesce(f"k.cached_{c}", f"p.{c}").alias(c) for c in ("width", "height", "ahash", "dhash", "phash")],
    )
    unseen = {c: F.lit(None).cast("bigint") for c in ("width", "height")}  # equal files have equal pixels, whichever the cache knows
    exact = duplicates.numbered(duplicates.exact_groups(files.withColumns(unseen)), "exact").select("sha256", "group_id", "keep_path")
    exact_rows = files.join(exact, "sha256").select("group_id", F.lit("exact-image").alias("kind"), "path", "size_bytes", "keep_path", F.lit(None).cast("int").alias("score"))
    left = files.join(exact_rows.select("path"), "path", "left_anti")
    seen = duplicates.visual_members(left.where("ahash is not null")).join(left, "path")
    groups = duplicates.numbered(duplicates.keepers(seen, "anchor"), "visual").select("anchor", "group_id", "keep_path")
    visual = seen.join(groups, "anchor").select("group_id", F.lit("visual-image").alias("kind"), "path", "size_bytes", "keep_path", "score")
    members = exact_rows.unionByName(visual).withColumn("is_keeper", F.col("path") == F.col("keep_path"))
    return CleanupPlan(materialize(ignored, "plan"), materialize(empty_folders, "plan"), materialize(members, "plan"))


def apply_plan(plan: CleanupPlan | None, remove: DataFrame, folders: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """``(path, action, accepted, reason, size_bytes, depth)``, folders deepest last.

    Refused as a whole if any group would lose all its files. Paths outside the plan are
    refused one by one; a folder counts as empty if ``listing`` (path, parent) has
    nothing in it besides what goes.
    """
    if plan is None:
        raise CatalogError("cleanup plan expired; generate a new plan")
    wanted = remove.select("path").distinct()
    asked = plan.members.join(wanted.withColumn("asked", F.lit(True)), "path", "left")
    lost = asked.groupBy("group_id").agg(F.count("*").alias("n"), F.count("asked").alias("k")).where("n = k").agg(F.min("group_id")).first()[0]
    if lost is not None:
        raise CatalogError(f"refusing to delete every file in duplicate group {lost}")
    allowed = plan.ignored.select("path", "size_bytes").unionAll(plan.members.select("path", "size_bytes")).groupBy("path").agg(F.max(F.coalesce("size_bytes", F.lit(0))).alias("size_bytes"), F.lit(True).alias("planned"))
    files = wanted.join(allowed, "path", "left").withColumn("accepted", F.coalesce("planned", F.lit(False)))
    reason = F.when(F.col("accepted"), F.lit("planned")).otherwise(F.concat(F.lit("refusing unplanned file deletion: "), F.col("path")))
    files = files.select("path", F.lit("delete-file").alias("action"), "accepted", reason.alias("reason"), F.when(F.col("accepted"), F.col("size_bytes")).otherwise(F.lit(0)).alias("size_bytes"))
    planned = folders.select("path").distinct().join(plan.empty_folders.select("path").distinct().withColumn("planned", F.lit(True)), "path", "left")
    if listing is None:
        planned = planned.withColumn("full", F.lit(False))
    else:
        staying = listing.join(files.where("accepted").select("path"), "path", "left_anti").select(F.col("parent").alias("path")).distinct().withColumn("full", F.lit(True))
        planned = planned.join(staying, "path", "left")
    ok = F.coalesce("planned", F.lit(False)) & ~F.coalesce("full", F.lit(False))
    why = F.when(ok, F.lit("planned")).when(F.col("planned"), F.concat(F.lit("folder not empty after file cleanup: "), F.col("path"))).otherwise(F.concat(F.lit("refusing unplanned folder deletion: "), F.col("path")))
    rows = planned.select("path", F.lit("delete-folder").alias("action"), ok.alias("accepted"), why.alias("reason"), F.lit(0).cast("bigint").alias("size_bytes"))
    return files.unionByName(rows).withColumn("depth", F.size(F.split("path", "/"))).orderBy(F.col("action"), F.col("depth").desc(), "path")


OUTCOME = "path string, action string, accepted boolean, reason string, size_bytes bigint, depth int, done boolean, error string"


def execute(manifest: DataFrame, really: bool = False) -> DataFrame:
    """With ``done`` and ``error``; deletes only if told to.

    Executors delete, on a file system that they share: files first, then folders, the
    deepest first. What was done is written before the next level, so a task that runs
    again finds its file gone and counts that as done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for r in batch.to_pylist():
                error = None
                if really and r["accepted"]:
                    try:
                        (os.remove if r["action"] == "delete-file" else os.rmdir)(r["path"])
                    except OSError as e:
                        error = f"failed to permanently delete {r['path']}: {e}"
                done.append(really and r["accepted"] and error is None)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.bool_()), pa.array(errors, pa.string())], [*batch.schema.names, "done", "error"])

    rows = materialize(manifest.select("path", "action", "accepted", "reason", "size_bytes", "depth"), "manifest")
    folders = F.col("action") == "delete-folder"
    out = materialize(rows.where(~folders).mapInArrow(run, OUTCOME), "deleted")
    depths = sorted((r["depth"] for r in rows.where(folders).select("depth").distinct().collect()), reverse=True)  # as many as folders are deep
    for depth in depths:
        out = out.unionAll(materialize(rows.where(folders & (F.col("depth") == depth)).mapInArrow(run, OUTCOME), "deleted"))
    return out


class PlanBook:
    """Plans that wait to be applied or cancelled, by id."""

    def __init__(self):
        self.plans: dict[str, CleanupPlan] = {}

    def add(self, plan: CleanupPlan) -> str:
        self.plans[plan.plan_id] = plan
        return plan.plan_id

    def get(self, plan_id: str) -> CleanupPlan | None:
        return self.plans.get(plan_id)

    def cancel(self, plan_id: str) -> bool:
        """Whether there was such a plan; it can't be applied any more."""
        return self.plans.pop(plan_id, None) is not None

    def apply(self, plan_id: str, remove: DataFrame, folders: DataFrame, listing: DataFrame | None = None) -> DataFrame:
        return apply_plan(self.get(plan_id), remove, folders, listing)


def mark_removed(media: DataFrame, outcome: DataFrame) -> DataFrame:
    """Only files that were really deleted become missing."""
    gone = outcome.where("done and action = 'delete-file'").select("path", F.lit(True).alias("gone"))
    return media.join(gone, "path", "left").withColumn("missing", F.col("missing") | F.coalesce("gone", F.lit(False))).select(media.columns)
