"""Change detection and copy-on-write updates: each returns the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashoal.operators.ranking import ordered_index
from mediashoal.storage import materialize


def same_file(a: DataFrame, b: DataFrame) -> Column:
    """Size and time of change equal, null-safe."""
    return a["size_bytes"].eqNullSafe(b["size_bytes"]) & a["modified_at"].eqNullSafe(b["modified_at"])


def needs_processing(media: DataFrame, cache: DataFrame, processor: str, model: str) -> DataFrame:
    """Media without a fresh entry of the processing cache."""
    fresh = cache.where((F.col("processor") == processor) & (F.col("model") == model)).select("media_item_id", "size_bytes", "modified_at")
    return media.join(fresh, (media["id"] == fresh["media_item_id"]) & same_file(media, fresh), "left_anti")


def scan_diff(listing: DataFrame, media: DataFrame) -> DataFrame:
    """The listing with ``action``: unchanged, changed or new."""
    known = media.where(~F.col("missing")).select("path", F.col("size_bytes").alias("known_size"), F.col("modified_at").alias("known_modified"), F.lit(True).alias("known"))
    joined = listing.join(known, "path", "left")
    same = F.col("known") & F.col("size_bytes").eqNullSafe(F.col("known_size")) & F.col("modified_at").eqNullSafe(F.col("known_modified"))
    action = F.when(F.coalesce(same, F.lit(False)), F.lit("unchanged")).when(F.col("known"), F.lit("changed")).otherwise(F.lit("new"))
    return joined.withColumn("action", action).drop("known_size", "known_modified", "known")


def scan_summary(diff: DataFrame, now_missing: int = 0, errors: int = 0) -> DataFrame:
    """Counters of a scan: scanned, imported or updated, skipped, missing, errors."""
    return diff.agg(
        F.count("*").alias("scanned"), F.count_if(F.col("action") != "unchanged").alias("imported"), F.count_if(F.col("action") == "unchanged").alias("skipped")
    ).select("*", F.lit(now_missing).cast("bigint").alias("missing"), F.lit(errors).cast("bigint").alias("errors"))


def upsert_media(media: DataFrame, changed: DataFrame) -> DataFrame:
    """By path: known rows keep id and ``imported_at``, everything else is overwritten
    and ``missing`` reset; new rows get the next ids by path.
    """
    kept = [c for c in media.columns if c not in ("id", "imported_at", "missing", "path")]
    fresh = changed.select("path", F.lit(True).alias("_fresh"), F.col("imported_at").alias("_imported"), *[(F.col(c) if c in changed.columns else F.lit(None)).cast(media.schema[c].dataType).alias(f"_{c}") for c in kept])
    joined = media.withColumn("_known", F.lit(True)).join(fresh, "path", "full")
    hit = F.coalesce("_fresh", F.lit(False))
    both = joined.select(
        "id", "path", "_known", F.coalesce("imported_at", "_imported").alias("imported_at"), F.when(hit, F.lit(False)).otherwise(F.col("missing")).alias("missing"),
        *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in kept],
    )
    both = materialize(both, "upserted")
    top = media.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    added = ordered_index(both.where("_known is null"), "path", name="k").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("k") + 1)  # one row
    return both.where("_known is not null").select(media.columns).unionAll(added.select(media.columns))


def mark_missing(media: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is gone become missing, in the whole catalog; none comes back."""
    there = listing.select("path", F.lit(True).alias("there")).distinct()
    return media.join(there, "path", "left").withColumn("missing", F.col("missing") | F.col("there").isNull()).select(media.columns)


def backfill_cache(cache: DataFrame, media: DataFrame, embeddings: DataFrame, faces: DataFrame, face_model: str) -> DataFrame:
    """Entries that stored embeddings and faces imply, where there is none yet."""
    keys = ["media_item_id", "processor", "model"]
    made = embeddings.where("media_item_id is not null").groupBy("media_item_id", "model").agg(F.min("created_at").alias("processed_at")).withColumn("processor", F.lit("embeddings"))
    seen = faces.groupBy("media_item_id").agg(F.min("created_at").alias("processed_at")).withColumn("processor", F.lit("faces")).withColumn("model", F.lit(face_model))
    rows = made.unionByName(seen).join(media.select(F.col("id").alias("media_item_id"), "size_bytes", "modified_at"), "media_item_id")
    return cache.unionByName(rows.join(cache.select(keys), keys, "left_anti").select(cache.columns))


def mark_processed(cache: DataFrame, media: DataFrame, ids: DataFrame, processor: str, model: str, now: int) -> DataFrame:
    rows = media.join(ids.select("id"), "id", "left_semi").select(F.col("id").alias("media_item_id"), F.lit(processor).alias("processor"), F.lit(model).alias("model"), "size_bytes", "modified_at", F.lit(now).cast("bigint").alias("processed_at"))
    keys = ["media_item_id", "processor", "model"]
    return cache.join(rows.select(keys), keys, "left_anti").select(cache.columns).unionByName(rows)


VISUAL = ["width", "height", "ahash", "dhash", "phash"]


def upsert_cleanup_cache(cache: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with a digest alone, or a fingerprint alone; others are left out. The
    other half of an entry stays only while the file is the same.
    """
    useful = updates.where(F.col("sha256").isNotNull() != F.col("ahash").isNotNull())
    merged = useful.groupBy("path").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("size_bytes", "modified_at", "sha256", *VISUAL, "updated_at")])
    old = cache.select("path", *[F.col(c).alias(f"old_{c}") for c in cache.columns if c != "path"])
    joined = merged.join(old, "path", "left")
    same = F.col("size_bytes").eqNullSafe(F.col("old_size_bytes")) & F.col("modified_at").eqNullSafe(F.col("old_modified_at"))
    for c in ("sha256", *VISUAL):
        joined = joined.withColumn(c, F.coalesce(c, F.when(same, F.col(f"old_{c}"))))
    return cache.join(merged.select("path"), "path", "left_anti").select(cache.columns).unionByName(joined.select(cache.columns))


def fresh_entries(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The files with what a fresh cache entry knows of them, null where none is."""
    known = cache.select("path", "size_bytes", "modified_at", "sha256", *VISUAL, F.lit(True).alias("fresh"))
    joined = files.alias("f").join(known.alias("c"), (F.col("f.path") == F.col("c.path")) & F.col("f.size_bytes").eqNullSafe(F.col("c.size_bytes")) & F.col("f.modified_at").eqNullSafe(F.col("c.modified_at")), "left")
    return joined.select("f.*", F.coalesce("c.fresh", F.lit(False)).alias("cached"), *[F.col(f"c.{c}").alias(f"cached_{c}") for c in ("sha256", *VISUAL)])


def cache_profile(cache: DataFrame) -> DataFrame:
    """Counts, an estimate of bytes, and the first and last update."""
    exact, visual = F.col("sha256").isNotNull(), F.col("ahash").isNotNull() & F.col("dhash").isNotNull() & F.col("phash").isNotNull()
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("path", "sha256", "ahash", "dhash", "phash")), F.lit(64))
    return cache.agg(
        F.count("*").alias("total_entries"), F.count_if(exact).alias("exact_hash_entries"), F.count_if(visual).alias("visual_fingerprint_entries"),
        F.count_if(exact & visual).alias("complete_entries"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("cache_bytes_estimate"),
        F.min("updated_at").alias("oldest_updated_at"), F.max("updated_at").alias("newest_updated_at"),
    )


def selection_profile(cache: DataFrame, files: DataFrame) -> DataFrame:
    """How much of a selection the cache covers; entries of changed files are stale."""
    known = cache.select("path", F.lit(True).alias("known"))
    rows = fresh_entries(cache, files).join(known, "path", "left")
    exact = F.col("cached_sha256").isNotNull()
    visual = F.col("cached_width").isNotNull() & F.col("cached_height").isNotNull() & F.col("cached_ahash").isNotNull() & F.col("cached_dhash").isNotNull() & F.col("cached_phash").isNotNull()
    stale = F.col("known") & ~F.col("cached")
    return rows.agg(
        F.count("*").alias("selected_images"), F.count_if(exact).alias("selected_exact_cached"), F.count_if(visual).alias("selected_visual_cached"), F.count_if(exact & visual).alias("selected_complete_cached"),
        F.count_if(~exact).alias("selected_uncached_exact"), F.count_if(~visual).alias("selected_uncached_visual"), F.count_if(F.coalesce(stale, F.lit(False))).alias("stale_selected_entries"),
    )
