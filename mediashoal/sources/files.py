"""File sources: discovery, ignored files, empty folders, digests, EXIF, vectors.

``listing`` reads folders inside executors, a level of the tree at a time, so listing a
large tree doesn't pass through the driver. Folder errors are rows with ``error`` set. Rules are applied to the part of a path below its
root, as columns.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.functions import dates, rules
from mediashoal.sources.exif import read_exif
from mediashoal.storage import materialize, small_batches

ENTRY = "root string, path string, parent string, is_dir boolean, size_bytes bigint, created_at bigint, modified_at bigint, error string"


def canonical_folder(path: str) -> str | None:
    """The folder's full path, or None if it is none (what picking a folder checks)."""
    return os.path.realpath(path) if os.path.isdir(path) else None


def entry(root: str, path: str, here: str, is_dir: bool, s: os.stat_result) -> tuple:
    return root, path, here, is_dir, None if is_dir else s.st_size, int(getattr(s, "st_birthtime", s.st_ctime)), int(s.st_mtime), None


def entries_of(root: str, here: str) -> Iterator[tuple]:
    """What a folder holds directly."""
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError as e:
        yield root, here, os.path.dirname(here), True, None, None, None, f"{here}: {e.strerror}"
        return
    for e in entries:
        try:
            is_dir, is_file = e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)
            if is_dir or is_file:
                yield entry(root, e.path, here, is_dir, e.stat(follow_symlinks=False))
        except OSError as err:
            yield root, e.path, here, False, None, None, None, f"{e.path}: {err.strerror}"


def listing(spark: SparkSession, roots: list[str], skip_excluded: bool = False) -> DataFrame:
    """Every file and folder below the roots; a root that is no folder is an error row.
    A path under two roots comes once, below the shorter one.

    Folders are read level by level: those of a level are dealt over the executors, and
    the rows are written, so neither driver nor one task walks a tree. With
    ``skip_excluded``, folders that the rules leave out are not gone into.
    """
    errors, folders = split_roots(spark, roots)
    return once(walk(folders, skip_excluded).unionAll(errors))


def split_roots(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Error rows for roots that are no folder; ``(root, path)`` of those that are one."""
    first, level = [], []
    for root in dict.fromkeys(r.rstrip("/") or "/" for r in roots):
        if os.path.isdir(root):
            level.append((root, root))
        else:
            kind = "not a folder" if os.path.exists(root) else "no such folder"
            first.append((root, root, os.path.dirname(root), True, None, None, None, f"{root}: {kind}"))
    return spark.createDataFrame(first, ENTRY), spark.createDataFrame(level, "root string, path string")


NAMES = [c.split()[0] for c in ENTRY.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def packed(rows: Iterable[tuple], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Entries as batches of ``most`` rows."""
    for part in batched(rows, most):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), _KINDS, strict=True)], NAMES)


def read_folders(folders: DataFrame) -> DataFrame:
    """The entries directly in ``folders`` (root, path), read on executors and written."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield from packed(e for root, folder in pairs for e in entries_of(root, folder))

    tasks = folders.sparkSession.sparkContext.defaultParallelism
    return materialize(folders.select("root", "path").repartition(tasks, "path").mapInArrow(read, ENTRY), "listing")


def walk(folders: DataFrame, skip_excluded: bool = False) -> DataFrame:
    """All entries below ``folders`` (root, path), level by level."""
    both = folders.sparkSession.createDataFrame([], ENTRY)
    while not folders.isEmpty():
        found = read_folders(folders)
        both = both.unionAll(found)
        folders = found.where("is_dir and error is null").select("root", "path")
        if skip_excluded:
            folders = folders.where(~rules.is_excluded(_below()))
    return both


def once(entries: DataFrame) -> DataFrame:
    """Each path once, below its shortest root."""
    rest = [c for c in NAMES if c not in ("path", "error")]
    least = entries.groupBy("path", "error").agg(F.min_by(F.struct(*rest), F.struct(F.length("root"), "root")).alias("e"))
    return least.select("e.root", "path", *[f"e.{c}" for c in rest[1:]], "error")


def _below(column: str = "path") -> Column:
    return F.expr(f"substring({column}, length(root) + 2)")


def media_files(entries: DataFrame, now: int, max_files: int | None = None) -> DataFrame:
    """Media among the entries that no rule leaves out, as rows for the catalog."""
    files = entries.where("not is_dir and error is null")
    name = rules.file_name(F.col("path"))
    rows = files.withColumn("file_name", name).withColumn("extension", rules.extension(F.col("file_name"))).withColumn("media_type", rules.media_type(F.col("extension")))
    rows = rows.where(F.col("media_type").isNotNull() & ~rules.is_excluded(_below()) & ~rules.is_face_tile(F.col("file_name"), F.col("media_type")))
    out = rows.select(rules.clean_path(F.col("path")).alias("path"), "file_name", "extension", "media_type", "size_bytes", "created_at", "modified_at", F.lit(now).cast("bigint").alias("imported_at"))
    return out if max_files is None else out.orderBy("path").limit(max_files)


def errors(entries: DataFrame) -> DataFrame:
    return entries.where("error is not null").select("path", "error")


def ignored_files(entries: DataFrame) -> DataFrame:
    """``(path, size_bytes, reason)`` of files that the rules leave out."""
    below = F.split(_below(), "/")
    folders = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    inside = F.exists(folders, lambda part: part.startswith(".") | rules.ascii_lower(part).isin(*rules.EXCLUDED_NAMES))
    name = rules.file_name(F.col("path"))
    reason = (
        F.when(inside, F.lit("Inside folder ignored by indexing rules"))
        .when(rules.is_excluded(name), F.lit("Ignored by indexing rules"))
        .when(rules.is_face_tile(name, rules.media_type(rules.extension(name))), F.lit("Facetile image ignored by indexing rules"))
    )
    return entries.where("not is_dir and error is null").select("path", "size_bytes", reason.alias("reason")).where("reason is not null")


def empty_folders(entries: DataFrame) -> DataFrame:
    """Folders without any entry, deepest first; never a root, never by what they hold
    only indirectly. Folders that couldn't be read are not empty."""
    used = entries.select(F.col("parent").alias("path")).unionAll(errors(entries).select("path")).distinct()
    found = entries.where("is_dir and error is null").select("path").join(used, "path", "left_anti")
    return found.orderBy(F.size(F.split("path", "/")).desc(), "path")


def contents(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``(path, content)`` of the files below the roots, read by Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")


def digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def with_exif(files: DataFrame) -> DataFrame:
    """``(path, camera_make, camera_model, lens_model, captured_at, latitude, longitude,
    metadata_json)``; tags are read in Python, dates and degrees are columns."""

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_exif(c) if c else {} for c in batch.column(1).to_pylist()]
            text = [pa.array([f.get(k) for f in found], pa.string()) for k in ("make", "model", "lens", "taken", "lat_ref", "lng_ref")]
            parts = [pa.array([f.get(k) for f in found], pa.list_(pa.float64())) for k in ("lat", "lng")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *text, *parts], ["path", "make", "model", "lens", "taken", "lat_ref", "lng_ref", "lat", "lng"])

    small_batches(files.sparkSession)
    rows = files.select("path", "content").mapInArrow(tags, "path string, make string, model string, lens string, taken string, lat_ref string, lng_ref string, lat array<double>, lng array<double>")
    made = rows.select(
        "path", F.col("make").alias("camera_make"), F.col("model").alias("camera_model"), F.col("lens").alias("lens_model"), dates.exif_seconds(F.col("taken")).alias("captured_at"),
        dates.gps_degrees(F.col("lat"), F.col("lat_ref"), "S").alias("latitude"), dates.gps_degrees(F.col("lng"), F.col("lng_ref"), "W").alias("longitude"),
    )
    parts = F.struct(F.col("camera_make").alias("make"), F.col("camera_model").alias("model"), "lens_model", "captured_at", "latitude", "longitude")
    return made.withColumn("metadata_json", F.to_json(parts, {"ignoreNullFields": "false"}))


def display_paths(media: DataFrame, conversions: DataFrame) -> DataFrame:
    """``display_path``: where a file that is not missing has been converted to."""
    made = conversions.select("path", "converted")
    return media.join(made, "path", "left").withColumn("display_path", F.when(~F.col("missing"), F.col("converted"))).drop("converted")


def shown_paths(media: DataFrame, conversions: DataFrame) -> DataFrame:
    """``display_path``: the file as converted, or else itself, missing or not."""
    made = conversions.select("path", "converted")
    return media.join(made, "path", "left").withColumn("display_path", F.coalesce("converted", "path")).drop("converted")


#: Formats that viewers can't show.
CONVERTED = ("heic", "heif")


def convert(files: DataFrame, folder: str, encode: Callable[[bytes], bytes]) -> DataFrame:
    """``(path, converted, error)`` of ``(path, extension, size_bytes, modified_ns, content)``.

    Files of the CONVERTED formats are written to ``folder``, which executors share, as
    ``<key>.jpg``, once: a key names content, so what is there stays. ``encode`` gives
    the JPEG bytes, turned upright. Other files stand for themselves.
    """
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths, errors = [], []
            for key, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                target, error = f"{folder}/{key}.jpg", None
                try:
                    if not os.path.exists(target):
                        made, draft = encode(bytes(content or b"")), f"{target}.{os.getpid()}.part"
                        with open(draft, "wb") as out:
                            out.write(made)
                        os.replace(draft, target)
                except Exception as e:  # noqa: BLE001  any encoder's error belongs to its file
                    target, error = None, f"{type(e).__name__}: {e}"
                paths.append(target)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(errors, pa.string())], ["path", "converted", "error"])

    small_batches(files.sparkSession)
    wanted = F.lower(F.coalesce("extension", F.lit(""))).isin(*CONVERTED)
    made = files.where(wanted).select("path", conversion_key(F.col("path"), F.col("size_bytes"), F.col("modified_ns")).alias("key"), "content")
    own = files.where(~wanted).select("path", F.col("path").alias("converted"), F.lit(None).cast("string").alias("error"))
    return made.mapInArrow(run, "path string, converted string, error string").unionAll(own)


def conversion_key(path: Column, size: Column, modified_ns: Column) -> Column:
    """Name of a cached conversion; what is not known has a place of its own."""
    known = [F.coalesce(c.cast("string"), F.lit("")) for c in (path, size, modified_ns)]
    return F.sha2(F.concat(known[0], F.lit("|"), known[1], F.lit("|"), known[2]).cast("binary"), 256)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``(position, vector)`` from a JSON array of arrays, or ``{data: {embeddings}}``."""
    text = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", "array<array<float>>")
    nested = F.from_json("value", "struct<data: struct<embeddings: array<array<float>>>>")["data"]["embeddings"]
    chosen = F.when(F.ltrim("value").startswith("["), plain).otherwise(nested)
    return text.select(F.posexplode(chosen).alias("position", "vector"))
