"""A catalog of snapshot tables, and the changes that its commands make.

Each table is a folder of immutable Parquet snapshots; a small pointer file a version names the
current one of each, so readers never see half a change, of one table or of several.
Commands read the current snapshots, build the next state as a DataFrame, and commit it. Referential actions are explicit:
embeddings go with their faces, faces stay when their person goes.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.functions.rules import clean_path
from mediashoal.operators import incremental
from mediashoal.operators import people as people_ops
from mediashoal.operators.ranking import ordered_index
from mediashoal.schemas import FACE_MODEL, FACE_THRESHOLD, TABLES
from mediashoal.storage import materialize


class CatalogError(ValueError):
    """A command that can't be carried out; nothing was changed."""


class Catalog:
    """Opening creates what is missing; doing so again changes nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._seen: dict[str, str | None] = {}
        known = self._current()
        new = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items() if name not in known}
        if new:
            self.commit_all(new)

    # --- storage

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _version(self) -> int:
        """Of the newest pointer; 0 if there is none."""
        fs, folder = self._fs(f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _current(self, version: int | None = None) -> dict[str, dict]:
        """The snapshot of each table."""
        version = self._version() if version is None else version
        if not version:
            return {}
        fs, path = self._fs(self._pointer(version))
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _pointer(self, version: int) -> str:
        return f"{self.root}/versions/{version:020d}.json"

    def read(self, name: str) -> DataFrame:
        path = self._current()[name]["path"]
        self._seen[name] = path
        return self.spark.read.schema(TABLES[name]).parquet(path)

    def commit(self, name: str, df: DataFrame, batch: tuple[str, int] | None = None) -> None:
        self.commit_all({name: df}, batch)

    def commit_all(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> None:
        """Writes the next snapshots, then a pointer to all of them under the next version
        number, if nobody has written that one: so all tables change or none, and of two
        writers one is first. The other takes up what the first did to other tables and
        tries the number after; it is refused if a table that it changes has another
        snapshot than it has read, and its snapshots are left to ``vacuum``. ``batch``: the
        stream and its batch that the change holds.
        """
        paths = {name: f"{self.root}/{name}/snapshot-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields]).write.parquet(paths[name])
        while True:
            version = self._version()
            current = self._current(version)
            for name in tables:
                if name in self._seen and name in current and self._seen[name] != current[name]["path"]:
                    raise CatalogError(f"{name} was changed meanwhile; read it again")
            for name, path in paths.items():
                current[name] = {"path": path, "batches": current.get(name, {}).get("batches", {}) | (dict([batch]) if batch else {})}
            if self._create(self._pointer(version + 1), json.dumps(current).encode()):
                break
        self._seen |= paths

    def _create(self, path: str, content: bytes) -> bool:
        """Writes a file whole, unless there is one of this name: a draft is linked (on a local
        disk) or renamed (elsewhere) to it, which both fail if it exists. A store whose
        rename does not fail then takes one writer at a time.
        """
        fs, target = self._fs(path)
        _, draft = self._fs(f"{self.root}/draft-{uuid.uuid4().hex}.json")
        stream = fs.create(draft)
        stream.write(content)
        stream.close()
        fs.mkdirs(target.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
                none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)

    def vacuum(self, older_than: float = 7 * 86400) -> int:
        """Deletes snapshots that no table points to, if so many seconds old; how many."""
        used = {entry["path"].rstrip("/").rpartition("/")[2] for entry in self._current().values()}
        gone, limit = 0, (time.time() - older_than) * 1000
        for name in TABLES:
            fs, folder = self._fs(f"{self.root}/{name}")
            for status in fs.listStatus(folder) if fs.exists(folder) else []:
                if status.getPath().getName() not in used and status.getModificationTime() <= limit:
                    gone += bool(fs.delete(status.getPath(), True))
        fs, folder = self._fs(f"{self.root}/versions")
        newest = self._pointer(self._version()).rpartition("/")[2]
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() < newest and status.getModificationTime() <= limit:
                fs.delete(status.getPath(), False)
        return gone

    def last_batch(self, stream: str, name: str = "media_items") -> int:
        """The last batch of a stream that the table has; -1 if none."""
        return self._current()[name]["batches"].get(stream, -1)

    def drop(self) -> None:
        """The catalog's own folder only, never a media file."""
        fs, path = self._fs(self.root)
        fs.delete(path, True)

    def _next_ids(self, name: str, rows: DataFrame, *order: str) -> DataFrame:
        top = self.read(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return ordered_index(rows, *order, name="k").withColumn("id", F.col("k") + top + 1).drop("k")

    # --- folders

    def list_library_folders(self) -> DataFrame:
        return self.read("library_folders").orderBy("path")

    def add_library_folder(self, path: str, is_dir=None) -> None:
        """Must be a folder; one that is there already stays as it is."""
        from mediashoal.sources.files import canonical_folder

        found = canonical_folder(path) if is_dir is None else path if is_dir(path) else None
        if found is None:
            raise CatalogError(f"not a folder: {path}")
        self._add_folders([found])

    def _add_folders(self, paths: list[str], keep: bool = True) -> None:
        rows = self.spark.createDataFrame([(p,) for p in paths], "path string").select(clean_path(F.col("path")).alias("path")).distinct()
        known = self.read("library_folders")
        known = known if keep else known.limit(0)
        new = self._next_ids("library_folders", rows.join(known.select("path"), "path", "left_anti"), "path")
        self.commit("library_folders", known.unionByName(new.select("id", "path", F.lit(int(time.time())).cast("bigint").alias("created_at"))))

    def remove_library_folder(self, path: str) -> None:
        self.commit("library_folders", self.read("library_folders").where(F.col("path") != path))

    def update_settings(self, paths: list[str]) -> None:
        """Replaces all folders, at once."""
        self._add_folders(paths, keep=False)

    def get_settings(self) -> list[str]:
        return [r["path"] for r in self.list_library_folders().collect()]

    # --- people

    def list_people(self) -> DataFrame:
        return people_ops.list_people(self.read("people"), self.read("faces"))

    def person(self, name: str, now: int | None = None) -> int:
        """The id of the person of this exact name, made if there is none; a blank name
        is ``Unnamed``."""
        name = name.strip() or "Unnamed"
        people = self.read("people")
        found = people.where(F.col("name") == name).agg(F.min("id")).first()[0]
        if found is not None:
            return found
        new = self._next_ids("people", self.spark.createDataFrame([(name, now or int(time.time()))], "name string, created_at bigint"), "name")
        self.commit("people", people.unionByName(new))
        return self.person(name)

    def rename_person(self, person: int, name: str) -> None:
        """Neither trimmed nor unique; an unknown id changes nothing."""
        self.commit("people", self.read("people").withColumn("name", F.when(F.col("id") == person, F.lit(name)).otherwise(F.col("name"))))

    def delete_person(self, person: int) -> None:
        people = self.read("people")
        if people.where(F.col("id") == person).isEmpty():
            raise CatalogError(f"no person {person}")
        faces = self.read("faces").withColumn("person_id", F.when(F.col("person_id") != person, F.col("person_id")))
        self.commit_all({"faces": faces, "people": people.where(F.col("id") != person)})

    def name_face(self, face: int, name: str, threshold: float = FACE_THRESHOLD) -> int:
        """Names a face and the unnamed faces of other media that are like it; returns
        how many of those there were. Checked before anything is written.
        """
        faces, vectors = self.read("faces"), self.read("embeddings").where("face_id is not null")
        own = faces.where(F.col("id") == face).first()
        if own is None:
            raise CatalogError(f"no face {face}")
        latest = vectors.where(F.col("face_id") == face).orderBy(F.col("id").desc()).first()
        if latest is None:
            raise CatalogError(f"face {face} has no embedding")
        person = self.person(name)
        newest = vectors.groupBy("face_id").agg(F.max_by("vector", "id").alias("vector"))
        known = faces.join(newest, faces["id"] == newest["face_id"]).select("id", "person_id", "media_item_id", "vector")
        like = people_ops.propagate(known, list(latest["vector"]), own["media_item_id"], threshold).select("id", F.lit(True).alias("hit"))
        marked = faces.join(like, "id", "left")
        n = marked.where("hit").count()
        self.commit("faces", marked.withColumn("person_id", F.when(F.col("hit") | (F.col("id") == face), F.lit(person)).otherwise(F.col("person_id"))))
        return n

    # --- faces and embeddings

    def replace_faces(self, media_ids: DataFrame, found: DataFrame, model: str = FACE_MODEL, threshold: float = FACE_THRESHOLD, now: int | None = None) -> None:
        """Faces of these media are made anew from ``found`` (media_item_id, x, y, width,
        height, confidence, vector), identified against the names known before."""
        now = now or int(time.time())
        faces, vectors, media, cache = (self.read(n) for n in ("faces", "embeddings", "media_items", "media_processing_cache"))
        newest = vectors.where("face_id is not null").groupBy("face_id").agg(F.max_by("vector", "id").alias("vector"))
        named = people_ops.named_faces(faces.join(newest, faces["id"] == newest["face_id"]).select("id", "person_id", "vector"))
        gone = faces.join(media_ids.select(F.col("id").alias("media_item_id")), "media_item_id", "left_semi").select(F.col("id").alias("face_id"))
        kept_faces = faces.join(gone, faces["id"] == gone["face_id"], "left_anti")
        kept_vectors = vectors.join(gone, "face_id", "left_anti").select(vectors.columns)
        rows = self._next_ids("faces", found, "media_item_id", "x", "y", "width", "height", "confidence")
        best = people_ops.best_person(rows, named, threshold).select("id", "person_id")
        made = rows.join(best, "id", "left").withColumn("created_at", F.lit(now).cast("bigint"))
        top = vectors.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        added = ordered_index(made.select(F.col("id").alias("face_id"), "vector"), "face_id", name="k").select(
            (F.col("k") + top + 1).alias("id"), F.lit(None).cast("bigint").alias("media_item_id"), "face_id", F.lit(model).alias("model"), "vector", F.lit(now).cast("bigint").alias("created_at")
        )
        processed = incremental.mark_processed(cache, media, media_ids, "faces", model, now)
        self.commit_all({"faces": kept_faces.unionByName(made.select(faces.columns)), "embeddings": kept_vectors.unionByName(added), "media_processing_cache": processed})

    def replace_embeddings(self, made: DataFrame, now: int | None = None) -> None:
        """One vector for each (media_item_id, model) of ``made``; others stay. With columns
        ``size_bytes`` and ``modified_at``, these are of the files that the vectors were made
        of; else the media items tell. Tables grow with the catalog and this runs for each
        chunk, so they are joined by merging: no part of them is sent to the driver.
        """
        now = now or int(time.time())
        vectors, cache = self.read("embeddings"), self.read("media_processing_cache")
        keep = vectors.join(made.select("media_item_id", "model").hint("merge"), ["media_item_id", "model"], "left_anti").select(vectors.columns)
        rows = self._next_ids("embeddings", made.select("media_item_id", "model", "vector"), "media_item_id", "model").select("id", "media_item_id", F.lit(None).cast("bigint").alias("face_id"), "model", "vector", F.lit(now).cast("bigint").alias("created_at"))
        keys, file = ["media_item_id", "processor", "model"], ["size_bytes", "modified_at"]
        if set(file) <= set(made.columns):
            done = made.select("media_item_id", "model", *file).distinct()
        else:
            media = self.read("media_items").select(F.col("id").alias("media_item_id"), *file)
            done = made.select("media_item_id", "model").distinct().join(media.hint("merge"), "media_item_id")
        done = done.withColumn("processor", F.lit("embeddings")).withColumn("processed_at", F.lit(now).cast("bigint"))
        processed = cache.join(done.select(keys).hint("merge"), keys, "left_anti").select(cache.columns).unionByName(done)
        self.commit_all({"embeddings": keep.unionByName(rows), "media_processing_cache": processed})

    def update_faces(self, contents: DataFrame, make, model: str = FACE_MODEL, threshold: float = FACE_THRESHOLD, now: int | None = None) -> DataFrame:
        """Finds faces in the images that need it and makes them anew, but for files with
        errors, which stay as they are and are tried again the next time. ``contents``
        (path, content), ``make`` a FaceModel. Returns ``(media_item_id, error)``.
        """
        from mediashoal.plans.filters import processing_scope
        from mediashoal.sources.kernels import detect_faces

        images = processing_scope(self.read("media_items"), images_only=True)
        todo = incremental.needs_processing(images, self.read("media_processing_cache"), "faces", model).select("id", "path")
        files = todo.join(contents.select("path", "content"), "path").select("id", "content")
        found, errors = detect_faces(files, make)
        done = materialize(files.select("id").join(errors, files["id"] == errors["media_item_id"], "left_anti").distinct(), "with-faces")
        self.replace_faces(done, found, model, threshold, now)
        return errors

    def update_embeddings(self, contents: DataFrame, make, chunk: int = 256, now: int | None = None) -> dict[str, int | str | None]:
        """Embeds the files that need it, in one job whatever their number. In order of id
        they are chunks of ``chunk`` files, committed in this order, one chunk first and then
        twice as many each time, up to the first with a failure; what is committed stays, and
        the rest comes again the next time, as do items that the provider can't take, which
        are skipped. ``contents`` (path, content). Returns ``embedded, skipped, error``.
        """
        from mediashoal.plans.filters import processing_scope
        from mediashoal.sources.kernels import canonical_model, embed_files, embedding_counters

        model = canonical_model(make().model)
        scope = processing_scope(self.read("media_items"))
        todo = incremental.needs_processing(scope, self.read("media_processing_cache"), "embeddings", model).select("id", "path", "size_bytes", "modified_at")
        # chunks are counted over files that have contents, by ids alone; contents are read once more, to be embedded
        found = todo.join(contents.select("path"), "path", "left_semi").drop("path")
        places = ordered_index(found, "id", name="k").select("id", F.floor(F.col("k") / chunk).alias("chunk"), "size_bytes", "modified_at")
        files = todo.join(contents.select("path", "content"), "path").select("id", "content")
        made = materialize(embed_files(files, make, failures=True).join(places, "id"), "embedded")
        ends = made.agg(F.max("chunk").alias("last"), F.min(F.when(F.col("failed").isNotNull(), F.struct("chunk", "id", "failed"))).alias("failure")).first()
        failure = ends["failure"]
        until = failure["chunk"] if failure else -1 if ends["last"] is None else ends["last"] + 1
        out: dict[str, int | str | None] = {"embedded": 0, "skipped": 0, "error": failure and failure["failed"]}
        first, size = 0, 1
        while first < until:
            own = made.where((F.col("chunk") >= first) & (F.col("chunk") < min(first + size, until)))
            try:
                self.replace_embeddings(own.where("vector is not null").select(F.col("id").alias("media_item_id"), "model", "vector", "size_bytes", "modified_at"), now)
            except Exception as e:  # noqa: BLE001  what went wrong is the result; earlier chunks stay
                out["error"] = f"{type(e).__name__}: {e}"
                break
            counted = embedding_counters(own).first()
            out["embedded"] += counted["embedded"]
            out["skipped"] += counted["skipped"]
            first, size = first + size, size * 2
        return out

    # --- media and caches

    def scan(self, listing: DataFrame, errors: int = 0) -> DataFrame:
        """Upserts what is new or changed, marks what is gone, returns the counters."""
        media = self.read("media_items")
        diff = materialize(incremental.scan_diff(listing, media), "diff")
        now_missing = media.where("not missing").join(listing.select("path"), "path", "left_anti").count()
        summary = incremental.scan_summary(diff, now_missing, errors).first().asDict()
        self.commit("media_items", incremental.mark_missing(incremental.upsert_media(media, diff.where("action <> 'unchanged'")), listing))
        return self.spark.createDataFrame([summary], "scanned bigint, imported bigint, skipped bigint, missing bigint, errors bigint")

    def mark_missing(self, listing: DataFrame) -> None:
        self.commit("media_items", incremental.mark_missing(self.read("media_items"), listing))

    def backfill(self, model: str = FACE_MODEL) -> None:
        self.commit("media_processing_cache", incremental.backfill_cache(self.read("media_processing_cache"), self.read("media_items"), self.read("embeddings"), self.read("faces"), model))

    def update_cleanup_cache(self, updates: DataFrame) -> None:
        self.commit("cleanup_file_cache", incremental.upsert_cleanup_cache(self.read("cleanup_file_cache"), updates))

    def clear_cleanup_cache(self) -> int:
        cache = self.read("cleanup_file_cache")
        n = cache.count()
        self.commit("cleanup_file_cache", cache.limit(0))
        return n

    def compact_vectors(self, legacy: DataFrame) -> None:
        """Stores vectors that were text or bytes, ``(id, json)`` or ``(id, blob)``, as arrays."""
        from mediashoal.functions.vectors import legacy_vector, parse_blob

        vectors = self.read("embeddings")
        new = legacy.select("id", (legacy_vector(F.col("json")) if "json" in legacy.columns else parse_blob(F.col("blob"))).alias("parsed"))
        self.commit("embeddings", vectors.join(new, "id", "left").withColumn("vector", F.coalesce("parsed", "vector")).select(vectors.columns))
