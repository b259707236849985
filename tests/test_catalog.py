import os
import shutil
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from mediashoal import catalog_queries, storage  # noqa: F401  the first adds to the queries below
from mediashoal.plans import cleanup
from mediashoal.plans.catalog import Catalog, CatalogError
from mediashoal.queries import QUERIES
from mediashoal.schemas import CLEANUP_CACHE, EMBEDDINGS, FACES, MEDIA, TABLES
from mediashoal.sources.kernels import HashEmbedder
from mediashoal.streaming.ingest import ProgressState, ProgressTable, _stream_id, ingest_listings, progress_counts, stream_progress


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/catalog")


def media_rows(spark, *rows):
    made = [{"id": k, "path": f"/m/{k}.jpg", "file_name": f"{k}.jpg", "media_type": "image", "imported_at": 1, "missing": False, **r} for k, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r.get(f) for f in MEDIA.names) for r in made], MEDIA)


def test_open_twice_and_drop(spark, catalog, tmp_path):
    catalog.commit("media_items", media_rows(spark, {}))
    again = Catalog(spark, catalog.root)
    assert again.read("media_items").count() == 1 and all(again.read(t).schema.names == s.names for t, s in TABLES.items())
    catalog.drop()
    assert not os.path.exists(tmp_path / "catalog")


def test_folders(catalog, tmp_path):
    (tmp_path / "a").mkdir()
    catalog.add_library_folder(str(tmp_path / "a"))
    catalog.add_library_folder(str(tmp_path / "a" / "." ))
    assert catalog.get_settings() == [str(tmp_path / "a")]
    with pytest.raises(CatalogError):
        catalog.add_library_folder(str(tmp_path / "none"))
    catalog.update_settings(["/y", "/x", "/y"])
    assert catalog.get_settings() == ["/x", "/y"]
    catalog.remove_library_folder("/x")
    assert catalog.get_settings() == ["/y"]


def seeded(spark, catalog):
    catalog.commit("media_items", media_rows(spark, {}, {}, {}))
    faces = [(1, 1, None, 0.0, 0.0, 1.0, 1.0, 0.9, 0), (2, 2, None, 0.0, 0.0, 1.0, 1.0, 0.9, 0), (3, 3, None, 0.0, 0.0, 1.0, 1.0, 0.9, 0), (4, 1, None, 0.0, 0.0, 1.0, 1.0, 0.9, 0), (5, 3, None, 0.0, 0.0, 1.0, 1.0, 0.9, 0)]
    catalog.commit("faces", spark.createDataFrame(faces, FACES))
    vectors = [(1, None, 1, "f", [0.0, 1.0], 0), (2, None, 1, "f", [1.0, 0.0], 0), (3, None, 2, "f", [1.0, 0.1], 0), (4, None, 3, "f", [0.0, 1.0], 0), (5, None, 4, "f", [1.0, 0.0], 0)]
    catalog.commit("embeddings", spark.createDataFrame(vectors, EMBEDDINGS))


def people_of(catalog):
    return {r["id"]: r["person_id"] for r in catalog.read("faces").collect()}


def test_naming_and_people(spark, catalog):
    seeded(spark, catalog)
    assert catalog.name_face(1, " Ann ") == 1
    assert people_of(catalog) == {1: 1, 2: 1, 3: None, 4: None, 5: None}
    assert catalog.person("Ann") == 1 and catalog.person("  ") == 2 and catalog.person("Unnamed") == 2
    with pytest.raises(CatalogError):
        catalog.name_face(5, "Zed")
    with pytest.raises(CatalogError):
        catalog.name_face(99, "Zed")
    assert [r["name"] for r in catalog.list_people().collect()] == ["Ann", "Unnamed"]
    catalog.rename_person(1, " Anna ")
    catalog.rename_person(77, "x")
    assert [r["name"] for r in catalog.list_people().collect()] == [" Anna ", "Unnamed"]
    catalog.delete_person(1)
    assert set(people_of(catalog).values()) == {None}
    with pytest.raises(CatalogError):
        catalog.delete_person(1)


def test_faces_made_anew_are_identified(spark, catalog):
    seeded(spark, catalog)
    catalog.name_face(1, "Ann")
    found = spark.createDataFrame([(1, 5.0, 5.0, 2.0, 2.0, 0.8, [2.0, 0.0]), (1, 1.0, 5.0, 2.0, 2.0, 0.8, [0.0, 3.0])], "media_item_id bigint, x double, y double, width double, height double, confidence double, vector array<float>")
    catalog.replace_faces(spark.createDataFrame([(1,)], "id bigint"), found, now=9)
    rows = {r["id"]: (r["media_item_id"], r["person_id"]) for r in catalog.read("faces").collect()}
    assert rows == {2: (2, 1), 3: (3, None), 5: (3, None), 6: (1, None), 7: (1, 1)}
    assert sorted(r["face_id"] for r in catalog.read("embeddings").collect()) == [2, 3, 6, 7]
    assert catalog.read("media_processing_cache").first()["processor"] == "faces"


def test_embeddings_caches_and_backfill(spark, catalog):
    seeded(spark, catalog)
    made = spark.createDataFrame([(1, "clip", [1.0]), (2, "clip", [2.0])], "media_item_id bigint, model string, vector array<float>")
    catalog.replace_embeddings(made, now=3)
    catalog.replace_embeddings(made.where("media_item_id = 1").withColumn("vector", F.array(F.lit(9.0).cast("float"))), now=4)
    got = {r["media_item_id"]: list(r["vector"]) for r in catalog.read("embeddings").where("model = 'clip'").collect()}
    assert got == {1: [9.0], 2: [2.0]} and catalog.read("media_processing_cache").count() == 2
    catalog.backfill("face")
    catalog.backfill("face")
    assert catalog.read("media_processing_cache").groupBy("processor").count().orderBy("processor").collect()[1]["count"] == 3
    catalog.compact_vectors(spark.createDataFrame([(1, "[5, 6]")], "id bigint, json string"))
    assert catalog.read("embeddings").where("id = 1").first()["vector"] == [5.0, 6.0]
    catalog.update_cleanup_cache(spark.createDataFrame([("a", 1, 1, "s", None, None, None, None, None, 1)], CLEANUP_CACHE))
    assert catalog.clear_cleanup_cache() == 1 and catalog.clear_cleanup_cache() == 0


def test_compacted_bytes_that_begin_with_a_list(spark, tmp_path):
    """The bytes of a vector's first number may be ``[]`` and two more, and a vector may be empty."""
    first = struct.unpack("<f", b"[]\x96\xbd")[0]
    rows = [(0, [first, 0.25], 0), (1, [first, 0.5], 0), (2, [], 0), (3, [], 0), (4, None, 0), (5, [1.0], 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["second"] for r in QUERIES["compact_vectors"](spark, str(tmp_path)).collect()}
    assert got == {0: 0.25, 1: 0.5, 2: None, 3: None, 4: None, 5: None}


LISTED = "path string, file_name string, media_type string, size_bytes bigint, modified_at bigint, imported_at bigint"


def listed(spark, *paths, size=1):
    return spark.createDataFrame([(p, p.rpartition("/")[2], "image", size, 1, 7) for p in paths], LISTED)


def test_scan_counters(spark, catalog):
    first = catalog.scan(listed(spark, "/a", "/b")).first()
    assert (first["scanned"], first["imported"], first["skipped"], first["missing"]) == (2, 2, 0, 0)
    second = catalog.scan(listed(spark, "/b", "/c"), errors=2).first()
    assert tuple(second) == (2, 1, 1, 1, 2)


def test_stream_equals_batch(spark, catalog, tmp_path):
    listed(spark, "/a", "/b").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    source, seen = f"{tmp_path}/in/*", []
    listener = ProgressTable()
    spark.streams.addListener(listener)
    run = lambda: ingest_listings(catalog, source, listed(spark, "/x").schema, f"{tmp_path}/check", lambda n, d: seen.append((n, {r["action"]: r["count"] for r in d.collect()})))
    run()
    listed(spark, "/b", "/c", size=2).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    run()
    for _ in range(100):  # events arrive on their own thread
        if sum(r[1] == "progress" for r in listener.rows) >= 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert seen == [(0, {"new": 2}), (1, {"changed": 1, "new": 1})]
    assert sorted((r["path"], r["size_bytes"]) for r in catalog.read("media_items").collect()) == [("/a", 1), ("/b", 2), ("/c", 2)]
    assert catalog.last_batch(_stream_id(spark, f"{tmp_path}/check")) == 1 and listener.table(spark).where("event = 'progress'").count() >= 2
    events = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 2)], "event_id bigint, event_type string, user_id bigint")
    assert progress_counts(events).where("event_type = 'a'").first()["users"] == 1


def test_sources_with_streams_of_their_own(spark, catalog, tmp_path):
    """Batch 0 of a second stream, of a new checkpoint in an old place too, is no repeat of the first's."""
    schema = listed(spark, "/x").schema
    for k, path in enumerate(("/a", "/b", "/c")):
        listed(spark, path).write.parquet(f"{tmp_path}/in{k}/1")
        ingest_listings(catalog, f"{tmp_path}/in{k}/*", schema, f"{tmp_path}/check{k % 2}-{k}")
    assert {r["path"] for r in catalog.read("media_items").collect()} == {"/a", "/b", "/c"}
    catalog.person("Ann")  # other commits keep what streams have done
    before = catalog.read("media_items").inputFiles()
    shutil.rmtree(f"{tmp_path}/check0-0/commits")  # as after a failure between the commit and Spark's own note
    ingest_listings(catalog, f"{tmp_path}/in0/*", schema, f"{tmp_path}/check0-0")
    assert catalog.read("media_items").inputFiles() == before


def test_progress_survives_restarts_and_empty_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ProgressState, "EVERY", 3)
    schema = "event_id bigint, event_type string, user_id bigint"
    rows, seen = [], []
    for k in range(8):
        new = [(10 * k + j, "ab"[j % 2], (k * j) % 3) for j in range(4)] + [(1000 - k, "late", None)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.parquet(f"{tmp_path}/events/{k}")
        for _ in range(1 + k % 2):
            got = stream_progress(spark, f"{tmp_path}/events/*", spark.createDataFrame([], schema).schema, f"{tmp_path}/check")
            seen.append(sorted(map(tuple, got.collect())))
            assert seen[-1] == sorted(map(tuple, progress_counts(spark.createDataFrame(rows, schema)).collect()))
    assert len(seen) == 12


def test_writers_do_not_overwrite_each_other(spark, catalog, tmp_path):
    other = Catalog(spark, catalog.root)
    catalog.person("Ann")
    stale = other.read("people")
    assert catalog.person("Bob") == 2
    with pytest.raises(CatalogError, match="meanwhile"):
        other.commit_all({"people": stale.limit(0), "faces": other.read("faces")})
    assert [r["name"] for r in catalog.list_people().collect()] == ["Ann", "Bob"]
    assert catalog.vacuum(older_than=3600) == 0
    assert catalog.vacuum(older_than=-5) == 4  # two old tables of people, and two refused
    assert [r["name"] for r in Catalog(spark, catalog.root).list_people().collect()] == ["Ann", "Bob"]


class Faces:
    """A face for each byte; a file of x is an error."""

    def faces(self, content):
        if content == b"x":
            raise ValueError("no image")
        return [(float(k), 0.0, 1.0, 1.0, 0.9, [1.0, float(b)]) for k, b in enumerate(content)]


def test_faces_are_updated_where_needed(spark, catalog):
    catalog.commit("media_items", media_rows(spark, {}, {}, {"media_type": "video"}, {"missing": True}, {}))
    contents = spark.createDataFrame([(f"/m/{k}.jpg", bytearray(c)) for k, c in ((1, b"ab"), (2, b"x"), (3, b"a"), (4, b"a"), (5, b""))], "path string, content binary")
    assert [tuple(r) for r in catalog.update_faces(contents, Faces, now=5).collect()] == [(2, "no image")]
    assert sorted(r["media_item_id"] for r in catalog.read("faces").collect()) == [1, 1]
    assert sorted(r["media_item_id"] for r in catalog.read("media_processing_cache").collect()) == [1, 5]
    assert [r["media_item_id"] for r in catalog.update_faces(contents, Faces, now=6).collect()] == [2]
    assert catalog.read("faces").count() == 2 and catalog.read("embeddings").where("model <> 'x'").count() == 2


def test_embeddings_are_committed_by_chunks(spark, catalog):
    catalog.commit("media_items", media_rows(spark, *[{}] * 5))
    contents = spark.createDataFrame([(f"/m/{k}.jpg", bytearray(b"" if k == 2 else b"abc")) for k in range(1, 6)], "path string, content binary")
    good, calls = catalog.replace_embeddings, []

    def failing(made, now=None):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("full")
        good(made, now)

    catalog.replace_embeddings = failing
    assert catalog.update_embeddings(contents, HashEmbedder, chunk=2) == {"embedded": 1, "skipped": 1, "error": "OSError: full"}
    assert [r["media_item_id"] for r in catalog.read("embeddings").collect()] == [1]
    catalog.replace_embeddings = good
    assert catalog.update_embeddings(contents, HashEmbedder, chunk=2) == {"embedded": 3, "skipped": 1, "error": None}
    assert sorted(r["media_item_id"] for r in catalog.read("embeddings").collect()) == [1, 3, 4, 5]


def test_one_job_for_all_chunks(spark, catalog, monkeypatch):
    rows = spark.createDataFrame([(f"/m/{k:02}.jpg", "image", k) for k in range(40)], "path string, media_type string, size_bytes bigint")
    media = rows.withColumn("id", F.col("size_bytes") + 1).withColumn("file_name", F.substring("path", 4, 9)).withColumn("missing", F.lit(False))
    catalog.commit("media_items", media.select([F.col(f.name) if f.name in media.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["media_items"].fields]))
    contents = rows.select("path", F.concat(F.lit("c"), "size_bytes").cast("binary").alias("content"))
    commits = []
    good = catalog.replace_embeddings
    monkeypatch.setattr(catalog, "replace_embeddings", lambda made, now: (commits.append(made.count()), good(made, now))[1])
    assert catalog.update_embeddings(contents, HashEmbedder, chunk=4) == {"embedded": 40, "skipped": 0, "error": None}
    assert commits == [4, 8, 16, 12] and catalog.read("embeddings").count() == 40


def test_chunks_are_committed_without_broadcasts_of_tables(spark, catalog, monkeypatch):
    catalog.commit("media_items", media_rows(spark, *[{"size_bytes": 3, "modified_at": k} for k in range(6)]))
    contents = spark.createDataFrame([(f"/m/{k}.jpg", bytearray(b"abc")) for k in range(1, 7)], "path string, content binary")
    plans, good = [], catalog.commit_all

    def commit_all(tables, batch=None):
        plans.append({n: df._jdf.queryExecution().executedPlan().toString() for n, df in tables.items()})
        good(tables, batch)

    monkeypatch.setattr(catalog, "commit_all", commit_all)
    assert catalog.update_embeddings(contents, HashEmbedder, chunk=2) == {"embedded": 6, "skipped": 0, "error": None}
    assert len(plans) == 2
    for plan in plans:
        assert "Broadcast" not in plan["media_processing_cache"] and "media_items" not in plan["media_processing_cache"]
        assert not [x for x in plan["embeddings"].splitlines() if "BroadcastHashJoin" in x and "LeftAnti" in x]
    assert sorted(tuple(r) for r in catalog.read("media_processing_cache").select("media_item_id", "size_bytes", "modified_at").collect()) == [(k, 3, k - 1) for k in range(1, 7)]
    before = catalog.read("embeddings").count()
    catalog.replace_embeddings(catalog.read("embeddings").where("media_item_id < 3").select("media_item_id", "model", "vector"))
    assert catalog.read("embeddings").count() == before and catalog.read("media_processing_cache").count() == 6


def test_a_provider_that_can_not_be_made(spark, catalog):
    rows = spark.createDataFrame([(1, "/a.jpg", "a.jpg", "image", False)], "id bigint, path string, file_name string, media_type string, missing boolean")
    catalog.commit("media_items", rows.select([F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["media_items"].fields]))
    driver = os.getpid()

    def make():
        if os.getpid() != driver:
            raise OSError("no model here")
        return HashEmbedder()

    contents = spark.createDataFrame([("/a.jpg", bytearray(b"x"))], "path string, content binary")
    assert catalog.update_embeddings(contents, make) == {"embedded": 0, "skipped": 0, "error": "OSError: no model here"}
    assert catalog.read("embeddings").count() == 0


def test_two_writers_lose_nothing(spark, catalog):
    """Both add people at once, and try again when the other was first."""
    errors = []

    def add(letter):
        own = Catalog(spark, catalog.root)
        for k in range(4):
            for _ in range(50):
                try:
                    own.person(f"{letter}{k}")
                    break
                except CatalogError:
                    errors.append(letter)

    threads = [threading.Thread(target=add, args=(x,)) for x in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    people = catalog.list_people().collect()
    assert sorted(r["name"] for r in people) == sorted(f"{x}{k}" for x in "ab" for k in range(4)) and len({r["id"] for r in people}) == 8
    assert not catalog._create(catalog._pointer(1), b"{}")  # a number that is taken stays as it is
    before = catalog._version()
    catalog.add_library_folder("/one", is_dir=lambda _: True)
    assert catalog._version() == before + 1


def test_plans_can_be_cancelled(spark, tmp_path):
    _, plan = plan_for(spark, tmp_path)
    book, none = cleanup.PlanBook(), spark.createDataFrame([], "path string")
    number = book.add(plan)
    assert book.apply(number, none, none).count() == 0
    assert book.cancel(number) and not book.cancel(number)
    with pytest.raises(CatalogError, match="expired"):
        book.apply(number, none, none)


def test_intermediate_tables_go_with_their_scope(spark):
    before = storage.materialize(spark.range(3), "kept")
    with storage.scope(spark):
        inside = storage.materialize(spark.range(4), "gone")
        assert inside.count() == 4
    assert before.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist"):
        spark.read.parquet(inside.inputFiles()[0])


def test_pixels_in_the_cache_keep_no_exact_copy(spark):
    """As in the SQL of the plan: pixels are of fingerprints, so of visual groups only."""
    media = media_rows(spark, *[{"path": f"/m/{n}", "file_name": n, "size_bytes": 10, "captured_at": 1} for n in ("a.jpg", "b.jpg", "v1.jpg", "v2.jpg")])
    prints = [("b.jpg", "h", 640, 480), ("a.jpg", "h", None, None), ("v1.jpg", "1", 4, 4), ("v2.jpg", "2", 640, 480)]
    cache = spark.createDataFrame([(f"/m/{n}", 10, None, h, w, e, w and "00", w and "00", w and "00", 0) for n, h, w, e in prints], CLEANUP_CACHE)
    none = spark.createDataFrame([], "path string, size_bytes bigint, reason string")
    members = cleanup.generate(media, cache, none, none.select("path")).members
    assert {(r["kind"], r["keep_path"]) for r in members.collect()} == {("exact-image", "/m/a.jpg"), ("visual-image", "/m/v2.jpg")}


def plan_for(spark, tmp_path):
    media = media_rows(spark, *[{"path": f"{tmp_path}/{n}", "file_name": n, "size_bytes": 10, "captured_at": k} for k, n in enumerate(["a.jpg", "b.jpg", "c.jpg", "v1.jpg", "v2.jpg", "far.jpg"], 1)])
    cache = spark.createDataFrame([(f"{tmp_path}/a.jpg", 10, None, "h", None, None, None, None, None, 0)], CLEANUP_CACHE)
    hashes = spark.createDataFrame([(f"{tmp_path}/{n}", h) for n, h in (("b.jpg", "h"), ("c.jpg", "h"), ("v1.jpg", "1"), ("v2.jpg", "2"), ("far.jpg", "3"))], "path string, sha256 string")
    prints = spark.createDataFrame([(f"{tmp_path}/{n}", 4, 4, "00", "00", p) for n, p in (("v1.jpg", "00"), ("v2.jpg", "03"), ("far.jpg", "ffff"), ("c.jpg", "00"))], "path string, width bigint, height bigint, ahash string, dhash string, phash string")
    ignored = spark.createDataFrame([(f"{tmp_path}/x.tmp", 5, "why"), (f"{tmp_path}/b.jpg", 10, "why")], "path string, size_bytes bigint, reason string")
    folders = spark.createDataFrame([(f"{tmp_path}/e",), (f"{tmp_path}/e2/f",)], "path string")
    return media, cleanup.generate(media, cache, ignored, folders, [str(tmp_path)], hashes, prints)


def test_plan_and_guards(spark, tmp_path):
    media, plan = plan_for(spark, tmp_path)
    members = {os.path.basename(r["path"]): (r["group_id"], r["is_keeper"], r["score"]) for r in plan.members.collect()}
    assert members == {"a.jpg": ("exact-1", True, None), "b.jpg": ("exact-1", False, None), "c.jpg": ("exact-1", False, None), "v1.jpg": ("visual-1", True, 2), "v2.jpg": ("visual-1", False, 2)}
    totals = plan.totals().first()
    assert (totals["duplicate_groups"], totals["duplicate_files"], totals["duplicate_bytes"], totals["total_bytes"], totals["distinct_bytes"]) == (2, 3, 30, 45, 35)
    ask = lambda *names: spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "path string")
    with pytest.raises(CatalogError, match="every file in duplicate group visual-1"):
        cleanup.apply_plan(plan, ask("v1.jpg", "v2.jpg"), ask())
    with pytest.raises(CatalogError, match="expired"):
        cleanup.apply_plan(None, ask(), ask())
    for n in ("b.jpg", "far.jpg"):
        (tmp_path / n).write_text("x")
    (tmp_path / "e").mkdir()
    inside = spark.createDataFrame([(f"{tmp_path}/e2/f/new", f"{tmp_path}/e2/f")], "path string, parent string")
    manifest = cleanup.apply_plan(plan, ask("b.jpg", "c.jpg", "far.jpg"), ask("e", "e2/f", "other"), inside)
    rows = {r["path"].removeprefix(f"{tmp_path}/"): (r["accepted"], r["reason"].partition(":")[0]) for r in manifest.collect()}
    assert rows == {"b.jpg": (True, "planned"), "c.jpg": (True, "planned"), "far.jpg": (False, "refusing unplanned file deletion"), "e": (True, "planned"), "e2/f": (False, "folder not empty after file cleanup"), "other": (False, "refusing unplanned folder deletion")}
    assert cleanup.execute(manifest).where("done").count() == 0 and (tmp_path / "b.jpg").exists()
    outcome = cleanup.execute(manifest, really=True)
    assert not (tmp_path / "b.jpg").exists() and not (tmp_path / "e").exists() and (tmp_path / "far.jpg").exists()
    assert outcome.where("error is not null").count() == 1
    assert [r["file_name"] for r in cleanup.mark_removed(media, outcome).where("missing").collect()] == ["b.jpg"]
