import pytest

from mediashoal.operators import people, vector_search
from mediashoal.plans import filters
from mediashoal.plans.filters import SearchFilter
from mediashoal.schemas import EMBEDDINGS, FACES, MEDIA, PEOPLE

BASE = {"missing": False, "media_type": "image", "imported_at": 1}


def media(spark, *rows):
    made = [{**BASE, "id": k, "path": f"/m/{k}.jpg", "file_name": f"{k}.jpg", **r} for k, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r.get(f) for f in MEDIA.names) for r in made], MEDIA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_order_and_pages(spark):
    df = media(spark, {}, {"captured_at": 5}, {"modified_at": 5}, {"created_at": 9, "modified_at": 1}, {"captured_at": 0})
    assert ids(filters.search_media(df, SearchFilter())) == [3, 2, 4, 5, 1]
    assert ids(filters.search_media(df, SearchFilter(sort_order="AsC"))) == [1, 5, 4, 2, 3]
    assert ids(filters.search_media(df, SearchFilter(sort_order="up", limit=2, offset=1))) == [2, 4]
    assert ids(filters.search_media(df, SearchFilter(limit=0))) == [3] and len(ids(filters.search_media(df, SearchFilter(limit=501, offset=-1)))) == 5
    seen, last = [], None
    while rows := (filters.page(df, limit=2) if last is None else filters.page_after(df, last[0], last[1], 2)).withColumn("ts", filters.sort_ts()).collect():
        seen += [r["id"] for r in rows]
        last = (rows[-1]["ts"], rows[-1]["id"])
    assert seen == [3, 2, 4, 5, 1]


def test_predicates(spark):
    df = media(spark, {"camera_make": "Canon"}, {"camera_model": "X-T5"}, {"camera_make": "NIKON", "camera_model": "D5"}, {}, {"latitude": 1.0}, {"latitude": 1.0, "longitude": 2.0, "missing": True})
    found = lambda **f: sorted(ids(filters.search_media(df, SearchFilter(**f))))
    assert found(camera="canon") == [] and found(camera="x-t") == [2] and found(camera="on d5") == [3]
    assert found(has_camera=True) == [1, 2, 3] and found(has_camera=False) == [4, 5, 6]
    assert found(has_gps=True) == [6] and found(has_gps=False) == [1, 2, 3, 4, 5]
    assert found(missing=True) == [6] and found(query="  ") == [1, 2, 3, 4, 5, 6] and found(query="3.J") == [3]
    assert found(from_ts=0) == [] and found(lat=91.0, lng=0.0, radius_km=1.0) == [1, 2, 3, 4, 5, 6]
    assert found(lat=1.0, lng=2.0, radius_km=1.0) == [6]
    assert ids(filters.processing_scope(df, ids=df.where("id in (2, 6)").select("id"))) == [2]


def test_form():
    f = SearchFilter.from_form({"query": "", "from": "2020-01-01", "to": "2020-01-01", "lat": 1.0, "lng": 2.0, "radius_km": 5.0}, tz="Europe/Berlin", page=2)
    assert (f.query, f.to_ts - f.from_ts, f.from_ts, f.has_gps, f.limit, f.offset) == (None, 86399, 1577833200, True, 120, 240)


def faces_people(spark):
    faces = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 2, None), (4, 3, 2), (5, 4, 1)], "id bigint, media_item_id bigint, person_id bigint")
    return faces, spark.createDataFrame([(1, "Ann", 0), (2, "Bob", 0), (3, "ann", 0)], PEOPLE)


def test_person_filters(spark):
    df = media(spark, {}, {}, {}, {})
    faces, persons = faces_people(spark)
    found = lambda **f: sorted(ids(filters.search_media(df, SearchFilter(**f), faces, persons)))
    assert found(person_id=2) == [1, 3] and found(person_name=" ANN ") == [1, 4] and found(person_name=" ") == [1, 3, 4]
    assert found(person_id=2, person_name="ann") == []
    assert [(r["name"], r["face_count"]) for r in people.list_people(persons, faces).collect()] == [("Ann", 2), ("Bob", 2), ("ann", 0)]


def test_best_person_and_propagate(spark):
    named = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 8, [1.0, 0.0]), (3, 9, [0.0, 1.0]), (4, 9, [1.0])], "named_id bigint, person_id bigint, named_vector array<float>")
    new = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 0.0]), (12, [1.0, 1.0])], "id bigint, vector array<float>")
    got = {r["id"]: r["person_id"] for r in people.best_person(new, named, 0.7).collect()}
    assert got == {10: 7, 12: 7}
    for block_rows in (1, 2):
        assert {r["id"]: r["person_id"] for r in people.best_person(new, named, 0.7, block_rows).collect()} == got
    assert people.best_person(new.limit(0), named).count() == people.best_person(new, named.limit(0)).count() == 0
    assert people.best_person_for([1.0, 0.0], named, 1.0).first()["person_id"] == 7
    faces = spark.createDataFrame([(1, 1, None, [1.0, 0.0]), (2, 2, None, [0.6, 0.8]), (3, 3, 5, [1.0, 0.0]), (4, 2, None, [0.0, 0.0])], "id bigint, media_item_id bigint, person_id bigint, vector array<float>")
    assert ids(people.propagate(faces, [1.0, 0.0], 1, 0.6)) == [2]


def test_semantic_search(spark):
    df = media(spark, {}, {"missing": True}, {"path": "/x/backup/3.jpg"}, {})
    rows = [(1, 1, None, "a", [1.0, 0.0], 0), (2, 1, None, "b", [0.0, 1.0], 0), (3, 2, None, "a", [1.0, 1.0], 0), (4, 3, None, "a", [1.0, 0.0], 0), (5, 4, None, "a", [1.0], 0), (6, None, 1, "a", [1.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, EMBEDDINGS)
    found = lambda *a, **k: [(r["id"], round(r["score"], 3)) for r in vector_search.search_semantic(df, vectors, *a, **k).collect()]
    assert found([1.0, 0.0]) == [(1, 1.0), (2, 0.707), (1, 0.0)]
    assert found([1.0, 0.0], 1) == [(1, 1.0)] and found([1.0, 0.0], 0, model="a") == [(1, 1.0)]
    assert found([1.0, 0.0], pre_filter=df.where("id = 2")) == [(2, 0.707)]
    called = []
    none = vector_search.search_semantic_text(df, vectors, "x", lambda t: called.append(t) or [1.0, 0.0], "zzz")
    assert none.count() == 0 and not called
    assert vector_search.search_semantic_text(df, vectors, "x", lambda t: [0.0, 1.0], "b").first()["id"] == 1


def test_plans_have_what_they_should(spark, tmp_path):
    df = media(spark, {"latitude": 1.0, "longitude": 2.0})
    df.write.parquet(f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    plan = filters.search_media(stored, SearchFilter(media_type="image", lat=1.0, lng=2.0, radius_km=5.0))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(latitude" in plan and "EqualTo(media_type,image)" in plan


@pytest.mark.parametrize("schema", [FACES, MEDIA])
def test_map_points_of_an_empty_table(spark, schema):
    assert filters.map_points(spark.createDataFrame([], MEDIA)).count() == 0
