import math
import random

import pytest
from pyspark.sql import functions as F

from mediashoal.functions import geo
from mediashoal.plans import clustered, filters
from mediashoal.plans.clustered import Clustered
from mediashoal.plans.filters import SearchFilter

KIND = "id bigint, path string, file_name string, media_type string, captured_at bigint, modified_at bigint, created_at bigint, missing boolean, latitude double, longitude double"


def made_up(n=1500):
    rng = random.Random(8)
    out = []
    for i in range(n):
        folder = rng.choice(["beach", "Städte", "a_b", "100%", "zoo/deep"])
        name = f"Pic{i:05}.JPG"
        date = rng.choice([None, 1000 + rng.randrange(400)])
        place = (None, None) if i % 7 == 0 else (rng.uniform(-90, 90), rng.choice([rng.uniform(-180, 180), 180.0, -180.0]))
        out.append((i, f"/{folder}/{name}", name, "image", date, None, None, False, *place))
    return [*out, (9000, "/x/y.jpg", "y.jpg", "image", 5, None, None, False, 90.0, 180.0), (9001, "/x/z.jpg", "z.jpg", "image", 5, None, None, False, -90.0, -180.0)]


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(made_up(), KIND).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_texts_open_files_with_their_trigrams(spark, media, tmp_path):
    table = Clustered.build(media, f"{tmp_path}/t", "path", files=15)
    for query, fewer in (("STÄdte", False), ("pic0012", False), ("beach/Pic001", True), ("zoo%PIC01", True), ("a_b", False), ("qqq", True), ("x/y", True), ("%", False), ("ab", False), ("100%/p", False)):
        f = SearchFilter(query=query, limit=500)
        assert ids(table.search(f)) == ids(filters.search_media(media, f)), query
        assert not fewer or len(table.opened) <= 5, (query, len(table.opened))
    assert clustered.required_grams(" aB%cdE_fghi ") == ["cde", "fgh", "ghi"] and clustered.required_grams("a_b") == []


def test_circles_open_files_of_their_cells(spark, media, tmp_path):
    table = Clustered.build(media, f"{tmp_path}/p", "place", files=16)
    for lat, lng, radius in ((10, 20, 900), (0, 0, 50), (89, 0, 500), (-89.9, 170, 50), (5, 179.9, 700), (0, 0, 30000), (-90, -180, 1)):
        f = SearchFilter(lat=float(lat), lng=float(lng), radius_km=float(radius), limit=500)
        assert ids(table.search(f)) == ids(filters.search_media(media, f))
        assert radius > 900 or abs(lat) > 80 or len(table.opened) < 8
    dated = SearchFilter(from_ts=1100, to_ts=1120, limit=500)
    by_date = Clustered.build(media, f"{tmp_path}/d2", "date", files=16)
    assert ids(by_date.search(dated)) == ids(filters.search_media(media, dated)) and len(by_date.opened) < 4


def test_covers_hold_their_box():
    rng = random.Random(1)
    for _ in range(200):
        south, west = rng.uniform(-90, 89), rng.uniform(-180, 179)
        north, east = min(90, south + 10 ** rng.uniform(-3, 2)), min(180, west + 10 ** rng.uniform(-3, 2.3))
        ranges = geo.cover(south, north, west, east)
        assert len(ranges) <= geo.RANGES and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        for _ in range(20):
            lat, lng = rng.uniform(south, north), rng.uniform(west, east)
            y, x = (min(math.floor((v - low) / span * (1 << geo.LEVELS)), (1 << geo.LEVELS) - 1) for v, span, low in ((lat, 180, -90), (lng, 360, -180)))
            z = sum((y >> k & 1) << 2 * k + 1 | (x >> k & 1) << 2 * k for k in range(geo.LEVELS))
            assert any(low <= z <= high for low, high in ranges)


def test_pages_open_few_files(spark, media, tmp_path):
    table = Clustered.build(media, f"{tmp_path}/d", "date", files=20)
    everything, at, seen = ids(media.where(filters.listed()).orderBy(F.col("captured_at").desc_nulls_last(), F.col("id").desc())), (2**62, 0), []
    dates = {r["id"]: r["captured_at"] for r in media.collect()}
    for turn in range(8):
        page = ids(table.page_after(SearchFilter(), *at, 200))
        assert len(table.opened) <= 6
        seen += page
        at = (dates[page[-1]], page[-1]) if page else at
    assert seen == everything
    rare = SearchFilter(query="pic00123")
    assert ids(table.page_after(rare, 2**62, 0, 5)) == ids(filters.page_after(filters.matching(media, rare), 2**62, 0, 5))


def test_near_centres_equals_brute_force(spark, media):
    centres = [(k, lat, lng, r) for k, (lat, lng, r) in enumerate([(10.0, 20.0, 900.0), (89.5, 3.0, 400.0), (0.0, 179.5, 800.0), (0.0, 0.0, 20000.0), (-40.0, -70.0, 3.0), (91.0, 0.0, 5.0), (5.0, 5.0, -1.0), (5.0, 5.0, None)])]
    got = {(r["centre_id"], r["id"]) for r in clustered.near_centres(media, spark.createDataFrame(centres, "centre_id int, lat double, lng double, radius_km double")).collect()}
    expected = set()
    for k, lat, lng, r in centres:
        if geo.valid(lat, lng, r):
            expected |= {(k, i) for i in ids(media.where(geo.within(F.col("latitude"), F.col("longitude"), lat, lng, r)))}
    assert got == expected


def test_empty_tables(spark, media, tmp_path):
    table = Clustered.build(media.limit(0), f"{tmp_path}/e", "date")
    assert table.search(SearchFilter(query="abc")).count() == 0 and table.page_after(SearchFilter(), None, 5).count() == 0
    assert clustered.near_centres(media, spark.createDataFrame([], "centre_id int, lat double, lng double, radius_km double")).count() == 0
