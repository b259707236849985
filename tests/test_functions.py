import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashoal.functions import dates, geo, rules, vectors


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", list: "array<float>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "path,expected",
    [("a/b.jpg", False), (".trash/d.jpg", True), ("x/Backup/e.jpg", True), ("x/backups/e.jpg", False), ("mybackup.jpg", False), ("x/.hid", True), ("__MACOSX/a.jpg", True), ("iPod Photo Cache/a.jpg", True)],
)
def test_excluded_paths(spark, path, expected):
    assert one(spark, rules.is_excluded(F.col("p")), p=path) is expected


def test_binary_vectors(spark):
    rng = random.Random(8)
    numbers = [0.0, 1.0, -1.0, 0.1, 3.4028234663852886e38, 1.401298464324817e-45, -1.1754943508222875e-38, 2.0**-126, 1 - 2.0**-24, 2.0**24, float("inf"), -float("inf")]
    numbers += [struct.unpack("<f", rng.randbytes(4))[0] for _ in range(300)]
    numbers = [x for x in numbers if x == x]
    blob = struct.pack(f"<{len(numbers)}f", *numbers)
    df = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(b"[1, 2.5]")), (3, bytearray(b"[12]")), (4, bytearray(b"abcde")), (5, bytearray(b"")), (6, None), (7, bytearray(b"[\x01\xeb\xbd"))], "id int, b binary")
    got = {r["id"]: r["v"] for r in df.select("id", vectors.parse_blob(F.col("b")).alias("v")).collect()}
    assert got[1] == list(struct.unpack(f"<{len(numbers)}f", blob)) and got[2] == [1.0, 2.5] and got[3] == [12.0]
    assert got[4] is None and got[5] == [] and got[6] is None
    assert got[7] == list(struct.unpack("<f", b"[\x01\xeb\xbd"))  # begins like a list, but is none
    back = df.where("id = 1").select(vectors.vector_blob(vectors.parse_blob(F.col("b"))).alias("x")).first()["x"]
    assert bytes(back) == blob


def test_bytes_that_begin_with_a_list(spark):
    """A list that ends before the bytes do is none; ``from_json`` alone stops at its bracket."""
    numbers = [b"[]\x96\xbd\x9c\\\x99\xbd", b"[5]\x3d", b"[ ]\x3d", b"[1,2]  x", b"[]]]", b"[[]]", b"[]\xc2\x85"]
    lists = {b"[1, 2] \n": [1.0, 2.0], b"[]  ": [], b"[1, 2.5]\r\n\t": [1.0, 2.5], b" [-1.5e1]": [-15.0], b"[1, 2]x": None}
    cases = [*numbers, *lists]
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(cases)], "id int, b binary")
    got = {cases[r["id"]]: r["v"] for r in df.select("id", vectors.parse_blob(F.col("b")).alias("v")).collect()}
    assert {b: got[b] for b in numbers} == {b: None if len(b) % 4 else list(struct.unpack(f"<{len(b) // 4}f", b)) for b in numbers}
    assert {b: got[b] for b in lists} == lists
    assert math.isnan(one(spark, vectors.legacy_vector(F.col("t")), t='["NaN", 2]')[0])  # as to_json writes it
    assert one(spark, vectors.legacy_vector(F.col("t")), t="[1, 2] and more") is None
    assert one(spark, vectors.legacy_vector(F.col("t")), t=json.dumps([0.5] * 20_000)) == [0.5] * 20_000


@pytest.mark.parametrize("ext,kind", [("JPG", "image"), ("..png", "image"), ("m2ts", "video"), ("txt", None), ("", None), (None, None)])
def test_media_type(spark, ext, kind):
    assert one(spark, rules.media_type(F.col("e")), e=ext) == kind


@pytest.mark.parametrize("name,ext", [("a.JPG", "jpg"), (".jpg", None), ("a.b.mp4", "mp4"), ("none", None), ("a.", None)])
def test_extension(spark, name, ext):
    assert one(spark, rules.extension(F.col("n")), n=name) == ext


def test_face_tile_prefix_and_clean_path(spark):
    tile = rules.is_face_tile(F.col("n"), F.col("k"))
    assert one(spark, tile, n="FaceTile_1.jpg", k="image") and not one(spark, tile, n="FaceTile_1.mp4", k="video") and not one(spark, tile, n="face.jpg", k="image")
    assert one(spark, rules.clean_path(F.col("p")), p="\\\\?\\C:\\a") == "C:\\a"
    under = rules.under_root(F.col("p"), "/a/b/")
    assert one(spark, under, p="/a/b/c") and one(spark, under, p="/a/b") and not one(spark, under, p="/a/bc")


@pytest.mark.parametrize("pattern,value,hit", [("a_c", "xABCx", True), ("a~c", "a~c", True), ("a~c", "abc", False), ("50%x", "50 yx", True), ("a\\b", "a\\b", True), ("É", "é", False), ("é", "É", False), ("", "any", True)])
def test_like_is_ascii_insensitive_with_live_wildcards(spark, pattern, value, hit):
    assert one(spark, rules.like(F.col("v"), pattern), v=value) is hit


@pytest.mark.parametrize("path,name,kind,listed", [("/x/mybackup.jpg", "mybackup.jpg", "image", False), ("/x/ab__macosx", "c.jpg", "image", False), ("/x/12macosx/c.jpg", "c.jpg", "image", False), ("/.h/c.jpg", "c.jpg", "image", True), ("/h/.c.jpg", ".c.jpg", "image", False), ("/h/facetile.mp4", "facetile.mp4", "video", True)])
def test_listed_is_by_substring(spark, path, name, kind, listed):
    assert one(spark, rules.is_listed(F.col("p"), F.col("n"), F.col("k")), p=path, n=name, k=kind) is listed


def test_geo(spark):
    assert not any(geo.valid(*x) for x in ((91, 0, 1), (0, 181, 1), (0, 0, 0), (0, 0, -1), (0, 0, math.nan), (0, 0, math.inf), (None, 0, 1)))
    assert geo.bounding_box(89.9, 0, 100) == (pytest.approx(89.9 - 100 / 111.32), 90.0, None, None)
    assert geo.bounding_box(60, 0, 1000)[3] == pytest.approx(1000 / (111.32 * 0.5))
    near = lambda box: geo.within(F.col("a"), F.col("b"), 0.0, 0.0, 100.0, box)
    edge = 0.8985  # due north, inside the distance and outside the box
    assert not one(spark, near(True), a=edge, b=0.0) and one(spark, near(False), a=edge, b=0.0)
    assert one(spark, geo.haversine(F.col("a"), F.col("b"), 0.0, 0.0), a=0.0, b=180.0) == pytest.approx(math.pi * geo.EARTH_KM)


def test_box_and_distance_is_within_distance(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(2000)], "a double, b double")
    for lat, lng, r in ((10.0, 20.0, 3000.0), (-89.0, 0.0, 500.0), (0.0, 179.0, 800.0)):
        both, far = (geo.within(F.col("a"), F.col("b"), lat, lng, r, box) for box in (True, False))
        assert df.where(both & ~far).count() == 0


def test_cosines(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 33)).astype(np.float32)
    exact = float(a.astype(float) @ b.astype(float) / np.linalg.norm(a.astype(float)) / np.linalg.norm(b.astype(float)))
    pair = {"a": a.tolist(), "b": b.tolist()}
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), **pair) == pytest.approx(exact, abs=1e-12)
    assert one(spark, vectors.cosine_to(F.col("a"), b.tolist()), a=a.tolist()) == pytest.approx(exact, abs=1e-12)
    dot, na, nb = np.float32(0), np.float32(0), np.float32(0)
    for x, y in zip(a, b, strict=True):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    assert one(spark, vectors.cosine_f32(F.col("a"), F.col("b")), **pair) == float(dot / (np.sqrt(na) * np.sqrt(nb)))
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0, 0.0]) is None
    assert one(spark, vectors.l2_normalize(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.l2_normalize(F.col("a")), a=[0.0]) == [0.0]
    assert one(spark, vectors.legacy_vector(F.col("t")), t="[1, 2.5]") == [1.0, 2.5]


@pytest.mark.parametrize("a,b,bits", [("00", "0f", 4), ("ff", "00", 8), ("ffffffffffffffff", "0", 64), ("zz", "00", None), ("0fzz", "00", None), ("", "0", None), ("1" * 17, "0", None), ("F0", "f0", 0)])
def test_hamming(spark, a, b, bits):
    assert one(spark, vectors.hamming(F.col("a"), F.col("b")), a=a, b=b) == bits


@pytest.mark.parametrize("text,seconds", [("2020:01:02 03:04:05", 1577934245), ("2020-01-02 03:04:05", 1577934245), ("2020/01/02", None), ("2020:13:02 03:04:05", None), (None, None)])
def test_exif_seconds(spark, text, seconds):
    assert one(spark, dates.exif_seconds(F.col("t")), t=text) == seconds


@pytest.mark.parametrize("ts,month", [(0, "unknown"), (1577836799, "2019-12"), (1577836800, "2020-01")])
def test_month(spark, ts, month):
    assert one(spark, dates.month_key(F.col("t")), t=ts) == month
