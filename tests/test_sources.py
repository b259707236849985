import hashlib
import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashoal.sources import files, kernels
from mediashoal.sources.exif import orientation, read_exif


def tiff(order="<", make="Canon", taken="2020:01:02 03:04:05", gps=True):
    """A small TIFF block with an EXIF and a GPS folder."""
    data = bytearray(b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)

    def folder(fields, extra):
        at = len(data)
        heap = at + 2 + 12 * len(fields) + 4
        body, blob = struct.pack(order + "H", len(fields)), b""
        for tag, kind, count, raw in fields:
            if raw is None:
                raw = struct.pack(order + "I", extra[tag])
            if len(raw) > 4:
                body += struct.pack(order + "HHII", tag, kind, count, heap + len(blob))
                blob += raw
            else:
                body += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        return body + struct.pack(order + "I", 0) + blob

    text = lambda s: (s + "\0").encode()
    deg = lambda *v: b"".join(struct.pack(order + "II", int(x * 100), 100) for x in v)
    main = [(0x010F, 2, len(make) + 1, text(make)), (0x0110, 2, 3, text("R5")), (0x8769, 4, 1, None), *([(0x8825, 4, 1, None)] if gps else [])]
    size = len(folder(main, {0x8769: 0, 0x8825: 0}))
    start = len(data) + size
    inner = [(0x9003, 2, len(taken) + 1, text(taken)), (0xA434, 2, 8, text("RF 50mm"))]
    place = [(1, 2, 2, text("S")), (2, 5, 3, deg(10, 30, 36)), (3, 2, 2, text("W")), (4, 5, 3, deg(20, 15, 0))]
    # offsets inside the later folders count from the block's start, so lay them out in turn
    head = folder(main, {0x8769: start, 0x8825: 0})
    whole = data + head
    data[:] = whole
    second = folder(inner, {})
    data += second
    third_at = len(data)
    if gps:
        data += folder(place, {})
        fixed = bytearray(data)
        where = fixed.find(struct.pack(order + "HHI", 0x8825, 4, 1))
        fixed[where + 8 : where + 12] = struct.pack(order + "I", third_at)
        return bytes(fixed)
    return bytes(data)


def jpeg(block):
    return b"\xff\xd8\xff\xe0\0\4xx\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xda"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("t") / "root"
    for d in ("b", ".trash", "Backup", "empty", "empty2/inner"):
        (root / d).mkdir(parents=True)
    (root / "a.jpg").write_bytes(jpeg(tiff()))
    (root / "b/c.PNG").write_bytes(b"png")
    (root / "b/facetile1.jpg").write_bytes(b"t")
    (root / ".trash/d.jpg").write_bytes(b"d")
    (root / "Backup/e.jpg").write_bytes(b"e")
    (root / "notes.txt").write_text("n")
    for n in ("dup1.jpg", "dup2.jpg"):
        (root / n).write_bytes(b"same")
    (root / "link.jpg").symlink_to(root / "a.jpg")
    return root


def names(df, root):
    return sorted(r["path"].removeprefix(f"{root}/") for r in df.collect())


def test_discovery(spark, tree):
    entries = files.listing(spark, [str(tree), str(tree / "b"), "/no/such", str(tree / "a.jpg")]).cache()
    assert names(files.media_files(entries, 5), tree) == ["a.jpg", "b/c.PNG", "dup1.jpg", "dup2.jpg"]
    row = files.media_files(entries, 5).where("file_name = 'c.PNG'").first()
    assert (row["extension"], row["media_type"], row["size_bytes"], row["imported_at"]) == ("png", "image", 3, 5) and row["modified_at"] > 0
    assert files.media_files(entries, 5, max_files=2).count() == 2
    assert {r["path"] for r in files.errors(entries).collect()} == {"/no/such", str(tree / "a.jpg")}


def test_ignored_and_empty(spark, tree):
    entries = files.listing(spark, [str(tree)]).cache()
    got = {r["path"].removeprefix(f"{tree}/"): r["reason"].split()[0] for r in files.ignored_files(entries).collect()}
    assert got == {".trash/d.jpg": "Inside", "Backup/e.jpg": "Inside", "b/facetile1.jpg": "Facetile"}
    assert [r["path"].removeprefix(f"{tree}/") for r in files.empty_folders(entries).collect()] == ["empty2/inner", "empty"]
    assert files.canonical_folder(str(tree / "b" / "..")) == str(tree) and files.canonical_folder("/no/such") is None


def test_digests_and_exif(spark, tree):
    content = files.contents(spark, [str(tree)])
    got = {r["path"].removeprefix(f"{tree}/"): r["sha256"] for r in files.digests(content).collect()}
    assert got["dup1.jpg"] == got["dup2.jpg"] == hashlib.sha256(b"same").hexdigest()
    rows = {r["path"].removeprefix(f"{tree}/"): r for r in files.with_exif(content).collect()}
    a = rows["a.jpg"]
    assert (a["camera_make"], a["camera_model"], a["lens_model"], a["captured_at"]) == ("Canon", "R5", "RF 50mm", 1577934245)
    assert (a["latitude"], a["longitude"]) == (pytest.approx(-10.51), pytest.approx(-20.25))
    assert json.loads(a["metadata_json"])["latitude"] == pytest.approx(-10.51)
    b = rows["b/c.PNG"]
    assert b["camera_make"] is None and json.loads(b["metadata_json"]) == dict.fromkeys(["make", "model", "lens_model", "captured_at", "latitude", "longitude"])


def test_exif_reader_is_robust():
    for order in "<>":
        assert read_exif(tiff(order))["lat"] == [10.0, 30.0, 36.0]
    assert "lat" not in read_exif(tiff(gps=False))
    whole = jpeg(tiff())
    for k in range(0, len(whole), 3):
        assert isinstance(read_exif(whole[:k]), dict)
    assert read_exif(b"") == read_exif(b"\xff\xd8\xff\xda") == {}


def test_vectors_and_paths(spark, tmp_path):
    (tmp_path / "v.json").write_text("[[1, 2], [3]]")
    (tmp_path / "w.json").write_text('{"data": {"embeddings": [[5]]}}')
    assert [r["vector"] for r in files.load_vectors(spark, str(tmp_path / "v.json")).collect()] == [[1.0, 2.0], [3.0]]
    assert [r["vector"] for r in files.load_vectors(spark, str(tmp_path / "w.json")).collect()] == [[5.0]]
    media = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "path string, missing boolean")
    made = spark.createDataFrame([("a", "a.jpg"), ("b", "b.jpg")], "path string, converted string")
    assert {r["path"]: r["display_path"] for r in files.display_paths(media, made).collect()} == {"a": "a.jpg", "b": None, "c": None}
    key = spark.range(1).select(files.conversion_key(F.lit("/a"), F.lit(5), F.lit(7))).first()[0]
    assert key == hashlib.sha256(b"/a|5|7").hexdigest()


def lanczos(rows, m, along):
    """Resampling of rows (or columns) cell by cell."""
    lines = rows if along else list(map(list, zip(*rows, strict=True)))
    n, out = len(lines[0]), []
    scale = n / m
    wide = max(1.0, scale)
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    for line in lines:
        made = []
        for k in range(m):
            centre = (k + 0.5) * scale
            cells = range(max(0, int(centre - 3 * wide + 0.5)), min(n, int(centre + 3 * wide + 0.5)))
            x = [(c + 0.5 - centre) / wide for c in cells]
            w = [sinc(v) * sinc(v / 3) if abs(v) < 3 else 0.0 for v in x]
            made.append(min(255, max(0, math.floor(sum(a * line[c] for a, c in zip(w, cells, strict=True)) / sum(w) + 0.5))))
        out.append(made if n != m else line)
    return out if along else list(map(list, zip(*out, strict=True)))


def png(rows, channels, kind, filters=(0,), palette=None):
    """A PNG with lines filtered in turn by the given filters."""
    step = channels
    above, raw = [0] * len(rows[0]), b""
    for y, line in enumerate(rows):
        f, coded = filters[y % len(filters)], []
        for k, v in enumerate(line):
            left, up, corner = line[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            coded.append((v - (0, left, up, (left + up) // 2, paeth)[f]) & 255)
        raw, above = raw + bytes([f, *coded]), line
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", len(rows[0]) // channels, len(rows), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + (part(b"PLTE", palette) if palette else b"") + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(6)
    for channels, kind in ((1, 0), (2, 4), (3, 2), (4, 6)):
        pixels = rng.integers(0, 256, (9, 7, channels), np.uint8)
        got = kernels.read_image(png(pixels.reshape(9, -1).tolist(), channels, kind, (0, 1, 2, 3, 4)))
        assert np.array_equal(got, kernels.grey_of(pixels) if channels >= 3 else pixels[..., 0])
    palette = rng.integers(0, 256, (4, 3), np.uint8)
    index = rng.integers(0, 4, (3, 5), np.uint8)
    assert np.array_equal(kernels.read_image(png(index.tolist(), 1, 3, (4,), palette.tobytes())), kernels.grey_of(palette[index]))
    white = np.full((1, 1, 3), 255, np.uint8)
    assert kernels.grey_of(white)[0, 0] == 255
    with pytest.raises(ValueError):
        kernels.read_image(b"GIF89a")
    grey = np.tile(np.arange(40, dtype=np.uint8), (20, 1))
    assert kernels.bounded_width(grey, 10).shape == (5, 10) and kernels.bounded_width(grey, 40) is grey and kernels.bounded_width(grey, None) is grey
    assert np.array_equal(kernels.read_pgm(kernels.write_pgm(grey)), grey)


def test_hashes():
    flat = np.full((40, 50), 7, np.uint8)
    assert kernels.average_hash(flat) == "f" * 16 and kernels.difference_hash(flat) == "0" * 16
    ramp = np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    assert kernels.average_hash(ramp) == "0f" * 8 and kernels.difference_hash(ramp) == "f" * 16
    assert kernels.difference_hash(ramp[:, ::-1]) == "0" * 16
    basis = kernels._dct(32)
    assert np.allclose(basis @ basis.T, np.eye(32))
    assert len(kernels.frequency_hash(ramp)) == 16 and kernels.hex_bits(np.array([1, 0, 0, 0, 1])) == "11"
    rng = np.random.default_rng(5)
    for shape, size in (((4, 4), (2, 2)), ((41, 70), (8, 9)), ((7, 5), (32, 32)), ((64, 8), (8, 8))):
        grey = rng.integers(0, 256, shape)
        assert np.array_equal(kernels.resize(grey, *size), lanczos(lanczos(grey.tolist(), size[1], True), size[0], False))
    grid = np.arange(6).reshape(2, 3)
    assert [kernels.turned(grid, k).tolist() for k in (3, 6, 8)] == [np.rot90(grid, 2).tolist(), np.rot90(grid, -1).tolist(), np.rot90(grid).tolist()]


def test_fingerprints_keep_errors_by_file(spark):
    pgm = b"P5 8 8 255\n" + bytes(range(64))
    rows = kernels.fingerprints(spark.createDataFrame([("a", bytearray(pgm)), ("b", bytearray(b"nope")), ("c", None)], "path string, content binary")).collect()
    got = {r["path"]: (r["width"], r["error"] is None) for r in rows}
    assert got == {"a": (8, True), "b": (None, False), "c": (None, False)}


class Sideways:
    """Reads the grey image that stands behind a file's EXIF block."""

    def __call__(self, content):
        return kernels.read_pgm(content[content.index(b"P5") :])


def test_fingerprints_are_of_the_upright_image(spark):
    grey = np.random.default_rng(7).integers(0, 256, (12, 20)).astype(np.uint8)
    block = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<I", 0)
    content = jpeg(block) + kernels.write_pgm(grey)
    assert orientation(content) == 6 and orientation(b"") == orientation(b"II*") == 1
    row = kernels.fingerprints(spark.createDataFrame([("a", bytearray(content))], "path string, content binary"), Sideways()).first()
    upright = np.rot90(grey, -1)
    assert (row["width"], row["height"], row["dhash"], row["phash"]) == (12, 20, kernels.difference_hash(upright), kernels.frequency_hash(upright))


def test_conversions(spark, tmp_path):
    rows = [("/a.HEIC", "HEIC", 3, 5, bytearray(b"one")), ("/b.heif", "heif", 3, 5, bytearray(b"bad")), ("/c.png", "png", 1, 1, None), ("/d", None, 1, 1, None)]
    df = spark.createDataFrame(rows, "path string, extension string, size_bytes bigint, modified_ns bigint, content binary")

    def encode(data):
        if data == b"bad":
            raise ValueError("broken")
        return b"jpeg " + data

    for _ in range(2):  # the second time the file is there
        got = {r["path"]: (r["converted"], r["error"]) for r in files.convert(df, f"{tmp_path}/cache/", encode).collect()}
        target = f"{tmp_path}/cache/{hashlib.sha256(b'/a.HEIC|3|5').hexdigest()}.jpg"
        assert got == {"/a.HEIC": (target, None), "/b.heif": (None, "ValueError: broken"), "/c.png": ("/c.png", None), "/d": ("/d", None)}
        assert open(target, "rb").read() == b"jpeg one" and len(list((tmp_path / "cache").iterdir())) == 1
    media = spark.createDataFrame([("/a.HEIC", True), ("/x", False)], "path string, missing boolean")
    shown = files.shown_paths(media, files.convert(df, f"{tmp_path}/cache", encode))
    assert {r["path"]: r["display_path"] for r in shown.collect()} == {"/a.HEIC": target, "/x": "/x"}


def test_models_refuse_what_they_do_not_take(spark):
    kernels.register_provider("far", kernels.HashEmbedder, {"words": ("text",), "eyes": ("image", "application/pdf")})
    try:
        assert ("far", "eyes") in kernels.list_models("FAR ")
        assert "text only" in kernels.refusal("far", "words", "image/png") and kernels.refusal("far", "eyes", "application/pdf") is None
        assert "unknown" in kernels.refusal("far", "eyes", None) and "video/mp4" in kernels.refusal("far", "eyes", "video/mp4") and "no model" in kernels.refusal("far", "x", None)
    finally:
        kernels.PROVIDERS.pop("far")
        kernels.MODELS.pop("far")
    df = spark.createDataFrame([(k, bytearray(b"abc"), m) for k, m in enumerate(["image/png", "audio/x", None])], "id bigint, content binary, mime string")
    made = {r["id"]: r["error"] for r in kernels.embed_files(df, kernels.provider("local"), batch=1).collect()}
    assert made[0] is None and made[1].startswith("unsupported: audio/x") and made[2].startswith("unsupported")


def test_face_models_may_go_on_without_a_device(spark):
    class Plain:
        def faces(self, content):
            if content == b"bad":
                raise ValueError("really")
            return [(0.0, 0.0, 2.0, 2.0, 1.0, [1.0])]

    class OnDevice:
        def faces(self, content):
            raise RuntimeError("device lost")

        def without_device(self):
            return Plain()

    df = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"bad"))], "id bigint, content binary").coalesce(1)
    found, errors = kernels.detect_faces(df, OnDevice)
    assert [r["media_item_id"] for r in found.collect()] == [1] and [r["error"] for r in errors.collect()] == ["really"]


def test_skipping_excluded_folders(spark, tree):
    entries = files.listing(spark, [str(tree)], skip_excluded=True)
    assert not any("/.trash/" in r["path"] or "/Backup/" in r["path"] for r in entries.collect())
    assert names(files.media_files(entries, 5), tree) == ["a.jpg", "b/c.PNG", "dup1.jpg", "dup2.jpg"]


def test_bisecting_isolates_bad_items():
    calls = []

    def embed(items):
        calls.append(len(items))
        if any(i == b"bad" for i in items):
            raise ValueError("no")
        return [[float(len(i))] for i in items]

    got = kernels.bisected([b"a", b"bad", b"ccc", b"dd"], embed)
    assert [v for v, _ in got] == [[1.0], None, [3.0], [2.0]] and got[1][1].startswith("unsupported") and calls == [4, 2, 1, 1, 2]
    assert kernels.bisected([], embed) == []


def test_embedding_and_faces(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b""))], "id bigint, content binary")
    made = kernels.embed_files(df, kernels.provider(" LOCAL "))
    rows = {r["id"]: r for r in made.collect()}
    assert sum(x * x for x in rows[1]["vector"]) == pytest.approx(1, abs=1e-6) and rows[2]["error"].startswith("unsupported")
    assert tuple(kernels.embedding_counters(made).first()) == (1, 1)
    assert kernels.list_models("Local") == [("local", "hash")] and kernels.canonical_model("m-vision") == "m"
    with pytest.raises(ValueError):
        kernels.provider("none")
    with pytest.raises(ValueError):
        kernels.face_setup_ids(list(range(26)))

    class Model:
        def faces(self, content):
            if not content:
                raise ValueError("empty")
            return [(1.0, 2.0, 0.2, 5.0, 0.9, [1.0])]

    found, errors = kernels.detect_faces(df, Model)
    assert [(r["media_item_id"], r["width"], r["height"]) for r in found.collect()] == [(1, 1.0, 5.0)]
    assert [r["media_item_id"] for r in errors.collect()] == [2]
