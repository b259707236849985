import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashoal.operators import clusters, duplicates, incremental
from mediashoal.operators.graph import connected_components
from mediashoal.operators.ranking import ordered_index
from mediashoal.schemas import CLEANUP_CACHE, MEDIA

FILE = "path string, sha256 string, size_bytes bigint, captured_at bigint, modified_at bigint, created_at bigint, width bigint, height bigint"


def keeper(spark, *rows):
    files = spark.createDataFrame([(p, "h", s, c, m, None, w, 1) for p, c, m, w, s in rows], FILE)
    return duplicates.exact_groups(files).first()["keep_path"]


def test_keeper_rules(spark):
    assert keeper(spark, ("large-later.jpg", 20, None, 4000, 1), ("small-earlier.jpg", 10, None, 1000, 1)) == "small-earlier.jpg"
    assert keeper(spark, ("small.jpg", 10, None, 1000, 1), ("large.jpg", 10, None, 4000, 1)) == "large.jpg"
    assert keeper(spark, ("a", None, None, 9, 9), ("b", None, 5, 1, 1)) == "b"
    assert keeper(spark, ("a", 1, None, None, 1), ("b", 1, None, None, 2)) == "b"
    assert keeper(spark, ("b", None, None, None, None), ("a", None, None, None, None)) == "a"


def brute_greedy(rows):
    """The anchor rule file by file, in each bucket of one ahash."""

    def bits(a, b):
        try:
            return (int(a, 16) ^ int(b, 16)).bit_count() if a and b and len(a) <= 16 and len(b) <= 16 and a.isalnum() and b.isalnum() else 65
        except ValueError:
            return 65

    out, used = [], set()
    for h in {r[1] for r in rows}:
        bucket = sorted(r for r in rows if r[1] == h)
        for i, a in enumerate(bucket):
            if a[0] in used:
                continue
            near = [(b, bits(a[2], b[2]), bits(a[3], b[3])) for b in bucket[i + 1 :] if b[0] not in used]
            near = [(b, p + d) for b, p, d in near if p <= 6 and d <= 8 and bits(a[1], b[1]) <= 10]
            if near:
                used |= {a[0], *(b[0] for b, _ in near)}
                out += [(x[0], a[0], max(s for _, s in near)) for x in [a, *(b for b, _ in near)]]
    return sorted(out)


def test_visual_groups_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"/p/{k:03}", rng.choice(["00ff", "ff00", "zz"]), f"{rng.getrandbits(5) << rng.randrange(4):04x}", rng.choice(["000f", "00ff", "0fff", "bad!", "ffff"])) for k in range(150)]
    got = duplicates.visual_members(spark.createDataFrame(rows, "path string, ahash string, phash string, dhash string")).collect()
    assert sorted(map(tuple, got)) == brute_greedy(rows)


def test_hot_buckets_are_grouped_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BUCKET_ROWS", 7)
    rng = random.Random(5)
    rows = [(f"/p/{k:03}", rng.choice(["00ff", "00ff", "00ff", "aa"]), f"{rng.getrandbits(6) << rng.randrange(8):04x}", rng.choice(["000f", "00ff", "0fff", "ffff"])) for k in range(120)]
    got = duplicates.visual_members(spark.createDataFrame(rows, "path string, ahash string, phash string, dhash string")).collect()
    assert sorted(map(tuple, got)) == brute_greedy(rows)


def test_stretches_and_rounds_are_few(spark, monkeypatch):
    """Twenty times the first stretch: three more stretches, and rounds by the chains in them."""
    monkeypatch.setattr(duplicates, "BUCKET_ROWS", 60)
    rng = random.Random(6)
    rows = [(f"/p/{k:05}", "00ff", f"{rng.getrandbits(12) << rng.randrange(20):08x}", f"{rng.getrandbits(10):04x}") for k in range(1200)]
    classes = duplicates.print_classes(spark.createDataFrame(rows, "path string, ahash string, phash string, dhash string"))
    rounds = []
    got = duplicates._hot(classes, rounds).collect()
    assert len(rounds) <= 3 and max(rounds) <= 12
    first = {}
    for path, h, p, d in rows:
        first.setdefault((p, d), path)
    taken = {r["first"]: (r["anchor"], r["score"]) for r in got}
    expected = {x: (a, s) for x, a, s in brute_greedy(rows) if x in first.values()}
    assert taken == expected


def test_dependency_rounds(spark):
    """A chain decides one after the other, a star at once, whatever the order of edges."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "a bigint, b bigint")
    star = spark.createDataFrame([(0, k) for k in range(1, 9)] + [(k, k + 1) for k in range(1, 8)], "a bigint, b bigint")
    rounds = []
    assert sorted(r["b"] for r in duplicates._taken(chain, rounds).collect()) == [1, 3, 5]
    assert sorted(r["b"] for r in duplicates._taken(star, rounds).collect()) == list(range(1, 9))
    assert duplicates._taken(chain.limit(0), rounds).count() == 0 and rounds == [3, 1, 0]


def test_a_large_bucket_runs():
    rng = np.random.default_rng(9)
    p, d = rng.integers(0, 2**63, 20_000, np.uint64), rng.integers(0, 2**63, 20_000, np.uint64)
    p[1::2], d[1::2] = p[::2] ^ np.uint64(5), d[::2] ^ np.uint64(9)
    taken, anchors, scores = duplicates.greedy(p, d, np.ones(len(p), np.int64))
    assert sorted(taken.tolist()) == list(range(len(p))) and set(scores.tolist()) == {4} and len(set(anchors.tolist())) == len(p) // 2


def brute_pairs(rows):
    """Pairs of the first paths of equal hash triples."""
    first = {}
    for path, *key in sorted(rows):
        first.setdefault(tuple(int(x, 16) if k else x for k, x in enumerate(key)), path)
    out = []
    for (a, p, d), x in first.items():
        for (b, q, e), y in first.items():
            if x < y and a == b and (p ^ q).bit_count() <= 6 and (d ^ e).bit_count() <= 8:
                out.append((x, y, (p ^ q).bit_count() + (d ^ e).bit_count()))
    return sorted(out)


def test_visual_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"/p/{k:03}", rng.choice(["00ff", "ff00"]), f"{rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64):016x}", rng.choice(["000f", "00ff", "0fff", "8" + "0" * 15])) for k in range(150)]
    rows += [(r[0] + "x", *r[1:]) for r in rows[:20]] + [("/bad", "00ff", "zz", "0")]
    got = duplicates.visual_pairs(spark.createDataFrame(rows, "path string, ahash string, phash string, dhash string")).collect()
    assert sorted(map(tuple, got)) == brute_pairs(rows[:-1]) and len(got) > 50


def test_visual_chain_is_not_transitive(spark):
    rows = [("a", "0", "0", "0"), ("b", "0", "3f", "0"), ("c", "0", "fff", "0")]
    got = duplicates.visual_members(spark.createDataFrame(rows, "path string, ahash string, phash string, dhash string"))
    assert sorted((r["path"], r["anchor"]) for r in got.collect()) == [("a", "a"), ("b", "a")]
    pairs = duplicates.visual_pairs(spark.createDataFrame(rows, "path string, ahash string, phash string, dhash string"))
    assert sorted((r["path_a"], r["path_b"]) for r in pairs.collect()) == [("a", "b"), ("b", "c")]


def brute_components(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], [(random.Random(3).randrange(50), k) for k in range(50)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, *edges[:3]], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == brute_components(edges)
    back = df.select(F.col("b").alias("a"), F.col("a").alias("b"))
    assert {r["node"]: r["component"] for r in connected_components(back, "a", "b").collect()} == got


def test_similar_pairs_and_clusters(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(100, [0.0] * 4), (101, [1.0]), (102, [2.0]), (103, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0

    stored = {r["id"]: r["vector"] for r in df.collect() if r["vector"]}
    want = {(a, b) for a in stored for b in stored if a < b and len(stored[a]) == len(stored[b]) and cos(stored[a], stored[b]) >= 0.9}
    for block_rows in (5, 4096):
        pairs = clusters.similar_pairs(df, 0.9, block_rows=block_rows).collect()
        assert {(r["a"], r["b"]) for r in pairs} == want and len(pairs) == len(want)
    got = {r["id"]: (r["component"], r["cluster_id"]) for r in clusters.clusters(df, 0.9).collect()}
    label = brute_components(sorted(want))
    components = {k: label.get(k, k) for k, _ in rows}
    numbers = {c: n for n, c in enumerate(sorted(set(components.values())))}
    assert got == {k: (c, numbers[c]) for k, c in components.items()}


def test_ordered_index(spark):
    df = spark.range(1000).repartition(7).select(F.reverse(F.col("id").cast("string")).alias("s"))
    got = ordered_index(df, "s").collect()
    assert [r["s"] for r in sorted(got, key=lambda r: r["index"])] == sorted(str(k)[::-1] for k in range(1000)) and {r["index"] for r in got} == set(range(1000))


def small_media(spark, rows):
    return spark.createDataFrame([tuple({"id": i, "path": p, "file_name": p, "media_type": "image", "size_bytes": s, "modified_at": m, "imported_at": 1, "missing": x}.get(f) for f in MEDIA.names) for i, p, s, m, x in rows], MEDIA)


LISTED = "path string, file_name string, media_type string, size_bytes bigint, modified_at bigint, imported_at bigint"


def test_upsert_is_idempotent(spark):
    media = small_media(spark, [(1, "a", 1, 1, False), (2, "b", None, None, False), (3, "c", 3, 3, True), (4, "gone", 1, 1, False)])
    listing = spark.createDataFrame([("a", "a", "image", 1, 1, 9), ("b", "b", "image", None, None, 9), ("c", "c", "image", 3, 3, 9), ("z", "z", "image", 5, 5, 9), ("d", "d", "image", 5, 5, 9)], LISTED)
    diff = incremental.scan_diff(listing, media)
    assert {r["path"]: r["action"] for r in diff.collect()} == {"a": "unchanged", "b": "unchanged", "c": "new", "z": "new", "d": "new"}
    after = incremental.upsert_media(media, diff.where("action <> 'unchanged'"))
    rows = {r["path"]: (r["id"], r["imported_at"], r["missing"]) for r in after.collect()}
    assert rows == {"a": (1, 1, False), "b": (2, 1, False), "c": (3, 1, False), "gone": (4, 1, False), "d": (5, 9, False), "z": (6, 9, False)}
    again = incremental.scan_diff(listing, after)
    assert again.where("action <> 'unchanged'").count() == 0
    marked = incremental.mark_missing(after, listing)
    assert [r["path"] for r in marked.where("missing").collect()] == ["gone"]


def cache(spark, *rows):
    return spark.createDataFrame(rows, CLEANUP_CACHE)


def test_cleanup_cache_halves(spark):
    old = cache(spark, ("a", 1, 1, "s", 2, 2, "a", "d", "p", 0), ("b", 1, 1, "s", 2, 2, "a", "d", "p", 0))
    updates = cache(spark, ("a", 1, 1, "new", None, None, None, None, None, 5), ("b", 2, 1, None, 9, 9, "x", "y", "z", 5), ("c", 1, 1, None, None, None, None, None, None, 5), ("d", 1, None, "h", None, None, None, None, None, 5), ("e", 1, 1, "s", 1, 1, "a", "d", "p", 5))
    got = {r["path"]: (r["sha256"], r["ahash"], r["updated_at"]) for r in incremental.upsert_cleanup_cache(old, updates).collect()}
    assert got == {"a": ("new", "a", 5), "b": (None, "x", 5), "d": ("h", None, 5)}


def test_freshness_is_null_safe(spark):
    media = small_media(spark, [(1, "a", None, None, False), (2, "b", 1, 1, False), (3, "c", 1, 2, False)])
    done = spark.createDataFrame([(1, "p", "m", None, None), (2, "p", "m", 1, None), (3, "p", "x", 1, 2)], "media_item_id bigint, processor string, model string, size_bytes bigint, modified_at bigint")
    assert sorted(r["id"] for r in incremental.needs_processing(media, done, "p", "m").collect()) == [2, 3]
