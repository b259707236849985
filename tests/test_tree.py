import hashlib
import os
import random
import time

from mediashoal.operators import incremental
from mediashoal.sources import files, tree


def brute_digests(rows):
    """(path -> (own, digest, n)) from rows (root, path, parent, is_dir, size, modified, error)."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    folders, leaves = set(), {}
    for root, path, parent, is_dir, size, modified, error in rows:
        at = path if is_dir and error is None else root if path == root else parent
        if not (is_dir and error is None):
            leaves.setdefault(at, []).append("/".join(["f", path.rsplit("/", 1)[1], *["" if x is None else str(x) for x in (size, modified, error)]]))
        while True:
            folders.add(at)
            if at == root:
                break
            at = at.rsplit("/", 1)[0] or "/"

    def fold(texts):
        hashes = [sha(t) for t in texts]
        return sha(",".join(str(sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes)) for k in range(4)))

    out = {}
    for path in sorted(folders, key=lambda p: -len(p.rstrip("/").split("/"))):
        own = leaves.get(path, [])
        inner = [p for p in folders if p != path and (p.rsplit("/", 1)[0] or "/") == path]
        out[path] = fold(own), fold([*own, *[f"d/{p.rsplit('/', 1)[1]}/{out[p][1]}" for p in inner]]), len(own) + sum(out[p][2] for p in inner)
    return out


FIELDS = "root string, path string, parent string, is_dir boolean, size_bytes bigint, modified_at bigint, error string"


def listed(root, seed=3, n=200):
    rng, base = random.Random(seed), root.rstrip("/")
    rows = []
    for k in range(n):
        folder = base + "".join(f"/{rng.choice('abc')}" for _ in range(rng.randrange(4)))
        rows.append((root, f"{folder}/f{k}", folder or "/", False, rng.choice([None, 1, k]), rng.choice([None, 5]), None))
    rows += [rows[0], (root, f"{base}/shut", root, True, None, None, "denied"), (root, f"{base}/e/deep", f"{base}/e", True, None, 1, None)]
    return rows


def test_digests_equal_brute_force(spark):
    for root in ("/lib", "/", "s3://bucket"):
        rows = [*listed(root), *([("/no", "/no", "/", True, None, None, "no such folder")] if root != "/" else [])]  # no root in another
        df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'x' as digest", "'y' as own")
        got = {r["path"]: (r["own"], r["digest"], r["n_files"]) for r in tree.folder_digests(df).collect()}
        assert got == brute_digests(rows)


def test_empty_listing_and_rows_without_a_path(spark):
    assert tree.folder_digests(spark.createDataFrame([], FIELDS)).count() == 0
    assert tree.folder_digests(spark.createDataFrame([("/a", None, None, False, 1, 1, None)], FIELDS)).count() == 0


def test_changes_go_up_and_others_stay(spark):
    rows = listed("/lib")
    path = next(r[1] for r in rows if r[1].count("/") == 5)
    later = [(*r[:4], 99, *r[5:]) if r[1] == path else r for r in rows if not r[1].startswith("/lib/shut")]
    both = [tree.folder_digests(spark.createDataFrame(x, FIELDS)) for x in (rows, later)]
    got = {r["path"]: r["state"] for r in tree.changed_folders(*both).collect()}
    parts = path.split("/")
    ups = {"/".join(parts[:k]) for k in range(2, len(parts) - 1)}
    assert got == {p: "below" for p in ups} | {"/".join(parts[:-1]): "own", "/lib": "own"}


def test_rescan_compares_changed_folders_only(spark):
    rng = random.Random(5)
    media = [(f"/lib/{k % 40}/{k}", rng.choice([None, k]), rng.choice([None, 7]), k % 9 == 0) for k in range(800)]
    there = [m for m in media if not m[3]]
    now = [(p, 1 if p.startswith("/lib/3/") else s, m) for p, s, m, _ in there if not p.startswith("/lib/5/")] + [("/lib/new/x", 1, 1), ("/lib/7/new", None, None)]
    known = spark.createDataFrame(media, "path string, size_bytes bigint, modified_at bigint, missing boolean")
    listing = spark.createDataFrame(now, "path string, size_bytes bigint, modified_at bigint")
    digests = [
        tree.folder_digests(df.selectExpr("'/lib' root", "path", "regexp_replace(path, '/[^/]*$', '') parent", "false is_dir", "size_bytes", "modified_at", "cast(null as string) error"))
        for df in (known.where("not missing"), listing)
    ]
    changed = tree.changed_folders(*digests)
    assert {r["path"] for r in changed.where("state <> 'below'").collect()} == {"/lib/3", "/lib/5", "/lib/7", "/lib/new"}
    wanted = sorted(map(str, incremental.scan_diff(listing, known).select("path", "size_bytes", "action").collect()))
    assert sorted(map(str, tree.rescan_diff(listing, known, changed).select("path", "size_bytes", "action").collect())) == wanted


def as_set(df):
    return sorted(map(str, df.select(*files.NAMES).collect()))


def make(root):
    for d in range(6):
        for e in range(3):
            (root / f"d{d}/e{e}").mkdir(parents=True)
            (root / f"d{d}/e{e}/f.jpg").write_text("x" * d)
    (root / "top.txt").write_text("t")
    past = time.time() - 1000
    for here, folders, names in os.walk(root):
        for n in [*folders, *names]:
            os.utime(os.path.join(here, n), (past, past))


def test_relisting_equals_listing(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    make(root)
    roots = [str(root), str(root / "d1"), "/no/such"]
    before = files.listing(spark, roots).cache()
    assert as_set(tree.relist(spark, roots, before, int(time.time())).entries) == as_set(before)
    (root / "d0/e0/new.jpg").write_text("n")
    (root / "d2/fresh/deep").mkdir(parents=True)
    (root / "d2/fresh/deep/g.jpg").write_text("g")
    (root / "d3/e1/f.jpg").unlink()
    (root / "d4/e2/f.jpg").write_text("written in place")
    os.rename(root / "d5", tmp_path / "gone")
    (root / "d5").symlink_to(tmp_path / "gone")
    done = tree.relist(spark, roots, before, int(time.time()))
    assert as_set(done.entries) == as_set(files.listing(spark, roots))
    states = {r["path"].removeprefix(f"{root}/"): r["state"] for r in done.folders.collect()}
    assert {p for p, s in states.items() if s == "gone"} == {"d5", "d5/e0", "d5/e1", "d5/e2"}
    assert {p for p, s in states.items() if s == "listed"} == {str(root), "d0/e0", "d1", "d2", "d2/fresh", "d2/fresh/deep", "d3/e1"}
    unseen = {r["path"]: r["size_bytes"] for r in tree.relist(spark, roots, before, int(time.time()), check_files=False).entries.collect()}
    assert unseen[str(root / "d4/e2/f.jpg")] == 4 and str(root / "d3/e1/f.jpg") not in unseen


def test_a_folder_that_changed_while_it_was_read_is_listed_again(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    make(root)
    before = files.listing(spark, [str(root)])
    done = tree.relist(spark, [str(root)], before, int(time.time()) - 1001)
    assert done.folders.where("state = 'kept'").count() == 0 and as_set(done.entries) == as_set(before)


def test_nothing_known_and_errors(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    make(root)
    nothing = spark.createDataFrame([], files.ENTRY)
    full = files.listing(spark, [str(root)]).cache()
    assert as_set(tree.relist(spark, [str(root)], nothing, 0).entries) == as_set(full)
    failed = full.unionAll(spark.createDataFrame([(str(root), str(root / "d1/e1"), str(root / "d1"), True, None, None, None, "denied")], files.ENTRY))
    done = tree.relist(spark, [str(root)], failed, int(time.time()))
    assert as_set(done.entries) == as_set(full)
    assert {r["path"] for r in done.folders.where("state = 'listed'").collect()} == {str(root), str(root / "d1"), str(root / "d1/e1")}
