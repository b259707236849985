import json
import os
import time

import pytest

from mediashoal.sources import files, folders


@pytest.fixture(scope="module")
def source(spark):
    folders.register(spark)
    yield lambda **options: spark.read.format("media_folders").options(**options)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("f") / "root"
    for y in range(3):
        for m in ("1", "2", "Backup", ".cache"):
            (root / f"{y}/{m}/x").mkdir(parents=True)
            (root / f"{y}/{m}/x/a.jpg").write_text("a" * y)
            (root / f"{y}/{m}/b.png").write_text("b")
    (root / "top.txt").write_text("t")
    (root / "loop").symlink_to(root)
    return root


def rows(df):
    return sorted(map(str, df.select(*files.NAMES).collect()))


@pytest.mark.parametrize("splits", [1, 3, 64])
def test_equals_the_listing(spark, source, tree, splits):
    got = source(splits=splits).load(str(tree))
    assert got.rdd.getNumPartitions() <= splits
    assert rows(got) == rows(files.listing(spark, [str(tree)]))


def test_errors_and_several_roots(spark, source, tree):
    roots = [str(tree / "0"), str(tree / "1") + "/", "/no/such", str(tree / "top.txt")]
    got = source(roots=json.dumps(roots)).load()
    assert rows(got) == rows(files.listing(spark, roots))
    assert {r["path"] for r in files.errors(got).collect()} == {"/no/such", str(tree / "top.txt")}


def test_excluded_equals_the_rule(source, tree):
    from mediashoal.functions import rules

    got = source().load(str(tree)).withColumn("rule", rules.is_excluded(files._below()))
    assert got.where("excluded <> rule").count() == 0 and got.where("excluded").count() == 3 * 2 * 4


def test_filters_keep_folders_closed(source, tree, tmp_path, monkeypatch):
    """What is pushed down is told by a folder that fails when it is opened."""
    for sub in ("1/Backup", "2/2"):
        os.chmod(tree / sub, 0)
    try:
        everything = source().load(str(tree))
        if everything.where("error is not null").count() == 0:  # root opens any folder
            opened = []
            real = folders._entries
            monkeypatch.setattr(folders, "_entries", lambda r, h: opened.append(h) or real(r, h))
            pruning = folders.Pruning((f"{tree}/1/",), True)
            [*folders._read([(str(tree), str(tree), True)], pruning)]
            assert sorted(h.removeprefix(str(tree)) for h in opened) == ["", "/1", "/1/1", "/1/1/x", "/1/2", "/1/2/x"]
        pruned = everything.where(everything.path.startswith(f"{tree}/1/") & ~everything.excluded)
        assert pruned.where("error is not null").count() == 0
        assert {r["path"].removeprefix(f"{tree}/1/") for r in pruned.collect()} == {"1", "2", "1/x", "2/x", "1/b.png", "2/b.png", "1/x/a.jpg", "2/x/a.jpg"}
    finally:
        for sub in ("1/Backup", "2/2"):
            os.chmod(tree / sub, 0o755)


def test_pushed_filters_reach_the_reader():
    from pyspark.sql.datasource import EqualTo, Not, StringStartsWith

    for f in (EqualTo(("excluded",), False), Not(EqualTo(("excluded",), True))):
        reader = folders.FolderReader(["/a"], 4)
        given = [f, StringStartsWith(("path",), "/a/b"), EqualTo(("is_dir",), True)]
        assert [*reader.pushFilters(given)] == given  # Spark applies them all the same
        assert reader.pruning == folders.Pruning(("/a/b",), True)


def test_addresses_of_a_store(spark, source, tree):
    """The same rows but for addresses, times of creation, and the link, which a store follows."""
    (tree / "loop").unlink()
    try:
        address = f"file://{tree}"
        got = source(splits=5).load(address)
        plain = got.selectExpr("replace(path, 'file://', '') path", "is_dir", "size_bytes", "modified_at")
        wanted = files.listing(spark, [str(tree)]).select("path", "is_dir", "size_bytes", "modified_at")
        assert sorted(map(str, plain.collect())) == sorted(map(str, wanted.collect()))
        assert source().load("file:///no/such/folder").where("error is not null").count() == 1
        assert source().load("what://ever").where("error is not null").count() == 1
    finally:
        (tree / "loop").symlink_to(tree)


def test_stream_goes_on_from_its_checkpoint(spark, source, tmp_path):
    root, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "point")
    (root / "a").mkdir(parents=True)
    (root / "a/1.jpg").write_text("1")
    time.sleep(folders.SETTLE + 1)

    def run():
        stream = spark.readStream.format("media_folders").load(str(root)).writeStream.format("parquet").option("checkpointLocation", point)
        stream.trigger(availableNow=True).start(out).awaitTermination(60)
        return sorted(r["path"].removeprefix(f"{root}/") for r in spark.read.parquet(out).collect())

    assert run() == ["a/1.jpg"]
    assert run() == ["a/1.jpg"]
    (root / "b").mkdir()
    (root / "b/2.jpg").write_text("2")
    (tmp_path / "3.jpg").write_text("3")
    os.utime(tmp_path / "3.jpg", (1, 1))
    os.rename(tmp_path / "3.jpg", root / "b/3.jpg")  # moved in with an old time
    time.sleep(folders.SETTLE + 1)
    assert run() == ["a/1.jpg", "b/2.jpg", "b/3.jpg"]
