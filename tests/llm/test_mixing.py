import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mediashoal.llm import mixing
from tests.llm.docs import clashing, documents, rows


def brute_targets(made):
    size = defaultdict(int)
    for _, t, _, s, _ in made:
        size[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, budget, out = dict(weight), 1.5 * sum(size.values()), {}
    while left:
        level = budget / sum(left.values())
        over = [s for s in left if level * left[s] > 2 * size[s]]
        for s in over or list(left):
            out[s] = 2 * size[s] if over else level * left[s]
            budget -= out[s]
            del left[s]
    return size, out


def made_up(n=400):
    rng = random.Random(3)
    pick = ["a", "b", "c", "d", "e", "Z", None, "é"]
    return [(i, "w " * rng.randrange(120), "en", rng.choice(pick) if i % 3 else "a", 0) for i in range(n)]


@pytest.mark.parametrize("made", [made_up(), rows(), made_up(3), [(1, "one", None, None, 1)]])
def test_targets_and_words_taken(spark, made):
    got = mixing.mix(clashing(documents(spark, made), "taken", "size", "sid")).collect()
    size, target = brute_targets(made)
    assert len(got) == len(made)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in size:
        assert abs(taken[s] - target[s]) <= max(2, 0.05 * target[s])


def test_reruns_and_partitions_agree(spark):
    docs = documents(spark, made_up())
    first = sorted(map(str, mixing.mix(docs).collect()))
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == first


def test_chunks_and_cells_change_nothing(spark, monkeypatch):
    docs = documents(spark, made_up())
    first = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "CHUNK", 100)
    monkeypatch.setattr(mixing, "CELLS", 16)
    assert sorted(map(str, mixing.mix(docs).collect())) == first


def test_schedule_spreads_each_source(spark):
    shares = spark.createDataFrame([(1, 300, 300), (2, 100, 100), (3, 50, 200)], "sid bigint, blocks bigint, quota bigint")
    plan = sorted(mixing.schedule(shares, 700).collect())
    count = defaultdict(int)
    for k, r in enumerate(plan[:500], 1):
        assert (r["block_no"], r["repeat"]) == (count[r["sid"]] % {1: 300, 2: 100, 3: 50}[r["sid"]], count[r["sid"]] // {1: 300, 2: 100, 3: 50}[r["sid"]])
        count[r["sid"]] += 1
        for sid, part in ((1, 0.5), (2, 1 / 6), (3, 1 / 3)):
            assert abs(count[sid] - part * k) < 4


def test_applied_mix_has_the_words(spark):
    made = made_up()
    docs = clashing(documents(spark, made), "taken", "id", "piece")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
    want = {r["id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    assert dict(got) == want


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.apply_mix(documents(spark, [])).count() == 0
    assert [r["target"] for r in mixing.mix(documents(spark, [(1, None, None, "a", 0)])).collect()] == [0.0]


@pytest.mark.parametrize("seed", range(4))
def test_every_quota_is_filled(spark, seed):
    """Quotas of a few slots among large ones, in several arrangements."""
    quotas = [5, 10, 20, 3, 40_000, 7, 90_000, 1, 0, 33]
    random.Random(seed).shuffle(quotas)
    shares = spark.createDataFrame([(k, max(1, q // 2), q) for k, q in enumerate(quotas, 1)], "sid bigint, blocks bigint, quota bigint")
    plan = mixing.schedule(shares, int(sum(quotas) * mixing.EXTRA) + 64)
    got = {r["sid"]: (r["n"], r["slots"], r["blocks"]) for r in plan.groupBy("sid").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.count_distinct("block_no").alias("blocks")).collect()}
    assert got == {k: (q, q, min(q, max(1, q // 2))) for k, q in enumerate(quotas, 1) if q}
