import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest

from mediashoal.llm import shards
from mediashoal.llm.queries import sharded_digests
from tests.llm.docs import clashing, documents, rows


def cheapest(supply, capacity, cost):
    """By linear relaxation's own optimality: no cycle of the residual graph has a negative cost (Bellman-Ford)."""
    n, m = len(supply), len(capacity)

    def check(flow):
        used_in = [sum(flow.get((i, j), 0) for j in range(m)) for i in range(n)]
        used_out = [sum(flow.get((i, j), 0) for i in range(n)) for j in range(m)]
        assert used_in == list(supply) and all(u <= c for u, c in zip(used_out, capacity))
        arcs = [(i, n + j, cost[i][j]) for i, j in product(range(n), range(m))]
        arcs += [(n + j, i, -cost[i][j]) for (i, j), x in flow.items() if x]
        sink = n + m  # unused capacity is a way back
        arcs += [(n + j, sink, 0) for j in range(m) if used_out[j] < capacity[j]] + [(sink, n + j, 0) for j in range(m) if used_out[j]]
        dist = [0] * (n + m + 1)
        for turn in range(n + m + 2):
            changed = False
            for u, v, c in arcs:
                if dist[u] + c < dist[v]:
                    dist[v], changed = dist[u] + c, True
            if not changed:
                return
        raise AssertionError("a cheaper flow exists")

    return check


@pytest.mark.parametrize("seed", range(30))
def test_the_flow_is_the_cheapest(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 7), rng.randrange(1, 7)
    supply = [rng.choice([0, rng.randrange(50)]) for _ in range(n)]
    capacity = [rng.randrange(60) for _ in range(m)]
    capacity[0] += max(0, sum(supply) - sum(capacity)) + rng.choice([0, 20])
    cost = [[rng.randrange(6) for _ in range(m)] for _ in range(n)]
    cheapest(supply, capacity, cost)(shards.transport(supply, capacity, np.array(cost)))


def test_equal_costs_move_only_what_is_over():
    rng = random.Random(9)
    supply = [rng.randrange(10**12) for _ in range(300)]
    capacity = shards.even(sum(supply), [0] * 360, [1] * 360)
    flow = shards.transport(supply, capacity, np.ones((300, 360)) - np.eye(300, 360))
    assert sum(x for (i, j), x in flow.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity))
    assert len(flow) <= 300 + 360 - 1


def test_too_small_capacities():
    with pytest.raises(ValueError):
        shards.transport([3], [2], np.zeros((1, 1)))


@pytest.mark.parametrize("total, used, weights", [(100, [0, 0, 0], [1, 1, 1]), (10, [90, 0, 5], [1, 1, 1]), (0, [1, 2], [1, 1]), (7, [0, 0], [3, 0]), (10**15 + 1, [5] * 40, [1] * 40)])
def test_even(total, used, weights):
    got = shards.even(total, used, weights)
    assert sum(got) == total and all(g == 0 for g, w in zip(got, weights) if not w)
    held = [g + u for g, u, w in zip(got, used, weights) if g]
    if len(set(weights)) == 1 and held:
        assert max(held) - min(held) <= 1


def made_up(n=900):
    rng = random.Random(3)
    return [(i if i % 3 else None, "x" * rng.choice([0, 3, 40, 400, 900]) + "é", "en", "s", 0) for i in range(n)] + [(5000 + i, "big " * 900, "en", "s", 0) for i in range(6)]


def check(found, made, n_shards):
    got = found.collect()
    size = lambda t: len((t or "").encode()) + 16
    expected = sorted(((d is not None, d or 0), size(t), zlib.crc32((t or "").encode())) for d, t, *_ in made)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in got) == expected
    slots, sizes = defaultdict(list), [0] * n_shards
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n_shards))
    mean, largest = sum(sizes) / n_shards, max([s[1] for s in expected], default=0)
    return sizes, mean, largest


@pytest.mark.parametrize("made", [made_up(), rows(), [(1, None, None, None, None)], []])
def test_all_rows_in_even_shards(spark, made):
    found = sharded_digests(clashing(documents(spark, made).repartition(5), "row", "shard", "size", "block", "at"))
    sizes, mean, largest = check(found, made, 40)
    if len(made) > 500:
        assert max(sizes) - min(sizes) <= 200 + max(0, largest - mean)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in found.collect())


def test_only_affected_blocks_are_rewritten(spark, monkeypatch):
    monkeypatch.setattr(shards, "LEAST_BYTES", 6000)
    docs = documents(spark, made_up(3000)).repartition(6)
    first = shards.lay_out(docs, 8, later=10)
    before = first.sizes(8)
    second, plan = shards.reshard(first, [1] * 10)
    after = second.sizes(10)
    small = [sum(b.bytes for b in first.blocks if b.shard == s and b.ident not in first.large) for s in range(8)]
    assert sum(after) == sum(before) and max(after) - min(after) < 918  # a row
    ids = {b.ident for b in first.blocks}
    kept = {b.ident for b in second.blocks} & ids
    assert len(ids - kept) <= len(plan.flow) and len(kept) > len(ids) / 2
    staying = sum(x for (i, j), x in plan.flow.items() if i == j)
    assert plan.moved <= sum(small) - staying + sum(b.bytes for b in first.blocks if b.ident in first.large)
    # back again, and once more to unequal shards
    third, _ = shards.reshard(second, [1, 2, 0, 1])
    sizes = third.sizes(4)
    assert sizes[2] == 0 and abs(sizes[1] - 2 * sizes[0]) < 1836 and abs(sizes[0] - sizes[3]) < 918
    assert sorted(r["row"]["text"] for r in third.read().collect()) == sorted(r["text"] for r in docs.collect())
    same, nothing = shards.reshard(second, [1] * 10)
    assert nothing.moved < 918 * 10


def test_costs_decide_where_bytes_go(spark):
    docs = documents(spark, [(i, "y" * 84, "en", "s", 0) for i in range(400)])
    first = shards.lay_out(docs, 4, later=8)
    cost = np.array([[0 if i == j else 1 if i % 2 == j % 2 else 100 for j in range(8)] for i in range(4)])
    _, plan = shards.reshard(first, [1] * 8, cost)
    near = sum(x for (i, j), x in plan.flow.items() if i % 2 == j % 2)
    assert near > 0.8 * sum(plan.flow.values())


def test_reruns_agree(spark):
    docs = documents(spark, made_up())
    view = lambda d: sorted((str(r["doc_id"]), r["text_crc32"], r["shard"]) for r in sharded_digests(d).collect())
    assert view(docs) == view(docs)
