import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediashoal.operators import clusters, people, pivots, vector_search

KIND = "id bigint, vector array<float>"


def clustered(n, centres=12, size=16, spread=0.05, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    rows = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, size)) * np.linalg.norm(middle, axis=1).mean() / math.sqrt(size)
    return [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)]


def awkward(n=60):
    nan = float("nan")
    same = clustered(1)[0][1]
    return [(1000 + k, same) for k in range(n)] + [(2000, [0.0] * 16), (2001, [0.0] * 16), (2002, None), (2003, [nan] * 16), (2004, [None] * 16), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [-x for x in same])]


def cosines(a, b):
    a, b = (np.array(x, float) for x in (a, b))
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    return a @ b.T


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def reps(rows):
    first = {}
    for i, v in sorted(rows, key=lambda r: r[0]):
        if fine(v):
            first.setdefault(tuple(v), i)
    return [(i, list(v)) for v, i in first.items()]


@pytest.mark.parametrize("threshold, cells, block, seed", [(0.95, 20, 8, 1), (0.5, 30, 16384, 2), (0.05, 200, 50, 3), (1.0, 20, 64, 4)])
def test_similar_pairs_equal_brute_force(spark, threshold, cells, block, seed):
    rows = clustered(300, seed=seed) + clustered(40, 40, seed=9) + awkward()
    rows = [(i * 10 + k % 7, v) for k, (i, v) in enumerate(rows)]
    random.Random(seed).shuffle(rows)
    found = clusters.similar_pairs(spark.createDataFrame(rows, KIND), threshold, cell_rows=cells, block_rows=block).collect()
    expected = {}
    own = reps(rows)
    for size in {len(v) for _, v in own}:
        part = [(i, v) for i, v in own if len(v) == size]
        c = cosines([v for _, v in part], [v for _, v in part])
        expected |= {(min(a, b), max(a, b)): c[x, y] for x, (a, _) in enumerate(part) for y, (b, _) in enumerate(part) if x < y and c[x, y] >= threshold}
    got = {(r["a"], r["b"]): r["score"] for r in found}
    assert len(found) == len(got)
    border = {k for k in expected.keys() ^ got.keys()}
    assert all(abs(expected.get(k, got.get(k)) - threshold) < 1e-12 for k in border)
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got.keys() & expected.keys())


@pytest.mark.parametrize("threshold, cells, block, seed", [(0.95, 20, 8, 1), (0.4, 30, 16384, 2), (0.05, 200, 50, 3)])
def test_links_equal_brute_force(spark, threshold, cells, block, seed):
    rows = clustered(250, seed=seed) + clustered(40, 40, seed=9) + awkward()
    rows = [(i * 10 + k % 7, v) for k, (i, v) in enumerate(rows)]
    rows += [rows[0], (None, [0.0] * 16)]  # a repeated row, and a null id
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND + ", n string, times int").repartition(3)
    got = sorted(map(tuple, clusters.links(df, threshold, cell_rows=cells, block_rows=block).collect()), key=str)
    first = {}
    for i, v in rows:
        if fine(v):
            first[tuple(v)] = min(i, first.get(tuple(v), i))
    expected = []
    for i, v in rows:
        if fine(v):
            same = [w for _, w in rows if fine(w) and len(w) == len(v)]
            expected.append((i, first[tuple(v)], sum(w == v or c >= threshold for w, c in zip(same, cosines([v], same)[0])) - 1))
        else:
            expected.append((i, i, 0))
    assert got == sorted(expected, key=str)
    assert clusters.links(spark.createDataFrame([], KIND)).count() == 0


def test_links_leave_no_pairs(spark):
    """A dense group: rows that leave the tiles grow with the group, not with its square."""
    close = clustered(600, 1, 16, 0.01)
    links = clusters.links(spark.createDataFrame(close, KIND), 0.9, block_rows=100)
    assert {r["n_links"] for r in links.collect()} == {599}


def test_links_of_rows_without_id(spark):
    rows = [(None, [1.0, 0.0]), (None, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.01])]
    got = sorted(map(tuple, clusters.links(spark.createDataFrame(rows, KIND), 0.9).collect()), key=str)
    assert got == sorted([(None, 3, 2), (None, None, 0), (3, 3, 2), (4, 4, 2)], key=str)


def test_rows_that_move_grow_slower_than_blocks_by_blocks(spark):
    """Clusters, each a few cells: visits stay near home as the table grows."""
    moved = []
    for n, centres in ((1000, 20), (4000, 80)):
        met = []
        found = clusters.similar_pairs(spark.createDataFrame(clustered(n, centres, 64, 0.1), KIND), 0.95, cell_rows=50, block_rows=64, met=met)
        assert found.count() > n
        moved.append(met[0].shuffled)
    assert moved[1] < 6 * moved[0]  # all blocks against all: 16 times
    assert moved[1] < 0.2 * 4000 * 4000 / 64


def test_clusters_link_equal_vectors(spark):
    rows = clustered(120, 6, seed=5) + awkward(5)
    got = {r["id"]: (r["component"], r["cluster_id"]) for r in clusters.clusters(spark.createDataFrame(rows, KIND), 0.9).collect()}
    assert len(got) == len(rows)
    label = {i: i for i, _ in rows}
    ok = [(i, v) for i, v in rows if fine(v)]
    for _ in range(8):
        for i, v in ok:
            same = [(j, w) for j, w in ok if len(w) == len(v)]
            c = cosines([v], [w for _, w in same])[0]
            low = min(label[j] for (j, _), s in zip(same, c) if s >= 0.9)
            for (j, _), s in zip(same, c):
                if s >= 0.9:
                    label[j] = min(label[j], low)
    assert {i: c for i, (c, _) in got.items()} == label
    order = {c: k for k, c in enumerate(sorted(set(label.values())))}
    assert all(k == order[c] for c, k in got.values())


@pytest.mark.parametrize("cells, block, seed", [(10, 7, 1), (40, 16384, 2), (1000, 30, 3)])
def test_best_person_equals_brute_force(spark, cells, block, seed):
    named = clustered(200, 15, seed=seed) + awkward(10)
    new = [(i + 5000, v) for i, v in clustered(150, 15, seed=seed, spread=0.2) + awkward(10)] + [(i + 9000, v) for i, v in clustered(30, 30, seed=8)]
    faces = spark.createDataFrame([(i, i % 7, v) for i, v in named], "named_id bigint, person_id bigint, named_vector array<float>")
    met = []
    got = {r["id"]: (r["person_id"], r["score"]) for r in people.best_person(spark.createDataFrame(new, KIND), faces, 0.6, block, met, cells).collect()}
    expected = {}
    for i, v in new:
        if not fine(v):
            continue
        same = sorted((j, w) for j, w in named if fine(w) and len(w) == len(v))
        if same:
            c = np.round(cosines([v], [w for _, w in same])[0], 12)
            k = int(c.argmax())
            if c[k] >= 0.6:
                expected[i] = (same[k][0] % 7, c[k])
    assert {i: p for i, (p, _) in got.items()} == {i: p for i, (p, _) in expected.items()}
    assert all(abs(got[i][1] - expected[i][1]) < 1e-9 for i in got)
    assert met[0].tiles > 0 and all(m.shuffled >= m.visitors for m in met)


def test_the_second_pass_visits_few_cells(spark):
    """New faces near named ones are settled by the first pass, but for few cells."""
    named = clustered(2000, 40, 64, 0.1)
    new = [(i + 5000, v) for i, v in clustered(500, 40, 64, 0.1)]
    faces = spark.createDataFrame([(i, 1, v) for i, v in named], "named_id bigint, person_id bigint, named_vector array<float>")
    met = []
    people.best_person(spark.createDataFrame(new, KIND), faces, 0.42, met=met, cell_rows=50)
    assert met[0].visitors == 500 and met[1].visitors < 500 * 40 / 4


@pytest.mark.parametrize("seed", range(3))
def test_index_gives_what_a_scan_gives(spark, tmp_path, seed):
    rows = clustered(900, 30, 32, 0.1, seed) + clustered(30, 5, 32, seed=7) + [(3000 + k, clustered(1, seed=seed, size=32)[0][1]) for k in range(50)]
    rows += [(4000, [0.0] * 32), (4001, None), (4002, [1.0] * 3), (4003, [None] * 32)]
    df = spark.createDataFrame([(i, v, "even" if i % 2 == 0 else "odd") for i, v in rows], "media_item_id bigint, vector array<float>, model string")
    index = pivots.PivotIndex.build(df.repartition(3), f"{tmp_path}/index", cell_rows=30)
    again = pivots.PivotIndex(spark, f"{tmp_path}/index")
    for query, k in ((rows[3][1], 5), (rows[-8][1], 20), ([1.0] + [0.0] * 31, 40), ([-x for x in rows[0][1]], 200), (rows[3][1], 2000), ([0.0] * 32, 7), ([1.0] * 3, 7)):
        searched = pivots.Searched()
        got = [tuple(r) for r in again.top_k(query, k, searched=searched).collect()]
        scan = vector_search.scores(df, query).orderBy(F.col("score").desc(), "media_item_id").limit(k).collect()
        assert got == [tuple(r) for r in scan]
        if query is rows[3][1] and k == 5:
            assert 0 < searched.scored < searched.rows / 2 and searched.cells_read < searched.cells / 2
    odd = df.where("model = 'odd' and media_item_id % 5 = 0")
    scope = df.where("media_item_id % 5 = 0").select("media_item_id")
    got = index.top_k(rows[3][1], 30, scope=scope, where=F.col("model") == "odd").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in vector_search.scores(odd, rows[3][1]).orderBy(F.col("score").desc(), "media_item_id").limit(30).collect()]


def test_conditions_reach_the_scan(spark, tmp_path):
    index = pivots.PivotIndex.build(spark.createDataFrame(clustered(500), "media_item_id bigint, vector array<float>"), f"{tmp_path}/index", cell_rows=25)
    rows, read = index.within(clustered(1)[0][1], 0.1)
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(a" in plan and 0 < len(read) < 20


def test_a_search_that_reads_as_many_cells_as_there_can_be(spark, tmp_path):
    rows = clustered(60, centres=1)
    index = pivots.PivotIndex.build(spark.createDataFrame(rows, "media_item_id bigint, vector array<float>"), f"{tmp_path}/index", cell_rows=60)
    index.cells = pivots.Cells(*(np.repeat(x, pivots.PIVOTS, 0) for x in (index.cells.pivots, index.cells.rows, index.cells.near, index.cells.far)))
    found, read = index.within(rows[3][1], 1.0)
    assert len(read) == pivots.PIVOTS and found.count() == 60 and found.columns == index.rows().columns


def test_few_ranges_cover_many():
    assert pivots.joined([], 3) == []
    assert pivots.joined([(0, 2), (1, 3), (1, 2), (5, 6), (7, 8), (20, 21)], 9) == [(0, 3), (5, 6), (7, 8), (20, 21)]
    assert pivots.joined([(0, 2), (1, 3), (1, 2), (5, 6), (7, 8), (20, 21)], 2) == [(0, 8), (20, 21)]


def test_an_empty_index(spark, tmp_path):
    index = pivots.PivotIndex.build(spark.createDataFrame([], "media_item_id bigint, vector array<float>"), f"{tmp_path}/index")
    assert index.top_k([1.0], 3).count() == 0
