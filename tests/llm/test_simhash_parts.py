import random

import numpy as np
import pytest

import corpus_pipeline
from mediashoal.llm import simhash_parts as similar
from tests.llm.docs import clashing, documents, rows


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute_kept(made):
    """Least id of each component of pairs at 0.8 or more."""
    sets = [shingles(r[1]) for r in made]
    label = list(range(len(made)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(made)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    ids = {}
    for k, r in enumerate(made):
        ids.setdefault(root(k), []).append(r[0])
    return sorted(str(min((i for i in x if i is not None), default=None)) for x in ids.values())


def near_copies():
    """Copies with words replaced, around 0.8; two large groups that share a passage."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(900)}"
    passage, out = [word() for _ in range(60)], []
    for size, copies in ((40, 60), (120, 60), (150, 3), (230, 3), (300, 3), (7, 3)):
        for _ in range(1 if copies > 9 else 12):
            base = [word() for _ in range(size)]
            for _ in range(copies):
                text = list(base)
                for _ in range(rng.randrange(size // 40 + 2)):
                    text[rng.randrange(size)] = word()
                out.append(" ".join(text + passage if copies > 9 else text))
    rng.shuffle(out)
    return [(i, t, "en", "s", 0) for i, t in enumerate(out)]


@pytest.mark.parametrize("tile", [16, 1024])
def test_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    made = near_copies()
    got = similar.deduplicate(documents(spark, made))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == brute_kept(made)


def test_awkward_rows(spark):
    made = [*rows(), (None, "an id is missing here", "fr", None, 1), (None, "", None, None, 0)]
    docs = clashing(documents(spark, made), "fp", "component_id", "_text", "part", "n")
    out = similar.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == brute_kept(made)
    assert similar.deduplicate(documents(spark, [])).count() == 0


def test_stage_links_similar_texts(spark):
    """Far apart as fingerprints: six words of 300 replaced, which leaves 0.81."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    made = [(0, " ".join(base), "en", "s", 0)]
    for i in range(1, 9):
        made.append((i, " ".join(f"new{i}" if k in range(20, 300, 50) else w for k, w in enumerate(base)), "en", "s", 0))
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert [r["doc_id"] for r in stage(spark, documents(spark, made), "").collect()] == [0]


@pytest.mark.parametrize("bits", [1 << 15, 64])
def test_sketches_bound_the_difference(monkeypatch, bits):
    monkeypatch.setattr(similar, "SKETCH_BITS", bits)
    monkeypatch.setattr(similar, "WORDS", 50)
    rng = np.random.default_rng(1)
    sets = []
    for n, m, shared in ((1, 3, 1), (40, 33, 30), (300, 250, 240), (70, 500, 10), (2000, 2100, 1900)):
        hashes = rng.integers(0, (1 << 64) - 1, n + m, np.uint64)
        sets += [np.unique(hashes[:n]), np.unique(hashes[n - shared : n - shared + m])]
    i, j = np.triu_indices(len(sets), 1)
    found = similar.least_differences([similar.sketch(s) for s in sets], i, j)
    for a, b, least in zip(i.tolist(), j.tolist(), found.tolist(), strict=True):
        true = len(np.setxor1d(sets[a], sets[b]))
        assert least <= true
        if bits > 64 and 2 * true <= len(sets[a]) + len(sets[b]):
            assert true / 3 <= least


def test_sub_documents_are_simhashes_of_the_least():
    rng = np.random.default_rng(2)
    for n in (1, 7, 40, 900):
        own = np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64))
        for k, got in enumerate(similar.sub_documents(own)):
            least = [x for x in own.tolist() if x % similar.PARTS == k][: similar.LEAST]
            want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in least) > len(least))
            assert (got is None) == (not least) and (got is None or got % (1 << 64) == want)


def test_nearest_forest_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        i, j = rng.integers(0, 12, 30), rng.integers(0, 12, 30)
        d = rng.integers(0, 9, 30)
        chosen = similar.nearest_forest(12, i, j, d)
        label, total, edges = list(range(12)), 0, 0
        for k in np.lexsort((j, i, d)).tolist():
            if label[i[k]] != label[j[k]]:
                label = [label[j[k]] if x == label[i[k]] else x for x in label]
                total, edges = total + d[k], edges + 1
        assert (d[chosen].sum(), len(chosen)) == (total, edges)


def test_recall_at_the_threshold():
    """Parts and budget bring pairs of 0.8 together, as the docstring says."""
    rng = np.random.default_rng(4)
    met = 0
    for k in range(400):
        n = int(rng.integers(5, 60)) * 9
        pool = rng.integers(0, (1 << 64) - 1, n // 9 * 10, np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[n // 9 :])  # 8 of 10 shared
        parts = any(a == b and a is not None for a, b in zip(similar.sub_documents(x), similar.sub_documents(y), strict=True))
        bits = np.bitwise_count(np.bitwise_xor(*(similar._majority(s, np.array([len(s)])) for s in (x, y))))[0]
        met += parts and bits <= similar.BUDGET
    assert met >= 398
