import random
import re

import numpy as np
import pytest
import xxhash

from mediashoal.llm import simhash
from tests.llm.docs import clashing, documents, rows


def brute_fingerprint(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, budget):
    label = list(range(len(ids)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                label[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least.setdefault(root(k), []).append(i)
    return [min((i for i in least[root(k)] if i is not None), default=None) for k in range(len(ids))]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_fingerprint_equals_brute_force(monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_WORDS", block)
    for _, text, *_ in rows():
        if block == 4 and text and len(text) > 10_000:
            continue
        assert int.from_bytes(simhash.simhash(text or ""), "big") == brute_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_equals_all_pairs(budget):
    rng = random.Random(budget)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & simhash.ALL for b in base for _ in range(6)} | {0, simhash.ALL})
    half = len(values) // 2
    v = np.array(values, np.uint64)
    i, j = simhash.join_trie(v, np.array([0, half]), np.array([half, len(v)]), budget)
    want = {(a, b) for lo, hi in ((0, half), (half, len(v))) for a in range(lo, hi) for b in range(a + 1, hi) if (values[a] ^ values[b]).bit_count() <= budget}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert len(i) == len(want)


@pytest.mark.parametrize("bucket_rows", [8, 4096])
def test_links_keep_every_component(spark, bucket_rows):
    """Also with buckets that are dealt anew, level after level."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(10)]
    values = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(30)})
    signed = [simhash._signed(v) for v in values]
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2, bucket_rows)
    got = {r["node"]: r["component"] for r in simhash.connected_components(links, "a", "b").collect()}
    want = brute_components(signed, values, 2)
    assert [got.get(v, v) for v in signed] == want


def test_masks_bound_the_last_bucket():
    for budget in (1, 2, 3):
        for level in simhash.block_masks(budget):
            assert sum(level) == simhash.ALL


def test_near_duplicates_equal_brute_force(spark):
    docs = clashing(documents(spark), "fp", "component_id", "component", "least")
    got = simhash.near_duplicates(docs).collect()
    ids, prints = [r[0] for r in rows()], [brute_fingerprint(r[1]) for r in rows()]
    want = [(i, simhash._signed(p), c) for i, p, c in zip(ids, prints, brute_components(ids, prints, 2), strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_deduplicate_keeps_one_of_each_component(spark):
    made = rows() + [(None, "an id is missing here", "fr", None, 1), (None, "", None, None, 0)]
    docs = clashing(documents(spark, made), "fp", "component_id", "_key")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    ids = [r[0] for r in made]
    components = brute_components(ids, [brute_fingerprint(r[1], 5) for r in made], 3)
    got = sorted(str(r["doc_id"]) for r in out.collect())
    assert got == sorted([str(c) for c in {c for c in components if c is not None}] + ["None"])
    assert simhash.deduplicate(documents(spark, [])).count() == 0
