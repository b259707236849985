import random
import re
from collections import defaultdict

import numpy as np
import pytest

from mediashoal.llm import lines
from tests.llm.docs import LINE, clashing, documents, rows


def key(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(made, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t, *_ in made:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = []
    for i, t, *_ in made:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(map(str, out))


def result(df):
    return sorted(str((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in df.collect())


def made_up(n=60):
    rng = random.Random(8)
    shared = [f"{LINE} number {k} of them" for k in range(12)]
    return [(i, "\n".join(rng.choice([*shared, f"own line {i} " * 5, "", "short", shared[0].upper() + " \t"]) for _ in range(rng.randrange(9))), "en", "s", 0) for i in range(n)]


def test_filter_has_no_false_negatives_and_deletes():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**64, 3000, np.uint64), rng.integers(0, 2**64, 3000, np.uint64)
    made = lines.CuckooFilter(3000)
    made.insert(h1, h2)
    assert not made.full and made.contains(h1, h2).all()
    again = lines.CuckooFilter.from_bytes(made.to_bytes())
    again.delete(h1[:1000], h2[:1000])
    assert again.contains(h1[1000:], h2[1000:]).all()
    assert again.contains(h1[:1000], h2[:1000]).mean() < 0.01
    far = rng.integers(0, 2**64, 20_000, np.uint64)
    assert made.contains(far, far[::-1]).mean() < 0.01


def test_equals_brute_force(spark):
    made = [*made_up(), *[(100 + r[0] if r[0] is not None else None, *r[1:]) for r in rows()]]
    docs = clashing(documents(spark, made), "gone", "h1", "doc", "last")
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert result(got) == brute(made)


def test_crowded_filter_turns_tags_out():
    rng = np.random.default_rng(2)
    h1, h2 = rng.integers(0, 2**64, 1550, np.uint64), rng.integers(0, 2**64, 1550, np.uint64)
    made = lines.CuckooFilter(1600)  # 2048 places
    for k in range(0, 1550, 50):
        made.insert(h1[k : k + 50], h2[k : k + 50])
    assert not made.full and made.contains(h1, h2).all() and (made.tags > 0).sum() == 1550
    made.insert(np.repeat(h1[:1], 9), np.repeat(h2[:1], 9))  # two buckets hold eight at most
    assert made.full and made.contains(h2, h1).all()


def test_large_filters_are_met_by_shard(spark, monkeypatch):
    """Beyond a broadcast, keys still go through the filters, a shard's in several groups."""
    monkeypatch.setattr(lines, "FILTER_BYTES", 0)
    monkeypatch.setattr(lines, "SHARD_LINES", 3)
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    docs = documents(spark, made_up())
    assert result(lines.dedup_lines(docs)) == brute(made_up())
    index = lines.LineIndex.empty(spark).insert(docs)
    assert index.shards > 1
    keys = lines.references(docs)
    found = index.suspects(keys)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    shared = keys.join(index.shared, ["h1", "h2"]).count()
    assert shared <= found.count() < keys.count()


@pytest.mark.parametrize("segments", [1, 16])
def test_insert_and_delete_are_reversible(spark, monkeypatch, segments):
    monkeypatch.setattr(lines, "SHARD_KEYS", 4)
    monkeypatch.setattr(lines, "SEGMENTS", segments)
    made = made_up()
    docs = documents(spark, made)
    first = lines.LineIndex.empty(spark).insert(docs.where("doc_id < 25"))
    both = first.insert(docs.where("doc_id >= 20"))  # some come again
    assert result(both.dedup(docs)) == brute(made)
    back = both.delete(docs.where("doc_id >= 25"))
    early = docs.where("doc_id < 25")
    assert result(back.dedup(early)) == result(first.dedup(early)) == brute(made[:25])
    again = back.insert(docs.where("doc_id >= 25"))
    assert result(again.dedup(docs)) == brute(made)
    some = both.delete(docs.where("doc_id % 3 = 0"))
    assert result(some.dedup(docs.where("doc_id % 3 <> 0"))) == brute([r for r in made if r[0] % 3])


def test_counts_find_free_names(spark):
    docs = clashing(documents(spark, made_up()), "n_lines", "N_dropped")
    got = lines.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert sorted(str((r["doc_id"], r["text"], r["n_lines_"], r["n_dropped_"])) for r in got.collect()) == brute(made_up())


def test_empty_table(spark):
    assert lines.dedup_lines(documents(spark, [])).count() == 0
