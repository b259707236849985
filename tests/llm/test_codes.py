import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from mediashoal.llm import codes
from mediashoal.llm.queries import vector_codes
from tests.llm.docs import clashing

KIND = "vec_id bigint, embedding array<float>, label int"


def brute(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * np.float64(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) if kept else 0
    w = size // 8
    books = [[v[p * w : p * w + w] for _, v, _ in kept[:entries]] for p in range(8)]

    def assign(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)) for e in books[p]]
        return min(range(len(far)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        took = [[assign(v, p)[0] for p in range(8)] for _, v, _ in kept]
        for p in range(8):
            for e in range(len(books[p])):
                own = [v[p * w : p * w + w] for (_, v, _), t in zip(kept, took) if t[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, k, [assign(v, p) for p in range(8)]) for i, v, k in kept]
    by = Counter()
    for _, k, a in found:
        by[k] += sum(x for _, x in a)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for e, _ in a), sum(x for _, x in a), by[k], digest) for i, k, a in found)


def result(df):
    return Counter((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def made_up(n, size=16, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(size)] for _ in range(5)]
    out = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    rng.shuffle(out)
    same = out[0][1]
    nan, inf = float("nan"), float("inf")
    odd = [(9001, None, 1), (9002, [nan] * size, 1), (9003, [None] * size, 2), (9004, [inf] + [0.0] * (size - 1), 2), (None, same, None)]
    return out + odd + [(5000 + k, same, 7) for k in range(n // 2)] + out[:2]


@pytest.mark.parametrize("made", [made_up(200), made_up(9, 8), [(3, [0.0] * 8, None)], [(i, [0.5] * 8, 1) for i in range(40)], made_up(100, 24, 5)])
def test_equals_brute_force(spark, made):
    df = clashing(spark.createDataFrame(made, KIND), "codes", "ints", "part", "n")
    assert result(vector_codes(df.repartition(5))) == brute(made)


def test_vectors_that_do_not_fit(spark):
    made = [(i, [0.1 * i] * 8, 1) for i in range(1, 30)]
    odd = [(0, [], 1), (-1, [1.0] * 3, 1), (70, [1.0] * 16, 1), (71, [4e9] * 8, 2)]
    got = {r["vec_id"]: r for r in vector_codes(spark.createDataFrame(made + odd, KIND)).collect()}
    assert len(got) == 33 and all(got[i]["code"] is None and got[i]["error"] is None for i, _, _ in odd)
    assert result(vector_codes(spark.createDataFrame(made, KIND))) == Counter({(i, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]): 1 for i, r in got.items() if r["code"]})
    assert got[71]["label_error"] is None


def test_only_what_changed_is_counted(spark):
    """Once assignments stay, a round has no differences."""
    made = [(i, [float(i % 4)] * 8, 1) for i in range(200)]
    df = spark.createDataFrame(made, KIND)
    rows = codes.kept(df)
    books = codes.first_codebooks(rows, entries=4)
    trained = codes.train(df, entries=4, rounds=2)
    assert (trained.books.entries == books.entries).all()
    state = codes.train(df, entries=4, rounds=1)
    again = spark.read.parquet(state.path)
    assert again.where("part is not null").count() > 0
    assert codes._round(again, state.books).where("part is not null").count() == 0


def test_empty_tables(spark):
    assert vector_codes(spark.createDataFrame([], KIND)).count() == 0
    assert vector_codes(spark.createDataFrame([(None, None, None), (1, [None], 1)], KIND)).count() == 0


def test_negative_zero_and_floors(spark):
    made = [(i, [x] * 8, 1) for i, x in enumerate([-0.0, 0.0, -1e-9, 1e-9, -0.25, 0.25 - 1e-8])]
    got = {tuple(r["ints"]) for r in codes.kept(spark.createDataFrame(made, KIND)).collect()}
    assert got == {(0,) * 8, (-1,) * 8, (-1024,) * 8, (1023,) * 8}
