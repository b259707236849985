import itertools
import random
import re

import numpy as np
import pytest

from mediashoal.llm import pii
from tests.llm.docs import clashing, documents, rows


def brute_base(text):
    """The four patterns as they stand, by plain search."""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_base_equals_plain_search():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("a.b@c-+(1) 259\n%é") for _ in range(rng.randrange(50)))
        assert pii.base_spans(t) == brute_base(t)
    for r in rows():
        assert pii.base_spans(r[1] or "") == brute_base(r[1] or "")
    for t in ("1" * 50_000, "a" * 50_000, "1.2." * 5000, "+" * 5000, "a@" * 5000, "4111 1111 1111 1111", "x@y.z@w.v"):
        assert pii.base_spans(t) == (brute_base(t) if len(t) < 1000 else pii.base_spans(t))


def all_segmentations(model, lattice):
    """(score, spans) of every segmentation, by brute force."""
    spans = lattice.candidates(0, lattice.n)
    scores = dict(zip(spans, lattice.features(spans) @ model.weights, strict=True))

    def walk(t, last):
        if t == lattice.n:
            yield 0.0, ()
            return
        for s, rest in walk(t + 1, 0):
            yield s + model.moves[last, 0], rest
        for i, j in spans:
            if i == t:
                for y in range(1, pii.LABELS):
                    for s, rest in walk(j, y):
                        yield s + model.moves[last, y] + scores[i, j][y - 1], ((y - 1, i, j), *rest)

    return list(walk(0, 0))


def small_model():
    model = pii.SemiCRF()
    rng = np.random.default_rng(2)
    model.weights[:] = rng.normal(size=model.weights.shape)
    model.moves[:] = rng.normal(size=model.moves.shape)
    return model


@pytest.mark.parametrize("text", ["a 1234567 b", "12-3456789 x@y.zz", "(319) 555-5132", "a (at) b.cc 12 34567"])
def test_decoding_and_gradient_equal_brute_force(text):
    model = small_model()
    lattice = pii.Lattice(text, 0, len(text))
    found = all_segmentations(model, lattice)
    best = max(found)[1]
    assert model.decode(text, 0, len(text)) == [(k, lattice.starts[i], lattice.ends[j - 1]) for k, i, j in best]
    gold = [(0, lattice.starts[i], lattice.ends[j - 1]) for _, i, j in found[-1][1]]

    def likelihood():
        every = all_segmentations(model, lattice)
        want = next(s for s, x in every if [(k, lattice.starts[i], lattice.ends[j - 1]) for k, i, j in x] == gold)
        return want - np.logaddexp.reduce([s for s, _ in every])

    slope, moves = model.fit_one(text, gold)
    before = likelihood()
    for place, grad in itertools.chain(((model.weights, (0, 1)), slope) and [((model.weights, (0, 0)), slope[0, 0]), ((model.weights, (15, 3)), slope[15, 3])], [((model.moves, (0, 0)), moves[0, 0]), ((model.moves, (0, 4)), moves[0, 4])]):
        table, at = place
        table[at] += 1e-5
        assert (likelihood() - before) / 1e-5 == pytest.approx(grad, abs=1e-3)
        table[at] -= 1e-5


def test_held_out_accuracy():
    model, right, wrong, missed = pii.trained(), 0, 0, 0
    for text, gold in pii.sentences(300, seed=77):
        got = {s for lo, hi in pii.stretches(text) for s in model.decode(text, lo, hi)}
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.93


def test_base_stays_and_additions_do_not_overlap():
    model = pii.trained()
    text = "call (319) 555-5132 or +49 30 1234567, mail jo (at) site (dot) org or a@b.co\nno 12 personal data 2020-01-02 here"
    base, spans = pii.find(text, model)
    assert set(base) <= set(spans) and len(spans) == 4
    assert all(a[2] <= b[1] for a, b in itertools.pairwise(sorted(spans, key=lambda s: s[1])))
    assert pii.find("clean words only", model) == ([], [])


def test_long_runs_and_block_edges():
    """Stretches of many tokens give the same as one decoding of the whole text."""
    model = pii.trained()
    text = " ".join("call (319) 555-5132 now" if k % 7 == 0 else f"{k} words" for k in range(900))
    assert [s for lo, hi in pii.stretches(text) for s in model.decode(text, lo, hi)] == model.decode(text, 0, len(text))
    assert len(model.decode(text, 0, len(text))) == 129


def test_rows(spark):
    got = pii.find_all(clashing(documents(spark), "spans", "base")).collect()
    want = sorted((str(r[0]), pii.spelled(brute_base(r[1] or ""))) for r in rows())
    assert sorted((str(r["doc_id"]), r["base"]) for r in got) == want
    assert pii.find_all(documents(spark, [])).count() == 0
