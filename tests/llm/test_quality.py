import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from mediashoal.llm import quality
from tests.llm.docs import clashing, documents, rows


def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0d]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute_model(texts, order=quality.ORDER):
    """Modified Kneser-Ney written with dictionaries: probabilities and context weights."""
    grams = Counter()
    for t in set(texts):
        raw = b"\0" * (order - 1) + t.encode()
        grams.update(raw[i : i + order] for i in range(len(raw) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    prob, weight = {}, {}

    def disc(c):
        n = Counter(c.values())
        if not n[1] or not n[2]:
            return [0, 0.5, 0.5, 0.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5, 0.01), k) for k in (1, 2, 3)]]

    for k in range(1, order + 1):
        c, d = counts[k], disc(counts[k])
        total, spare = defaultdict(float), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            spare[g[:-1]] += d[min(n, 3)]
        for h in total:
            weight[k, h] = spare[h] / total[h]
        for g, n in c.items():
            lower = prob[g[1:]] if k > 1 else 1 / 256
            prob[g] = (n - d[min(n, 3)]) / total[g[:-1]] + weight[k, g[:-1]] * lower
    return prob, weight


def brute_bits(texts, model, order=quality.ORDER):
    """Bits a byte of each text."""
    prob, weight = model

    def p(g):
        if not g:
            return 1 / 256
        return prob[g] if g in prob else weight.get((len(g), g[:-1]), 1.0) * p(g[1:])

    out = []
    for t in texts:
        raw = b"\0" * (order - 1) + t.encode()
        out.append(-sum(math.log2(p(raw[i : i + order])) for i in range(len(raw) - order + 1)) / max(1, len(raw) - order + 1))
    return out


def brute_kept(made, mads=quality.BAND_MADS):
    """The verdicts of rows (id, text, lang, ...) by the documented rule."""
    texts = [r[1] or "" for r in made]
    bits = brute_bits(texts, brute_model(texts))
    features = list(map(brute_features, texts))
    bands = {}
    for r in made:
        seen = {(r2[1] or ""): x for r2, x, f in zip(made, bits, features, strict=True) if r2[2] == r[2] and f[0] >= 50}
        steps = sorted(math.floor(x * 1000 + 0.5) for x in seen.values())
        if steps:
            middle = steps[(len(steps) - 1) // 2]
            mad = sorted(abs(x - middle) for x in steps)[(len(steps) - 1) // 2]
            bands[r[2]] = middle / 1000, mads * max(mad / 1000, 0.01)
    out = []
    for r, x, f in zip(made, bits, features, strict=True):
        base = f[0] < 50 or 100 * f[4] > 50 * f[0]
        middle, half = bands.get(r[2], (x, 1))
        wide = half * math.sqrt(max(1.0, 1200 / max(1, len((r[1] or "").encode()))))
        out.append((base, not base and abs(x - middle) <= wide))
    return out


def test_features_equal_brute_force():
    rng = random.Random(1)
    texts = [r[1] or "" for r in rows() if len(r[1] or "") < 10_000]
    texts += ["".join(rng.choice("ab \n\t#|é ") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert quality.base_features(t) == brute_features(t)


def random_texts(seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcde fé\n") for _ in range(rng.randrange(1, 90))) for _ in range(60)] + ["", "z"]


def scored(spark, texts, model=None):
    docs = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "k int, text string, lang string").repartition(3)
    return [r["_bits"] for r in quality._scored(quality._scannable(docs), "text", "lang", ["k"], model).orderBy("k").collect()]


@pytest.mark.parametrize("chunk", [200, 1 << 20])
def test_model_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(quality, "PIECE_BYTES", 70)
    texts = random_texts()
    texts += [texts[3]] * 5 + [texts[9]]  # copies count once
    assert np.allclose(scored(spark, texts), brute_bits(texts, brute_model(texts)), atol=1e-4)


def test_a_given_model_backs_off(spark):
    texts, others = random_texts(), [*random_texts(5), "never seen: QXZ", "abc\U0001f600"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(scored(spark, others, model), brute_bits(others, brute_model(texts)), atol=1e-4)


def test_model_is_a_distribution(spark):
    model = quality.train(spark.createDataFrame([(t,) for t in random_texts()], "text string"))
    contexts = [b"abcd", b"zzzz", b"\0\0\0\0", b"e fa"]
    grams = [int.from_bytes(c + bytes([x])) for c in contexts for x in range(256)]
    got = quality.log_probabilities(spark.createDataFrame([(g,) for g in grams], "gram bigint"), model).collect()
    sums = Counter()
    for r in got:
        sums[r["gram"] >> 8] += 2 ** -r["bits"]
    assert len(got) == len(set(grams)) and all(x == pytest.approx(1, abs=1e-9) for x in sums.values())


def test_verdicts_equal_brute_force(spark):
    """Bands of several languages: no language, one text, two, and a tight one."""
    rng = random.Random(12)
    words = [a + b for a in ("the", "an", "ion", "house", "tion", "stone") for b in ("", "er", "on", "is")]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40, 200))), rng.choice(["en", None, "de"]), "s", 0) for i in range(50)]
    made += [(60, "lonely " + made[0][1] * 2, "fr", "s", 0), (61, made[1][1] + " x", "es", "s", 0), (62, made[2][1], "es", "s", 0)]
    made += [(70 + k, " ".join("".join(rng.choice("qxz#0") for _ in range(5)) for _ in range(80)), "en", "s", 0) for k in range(3)]
    made += [(80, made[0][1], "de", "s", 0), made[0], (81, None, None, None, None)]
    got = sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in quality.judge(documents(spark, made)).collect())
    assert got == sorted((r[0], *v) for r, v in zip(made, brute_kept(made), strict=True))
    assert 0 < sum(not x[1] and not x[2] for x in got) < len(got) // 2


def test_lookup_in_sorted_hashes():
    rng = np.random.default_rng(8)
    for n in (1, 2, 50, 30_000):
        grams = rng.integers(0, 1 << 40, n)
        found = quality._Lookup(np.append(grams, grams), np.append(grams, grams).astype(np.float32))
        assert np.array_equal(found(grams), grams.astype(np.float32))
    with pytest.raises(RuntimeError, match="another order"):
        found(np.array([1 << 39, 77, *grams[:3]]))
    with pytest.raises(RuntimeError, match="another order"):
        quality._Lookup(np.zeros(0, np.int64), np.zeros(0, np.float32))(np.array([1]))


def corpus(spark):
    rng = random.Random(4)
    words = [a + b for a in ("the", "an", "ion", "ther", "ing", "house", "tion", "stone") for b in ("", "er", "on", "is", "ly", "ed")]
    good = [(i, " ".join(rng.choice(words) for _ in range(300)), "en", "s", 0) for i in range(60)]
    odd = [(100 + i, " ".join("".join(rng.choice("QXZJ#@!0987") for _ in range(6)) for _ in range(120)), "en", "s", 0) for i in range(3)]
    return documents(spark, [*good, *odd, (200, None, None, None, None), (201, "", "en", None, 0), (202, good[0][1], None, None, 0), good[0]])


def test_verdicts(spark):
    docs = corpus(spark)
    got = {}
    for r in quality.judge(clashing(docs, "kept", "_lang", "lang_")).collect():
        got.setdefault(r["doc_id"], r)
    assert all(got[i]["kept"] for i in range(60))
    assert not any(got[100 + i]["kept"] for i in range(3)) and not any(got[100 + i]["base_failed"] for i in range(3))
    assert got[200]["base_failed"] and got[201]["base_failed"] and got[202]["kept"]
    assert got[200]["n_words"] == 0


def test_keep_returns_own_columns(spark):
    docs = clashing(corpus(spark), "kept", "_words", "_text")
    got = quality.keep(docs)
    assert got.columns == docs.columns
    ids = sorted(r["doc_id"] for r in got.collect())
    assert ids == sorted([*range(60), 0, 202])


def test_awkward_rows_and_empty_table(spark):
    got = quality.judge(documents(spark)).collect()
    assert len(got) == len(rows())
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) for r in got) == sorted(brute_features(r[1] or "")[:4] for r in rows())
    assert quality.judge(documents(spark, [])).count() == 0
    assert quality.keep(documents(spark, [])).count() == 0


def test_copies_move_neither_model_nor_band(spark):
    """One text in a third of all rows, in a language with less than half of the others."""
    rng = random.Random(6)
    words = [a + b for a in ("haus", "stein", "wasser", "tag", "nacht", "wald") for b in ("", "en", "er", "lich", "ung")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 300))) for _ in range(60)]
    made = [(i, t, "de" if i % 3 == 0 else "en", "s", 0) for i, t in enumerate(texts)]
    hot = [(100 + k, texts[0], "de", "s", 0) for k in range(30)]
    before = {r["doc_id"]: r for r in quality.judge(documents(spark, made)).collect()}
    after = {r["doc_id"]: r for r in quality.judge(documents(spark, made + hot)).collect()}
    assert all(after[i] == before[i] for i in before) and len(after) == 90
    assert all(after[i]["kept"] for i in before if not before[i]["base_failed"])
    assert sum(not r["base_failed"] for r in before.values()) > 30
