import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from mediashoal.llm import bpe
from tests.llm.docs import clashing, documents, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Tokenizer(f.read(), public_tokenizers.PATTERN)


def encoded(own, text):
    return list(memoryview(own.encode(text)).cast("i"))


def test_equals_the_library_on_awkward_texts(own, library):
    texts = [r[1] or "" for r in rows()] + [
        "it's  we're I'll x   y\x1cz \x85 q",
        " lead and trail ",
        "a \n b\n\n c\t d",
        "ab" * 20_000,
        "​́ é ﷽ 🇩🇪👩‍👩‍👧",
        "#" * 3000 + "=" * 17,
    ]
    for t in texts:
        assert encoded(own, t) == library.encode_ordinary(t)


def test_equals_the_library_on_random_texts(own, library):
    rng = random.Random(3)
    alphabet = "aabcde  \n\t'sé ñ日１2３.,#-  Ω"
    for _ in range(800):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encoded(own, t) == library.encode_ordinary(t)


def test_merge_alone_on_random_bytes(own, library):
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("aaeinrst") for _ in range(rng.randrange(1, 300)))
        assert own.encoder.merge(t.encode()) == library.encode_ordinary(t) or t.encode() in own.encoder.ranks


def test_full_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 900)
    fresh = bpe.Tokenizer(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    t = " ".join(f"word{i % 50}" for i in range(400))
    assert encoded(fresh, t) == library.encode_ordinary(t)
    assert len(fresh.pieces) + len(fresh.pieces.old) < 9


def test_query_rows(spark, library):
    docs = clashing(documents(spark), "tokens", "decoded", "n_tokens")
    got = bpe.round_trip_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in rows():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_decoding_null_and_empty_lists(spark):
    rows = [(1, [10, 11]), (2, None), (3, []), (None, [65])]
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    back = {r: t for t, r in ranks.items()}
    got = bpe.decode(spark.createDataFrame(rows, "doc_id bigint, tokens array<int>").coalesce(1), PATH).collect()
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in got] == [None if x is None else b"".join(back[k] for k in x) for _, x in rows]


def test_round_trip_is_decoding_of_encoding(spark):
    docs = documents(spark).where("doc_id is not null").coalesce(1)
    one = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    two = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert one == two


def test_empty_table(spark):
    assert bpe.round_trip_digests(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
