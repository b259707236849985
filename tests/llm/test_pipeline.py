import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from mediashoal.llm import bpe, mixing, quality
from tests.llm.docs import documents, rows
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_quality import corpus
from tests.llm.test_simhash_parts import brute_kept as brute_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    shared = "\n".join(["a line that is shared by very many documents of this set"])
    made = [tuple(r) for r in corpus(spark).collect()]
    made = [(i, f"{shared}\n{t}" if t and i and i < 60 else t, *rest) for i, t, *rest in made]
    return documents(spark, [*made, (300, made[5][1] + " end", "en", "t", 9), *[(400 + (r[0] or 0), *r[1:]) for r in rows()]])


def test_stages_one_by_one(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, "")
    want = sorted(str(r["doc_id"]) for r in quality.judge(docs).where("kept").collect())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want and kept.columns == COLUMNS

    before = plain(kept)
    kept = corpus_pipeline.materialize(stage["line dedup"](spark, kept, ""), "test")
    assert sorted(str((i, t, n)) for i, t, _, _, n in plain(kept)) == sorted(str((x[0], x[1], len(x[1]))) for x in map(eval, brute_lines(before)))

    before = plain(kept)
    kept = stage["simhash near-dedup"](spark, kept, "")
    assert sorted(str(r[0]) for r in plain(kept)) == brute_similar(before)

    before = plain(kept)
    kept = corpus_pipeline.materialize(stage["mixing"](spark, kept, ""), "test")
    words = defaultdict(int)
    for i, t, *_ in plain(kept):
        words[i] += len(t.split())
    assert dict(words) == {r["id"]: r["taken"] for r in mixing.mix(documents(spark, before)).collect() if r["taken"]}
    assert all(n == len(t) for _, t, _, _, n in plain(kept))

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(corpus_pipeline.RANKS, "rb").read()), special_tokens={})
    want = sorted((i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t, *_ in plain(kept))
    got = stage["byte-level bpe"](spark, kept, "").collect()
    assert sorted((r["doc_id"], list(r["tokens"]), r["decoded_sha256"]) for r in got) == want
    assert all(r["n_tokens"] == len(r["tokens"]) for r in got)


def test_stages_keep_clashing_columns(spark, docs):
    """Columns named like those that operators add come out as they came in."""
    names = ["n_lines", "n_dropped", "fp", "component_id", "taken", "kept", "_text", "_d1", "size", "chunk"]
    table = docs
    for n in names:
        table = table.selectExpr("*", f"'mine' as `{n}`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.materialize(stage(spark, table, ""), "test")
        assert table.columns == [*COLUMNS, *names]
        assert table.where(" or ".join(f"`{n}` <> 'mine'" for n in names)).count() == 0
    assert dict(corpus_pipeline.STAGES)["byte-level bpe"](spark, table, "").count() == table.count() > 0


def test_empty_table_and_run(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
