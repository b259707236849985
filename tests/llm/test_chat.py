import random

import pytest
from pyspark.sql import functions as F

from mediashoal.llm import chat
from tests.llm.docs import clashing

KIND = "pair_id bigint, turn bigint, role string, text string"


def turns(rows, pair):
    own = {(-(2**63) if t is None else t, "unknown" if r is None else r, x or "") for p, t, r, x in rows if p == pair}
    return sorted(own)


def render(part):
    out, spans = "", []
    for _, role, text in part:
        out += f"<|{role.replace('<|', '< |')}|>\n"
        start = len(out)
        out += text.replace("<|", "< |") + "<|end|>\n"
        if role == "assistant":
            spans.append((start, len(out) - 1))
    return out, spans


def brute(chosen, rejected):
    out = {}
    for pair in {r[0] for r in chosen + rejected if r[0] is not None}:
        a, b = turns(chosen, pair), turns(rejected, pair)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        out[pair] = (render(a[:n])[0], *render(a[n:]), *render(b[n:]), n)
    return out


def result(df):
    return {r["pair_id"]: (r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_mask"]], r["rejected"], [tuple(s) for s in r["rejected_mask"]], r["n_common"]) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    chosen = [(p, t, rng.choice(["user", "assistant"]), rng.choice("ab") * rng.randrange(3)) for p in range(40) for t in range(rng.randrange(1, 7))]
    rejected = [(p, t, r, x if rng.random() < 0.8 else x + "é<|end|>") for p, t, r, x in chosen if rng.random() < 0.95]
    extra = [(50, None, None, None), (50, 1, "assistant", "é"), (50, 1, "assistant", "é"), (None, 0, "user", "no pair")]
    chosen += [*extra, (51, 0, "user", "only chosen")]
    rejected += [*extra, (52, 0, "assistant", "only rejected"), (50, 1, "user", "tie")]
    a, b = (clashing(spark.createDataFrame(x, KIND), "side", "tie", "pair") for x in (chosen, rejected))
    assert result(chat.format_preferences(a, b)) == brute(chosen, rejected)


def test_a_pair_is_one_row_over_many_ranges(spark):
    """One pair has most turns, others stand at the ends of ranges."""
    rng = random.Random(5)
    chosen = [(p, t * 5000, "assistant" if t % 2 else "user", f"t{rng.randrange(9)}") for p, n in ((1, 3), (2, 900), (3, 2), (4, 700), (5, 1)) for t in range(n)]
    rejected = [(p, t, r, x + "!" if (p, t) in ((2, 400 * 5000), (4, 5000), (5, 0)) else x) for p, t, r, x in chosen]
    a, b = (spark.createDataFrame(x, KIND).repartition(5) for x in (chosen, rejected))
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = chat.format_preferences(a, b)
        assert got.count() == 5 and result(got) == brute(chosen, rejected)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


@pytest.mark.parametrize("share, ranges", [(3, "200"), (2, "200"), (3, "16")])
def test_a_hot_pair_of_some_megabytes(spark, share, ranges):
    """Spark puts ranges together as it likes; each pair comes once, with all of its turns."""
    n = 10_000
    hot = n * 6 // share
    text = "concat('turn ', t, ' of ', pair_id, repeat(' and more words', 10))"
    small = spark.range(n).selectExpr("id + 1 AS pair_id", "explode(sequence(0, 5)) AS t")
    one = spark.range(hot).selectExpr("5000L + 0 * id AS pair_id", "cast(id + 100 AS int) AS t")
    a = small.unionAll(one).selectExpr("pair_id", "cast(t AS bigint) AS turn", "if(t % 2 = 0, 'user', 'assistant') AS role", f"{text} AS text")
    b = a.withColumn("text", F.when(F.col("turn") == 5, "another end").otherwise(F.col("text")))
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = chat.format_preferences(a, b).selectExpr("pair_id", "n_common", "size(chosen_mask) AS learned").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sorted(r["pair_id"] for r in got) == list(range(1, n + 1))
    assert {(r["n_common"], r["learned"]) for r in got if r["pair_id"] != 5000} == {(5, 1)}
    assert next((r["n_common"], r["learned"]) for r in got if r["pair_id"] == 5000) == (5, 1 + hot // 2)


def test_far_turn_numbers_and_many_rows_of_one(spark):
    rows = [(1, 1, "user", "a"), (1, 5000, "assistant", "b")]
    other = [(1, 1, "user", "a"), (1, 5000, "assistant", "c")]
    one = spark.range(100_000).selectExpr("7L AS pair_id", "cast(null AS bigint) AS turn", "'user' AS role", "concat('t', id % 50000) AS text")
    a, b = (spark.createDataFrame(x, KIND).unionAll(one) for x in (rows, other))
    got = {r["pair_id"]: r for r in chat.format_preferences(a, b).collect()}
    assert (got[1]["prompt"], got[1]["n_common"], len(got)) == (render([(1, "user", "a")])[0], 1, 2)
    assert got[7]["n_common"] == 50_000 and got[7]["chosen"] == ""


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    assert chat.format_preferences(df, df).count() == 0
    assert chat.format_turns(chat.turns_of(df.withColumnRenamed("pair_id", "conv_id"))).count() == 0


def test_pairs_share_all_but_the_last_turn(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c} {t}") for c in (4, 5, 8) for t in range(4)]
    made = chat.turns_of(spark.createDataFrame(rows, KIND.replace("pair_id", "conv_id")))
    got = {r["pair_id"]: r for r in chat.format_turns(made).collect()}
    assert got[4]["n_common"] == 3 and "5 3" in got[4]["rejected"] and "4 3" in got[4]["chosen"]
    assert got[8]["n_common"] == 4 and got[8]["chosen"] == got[8]["rejected"] == ""
