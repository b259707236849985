import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from mediashoal.llm import repair
from mediashoal.llm.queries import repaired_digests
from tests.llm.docs import clashing

KIND = "conv_id bigint, turn bigint, role string, text string"


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def brute(rows, conv):
    """By all edits, shortest texts of letters first, without states shared between rows."""
    own = [(t, r, x) for c, t, r, x in rows if c == conv]
    faults, seen = [], set()
    for _, r, x in own:
        words = re.sub(r"[\x20\x09-\x0d]", "", x)
        faults.append("blank" if not words else "duplicate" if (r, x) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((r, x))

    def ok(roles, more):
        """``roles`` is a prefix of what is allowed, or all of it."""
        return re.fullmatch(r"s?(ua)*u?" if more else r"(s?(ua)+)?", roles)

    @lru_cache(None)
    def best(i, last, inserted=0):
        """last: the initials so far, but only as much of them as matters; inserted: in a row."""
        found = []
        if i == len(own) and ok(last, False):
            found.append((0, "", ()))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if ok(last + initial, True) and inserted < 4:
                c, a, t = best(i, shorter(last + initial), inserted + 1)
                found.append((c + 3, "I" + a, (f"{role}:", *t)))
        if i < len(own):
            (_, r, x), fault = own[i], faults[i]
            c, a, t = best(i + 1, last)
            found.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if r[:1] in ("s", "u", "a") and ok(last + r[:1], True):
                    c, a, t = best(i + 1, shorter(last + r[:1]))
                    found.append((c + more, "K" + a, (f"{r}:{x}", *t)))
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if ok(last + initial, True):
                        c, a, t = best(i + 1, shorter(last + initial))
                        found.append((c + more + 3, "R" + a, (f"{role}:{x}", *t)))
        return min(found, default=(10**9, "", ()))

    def shorter(roles):
        return "s" if roles == "s" else roles[-1:] if roles[-1:] != "a" else "ua"

    cost, audit, lines = best(0, "")
    turns = {t for t, _, _ in own if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def made_up(n=120):
    rng = random.Random(4)
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "unique"])
            text = rng.choice(["Yes.", "No!", "What? ", "cut off", "", None, " \t", f"text {c} {t}.", "é" * 3, "a\n."])
            out.append((c, rng.choice([t, t, t * 3, None]), role, text))
    return [*out, (None, None, None, None), (None, 3, "user", "Of no conversation."), (None, 4, "assistant", "x"), out[3], out[3], (n, 2**63 - 1, "user", "far."), (n, -(2**63), "user", "near.")]


def result(df):
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = made_up()
    df = clashing(spark.createDataFrame(rows, KIND), "kind", "copies", "turns", "part")
    got = repaired_digests(df)
    all_rows = damaged(rows)
    expected = {c: brute(all_rows, c) for c in {r[0] for r in rows}}
    expected = {c: (min(x[0], 2**63 - 1), *x[1:]) for c, x in expected.items()}
    assert got.count() == len(expected) and result(got) == expected


def test_nothing_left_of_a_conversation(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = result(repaired_digests(spark.createDataFrame([(gone, 0, "user", "Hello.")], KIND)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_long_conversations_over_many_ranges(spark):
    """One conversation has a third of all rows; others end and begin at the ends of ranges."""
    rng = random.Random(6)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice([f"{t}.", "again.", "cut"])) for c, n in ((1, 5), (2, 300), (3, 1), (4, 250), (5, 2)) for t in range(n)]
    rows += [(c, t, "user", "one.") for c in range(10, 200) for t in range(2)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = result(repaired_digests(spark.createDataFrame(rows, KIND).repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    all_rows = damaged(rows)
    small = {c for c in {r[0] for r in rows} if c not in (2, 4)}
    assert set(got) == {r[0] for r in rows} and {c: got[c] for c in small} == {c: brute(all_rows, c) for c in small}
    for c in (2, 4):  # too long for recursion: against the automaton's own costs, and the form of what results
        own = [(c, t, r, x) for k, t, r, x in all_rows if k == c]
        audit = got[c][6]
        assert len(audit.replace("I", "")) == len(own)


def test_the_automaton_stays_small():
    rng, automaton = random.Random(1), repair.Automaton()
    for _ in range(3000):
        n = rng.randrange(12)
        automaton.repair([rng.randrange(9) for _ in range(n)], [("r", "t")] * n)
    assert len(automaton.vectors) < 100


def test_costs_of_a_long_one_equal_plain_dynamic_programming():
    rng, automaton = random.Random(2), repair.Automaton()
    kinds = [rng.randrange(9) for _ in range(5000)]
    cost, audit, turns = automaton.repair(kinds, [("r", "t")] * 5000)
    best = {0: 0, 1: 10**9, 2: 10**9, 3: 10**9}
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}

    def insert(b):
        for _ in range(4):
            for q in range(4):
                b[nxt[q]] = min(b[nxt[q]], b[q] + 3)
        return b

    for k in kinds:
        best, new = insert(best), dict.fromkeys(range(4), 10**9)
        for q, c in best.items():
            new[q] = min(new[q], c + 4)
            if k != 8:
                cut = 3 * (k % 2)
                if k // 2 == 0 and q == 0:
                    new[1] = min(new[1], c + cut)
                if (k // 2 == 1 and nxt[q] == 2) or (k // 2 == 2 and nxt[q] == 3):
                    new[nxt[q]] = min(new[nxt[q]], c + cut)
                new[nxt[q]] = min(new[nxt[q]], c + cut + 3)
        best = new
    best = insert(best)
    assert cost == min(best[0], best[3])
    paid = audit.count("D") * 4 + audit.count("I") * 3 + audit.count("R") * 3
    cut = sum(3 for k, a in zip(kinds, audit.replace("I", "")) if k % 2 and a != "D")
    assert paid + cut == cost and len(audit.replace("I", "")) == 5000 and len(turns) == len(audit) - audit.count("D")


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)]])
def test_empty_tables(spark, rows):
    assert repaired_digests(spark.createDataFrame(rows, KIND)).count() == len(rows)
