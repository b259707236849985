"""URL verdicts: host and path rules, then logistic regression on hashed n-grams.

All of a URL's treatment is DataFrame functions: host and path are cut out by regular
expressions, the rule with the longest match wins, and where none matches, the n-grams
of host and path (3 to 5 characters, marked with ``^`` and ``$``, each side on its own)
are hashed by MD5 into ``BUCKETS`` weights and summed. The weights come from a small
labelled table, at most ``MAX_LABELLED`` rows (one of the user's, or ``generated``),
fitted by full-batch gradient descent on the driver; they are rounded to multiples of 2**-16 and kept as integers, so sums are
exact in any order. The weights, a constant array of ``BUCKETS``, are all that is sent.

A URL is blocked if its score is over zero. Nulls: a null URL and one without ``://``
have an empty host and path; no rule fits, and the score is that of the empty URL.
Repeated rows are judged like any other; other columns are not used, whatever their
names; an empty table gives no rows. A very long path is scored whole.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)
SCALE = 1 << 16
MAX_LABELLED = 10_000
ROUNDS = 1500
RATE = 8.0
DECAY = 1e-4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (host, path, verdict) of the rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Words of the labelled table: those of sites that block lists commonly hold, of plain
#: sites, and parts that either has.
UNWANTED = (
    "adult", "porn", "sex", "xxx", "cam", "escort", "dating", "casino", "poker", "bet", "bets", "lotto", "slots", "jackpot", "pills", "viagra", "drug", "diet", "spam", "scam",
    "phish", "malware", "crack", "warez", "torrent", "keygen", "ads", "banner", "popup", "track", "click", "promo", "cheap", "free", "win", "bonus", "loan", "replica",
)
PLAIN = (
    "news", "library", "garden", "history", "theory", "reading", "school", "museum", "weather", "travel", "music", "recipe", "science", "nature", "market", "village", "writer", "kitchen",
    "bridge", "forest", "harbour", "journal", "gazette", "atlas", "wiki", "forum", "docs", "support", "studio", "college",
)
NEUTRAL = ("", "", "er", "ing", "tion", "est", "on", "ly", "x", "hub", "zone", "farm", "online", "24", "world")
ENDS = ("com", "org", "net", "info")


def generated(n: int = 900, seed: int = 11) -> list[tuple[str, int]]:
    """An invented labelled table: URL, and 1 where it is to be blocked, as is every third.
    Both kinds have the same prefixes, endings and pages, so words make the difference;
    plain names are words, or any letters, as often as English has them, or pairs of these.
    """
    rng, out = random.Random(seed), []
    letters = "eeeeeeetttttaaaaooooiiiinnnnsssshhhhrrrddlluucmwfgypbvkjxqz"
    any_name = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(4, 9)))
    paired = lambda: "".join(rng.choice(("th", "sh", "st", "er", "on", "ti", "en", "re", "nd", "an", "ou", "le", "ha", "in", "ea", "or")) for _ in range(rng.randrange(2, 5)))
    for k in range(n):
        unwanted = k % 3 == 0
        first = rng.choice(UNWANTED) if unwanted else rng.choice((rng.choice(PLAIN), any_name(), paired()))
        second = rng.choice(NEUTRAL + UNWANTED) if unwanted else rng.choice(NEUTRAL + PLAIN + (any_name(), paired()))
        name = rng.choice(("-", "-", "")).join(x for x in ((first, second) if rng.random() < 0.7 else (second, first)) if x)
        host = rng.choice(("", "", "www.", "m.", "blog.")) + name + rng.choice((".example.", ".")) + rng.choice(ENDS)
        page = rng.choice(("en", "de", "fr", "es", "article", "item", "p")) + "/" + str(rng.randrange(10_000))
        if rng.random() < 0.25:
            page = (rng.choice(UNWANTED) if unwanted else rng.choice(PLAIN)) + "/" + page
        out.append((f"http{rng.choice(('', 's'))}://{host}/{page}{rng.choice(('', '/', '.html', '?page=2', '#top'))}", int(unwanted)))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as ``host_path`` has them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if c in UPPER else c for c in host), rest[:end]


def buckets(host: str, path: str) -> Counter:
    found = Counter()
    for side, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            for k in range(len(s) - n + 1):
                found[int(hashlib.md5((side + s[k : k + n]).encode()).hexdigest()[:3], 16)] += 1
    return found


def fit(labelled: list[tuple[str, int]]) -> tuple[list[int], int]:
    """Integer weights and bias from (URL, 0 or 1) rows."""
    labelled = labelled[:MAX_LABELLED]
    if not labelled:
        return [0] * BUCKETS, 0
    counts = [buckets(*split_url(u)) for u, _ in labelled]
    row = np.repeat(np.arange(len(counts)), list(map(len, counts)))
    at = np.array([b for c in counts for b in sorted(c)], np.int64)
    values = np.array([c[b] / math.sqrt(sum(c.values())) for c in counts for b in sorted(c)])
    wanted, weights, bias = np.array([y for _, y in labelled], np.float64), np.zeros(BUCKETS), 0.0
    for _ in range(ROUNDS):
        z = bias + np.bincount(row, weights[at] * values, len(counts))
        error = 1 / (1 + np.exp(-z)) - wanted
        bias -= RATE * error.mean()
        weights -= RATE * (np.bincount(at, error[row] * values, BUCKETS) / len(counts) + DECAY * weights)
    return np.rint(weights * SCALE).astype(int).tolist(), round(float(bias) * SCALE)


@lru_cache(maxsize=1)
def fitted() -> tuple[list[int], int]:
    """From the generated table."""
    return fit(generated())


def labelled_rows(table: DataFrame, url: str = "url", label: str = "label") -> list[tuple[str, int]]:
    """A labelled table's first MAX_LABELLED rows by URL, for ``fit``."""
    rows = table.select(F.col(url).cast("string"), F.col(label).cast("int")).where(F.col(label).isNotNull()).orderBy(url, label).limit(MAX_LABELLED)
    return [(u, y) for u, y in rows.collect()]


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.coalesce(F.translate(after[0], UPPER, UPPER.lower()), F.lit("")), F.coalesce(after[1], F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def score(host: Column, path: Column, weights: list[int], bias: int) -> Column:
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded into one constant

    def cut(s: Column, n: int):
        return lambda k: F.substring(s, k, F.lit(n))

    def side(mark: str, c: Column) -> Column:
        s = F.concat(F.lit("^"), c, F.lit("$"))
        grams = []
        for n in SIZES:
            starts = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
            grams.append(F.transform(starts, cut(s, n)))
        hashed = lambda acc, g: acc + F.get(table, F.conv(F.substring(F.md5(F.concat(F.lit(mark), g)), 1, 3), 16, 10).cast("int"))
        return F.aggregate(F.concat(*grams), F.lit(0).cast("bigint"), hashed)

    # each URL's sum is over the root of its number of n-grams; a sign needs the bias on that scale
    count = lambda c: sum((F.greatest(F.length(c) + 2 - (n - 1), F.lit(0)) for n in SIZES), F.lit(0))
    return side("h", host) + side("p", path) + F.lit(bias) * F.floor(F.sqrt((count(host) + count(path)).cast("double")))


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES, weights: tuple[list[int], int] | None = None) -> DataFrame:
    """``(ident, host, path, rule, verdict, score)`` per row."""
    weights = weights or fitted()
    host, path = host_path(F.col(url).cast("string"))
    rows = pages.select(F.col(ident), host.alias("host"), path.alias("path"))
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # longer rules are tested first
        fits = _fits(F.col("host"), F.col("path"), rule)
        best, verdict = F.when(fits, F.lit(rule[0] + rule[1])).otherwise(best), F.when(fits, F.lit(rule[2])).otherwise(verdict)
    scored = rows.select(F.col(ident), "host", "path", best.alias("rule"), verdict.alias("ruled"), score(F.col("host"), F.col("path"), *weights).alias("score"))
    said = F.coalesce("ruled", F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(F.col(ident), "host", "path", "rule", said.alias("verdict"), "score")


def oracle(weights: tuple[list[int], int]) -> str:
    """The same over the view ``pages``, for DuckDB."""
    ordered = sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True)
    test = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {test(r)} THEN '{r[0] + r[1] if k == 0 else r[2]}'" for r in ordered) + " END"
    grams = lambda mark, c: " || ".join(f"list_transform(range(1, greatest(length({c}) + 2 - {n - 1}, 0) + 1), lambda k: '{mark}' || substring('^' || {c} || '$', k, {n}))" for n in SIZES)
    count = " + ".join(f"greatest(length({c}) + 2 - {n - 1}, 0)" for c in ("host", "path") for n in SIZES)
    return f"""
        WITH w AS (SELECT [{",".join(map(str, weights[0]))}] AS w),
        u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's') AS host,
                     regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
        p AS (SELECT page_id, translate(host, '{UPPER}', '{UPPER.lower()}') AS host, path FROM u),
        s AS (SELECT p.*, {grams("h", "host")} || {grams("p", "path")} AS grams, {count} AS n FROM p),
        t AS (SELECT s.*, CAST(coalesce(list_sum(list_transform(grams, lambda g: w[CAST('0x' || md5(g)[1:3] AS INT) + 1])), 0)
                     + {weights[1]} * floor(sqrt(n)) AS BIGINT) AS score FROM s, w)
        SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM t"""
