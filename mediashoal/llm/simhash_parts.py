"""SimHash near-duplicates at a Jaccard similarity of word shingles, 0.8 or more.

Texts of similarity 0.8 differ in some 10 of 64 SimHash bits, too many for buckets of
equal bit blocks. So buckets come from sub-documents:

1. A document's set is its distinct shingles, as 64-bit hashes; equal sets are one class,
   named by a digest. A set has a SimHash as a whole and one for each of ``PARTS``
   sub-documents: the ``LEAST`` smallest hashes of those that are k modulo ``PARTS``.
   Equal SimHashes of a sub-document make a bucket. At 0.8 two sets miss each other in
   all parts with a probability of (1 - 0.8 ** LEAST) ** PARTS, 3e-6; short parts, as of
   short texts, agree more often.
2. In a bucket, the binary trie of the whole SimHashes is joined with itself under an error
   budget of ``BUDGET`` bits (at 0.8, one pair in 5,000 has more). Sketches, a sixteenth of
   the sets, rule out most unlike pairs there and then, by a proven bound. A
   nearest-neighbour forest of the rest, linear in the bucket, is checked exactly.
3. Buckets that then hold several components are joined again, and all pairs across
   components that sketches do not rule out are checked. So no pair in the budget is left
   out, unless a path of checked pairs joins its ends. Buckets of over ``TILE`` rows are
   dealt by tiles, the second time by pairs of tiles, so that a large group of copies is
   no group in one task, and no list of its pairs leaves one.

The check compares the sets, as hashes of 32 bits. Nulls and empty texts: the empty set, all one
class. Texts shorter than a shingle are one shingle. Ties and repeats do not matter: a
class is kept by its least id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.llm.arrow import give_back
from mediashoal.llm.simhash import first_of_each, join_trie, named_classes
from mediashoal.operators.graph import connected_components, spanning_labels
from mediashoal.storage import materialize, small_batches

PARTS, LEAST = 24, 4
BUDGET = 20
#: Rows of a bucket that meet in one list.
TILE = 256
#: Sets that a task remembers to have taken up.
SEEN = 1 << 16
#: Rows whose tries go down together, and sketches' words that are compared at once.
TOGETHER = 512
WORDS = 1 << 18
#: Most bits of a sketch; a smaller one than a set deserves rules out less.
SKETCH_BITS = 1 << 15


def shingle_set(text: str, width: int, seed: int) -> np.ndarray:
    """Ascending distinct hashes of all shingles; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*[words[j:] for j in range(width)], strict=False)) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(x, seed) for x in shingles]), ">u8").astype(np.uint64))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHashes of consecutive groups of hashes, none of them empty."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    starts = np.cumsum(counts) - counts
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def sub_documents(own: np.ndarray) -> list[int | None]:
    """The SimHash of each part, None for a part without shingles."""
    part = (own % np.uint64(PARTS)).astype(np.int64)
    order = np.argsort(part, kind="stable")  # hashes stay ascending in a part
    sizes = np.bincount(part, minlength=PARTS)
    within = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    chosen = own[order][within < LEAST]
    found = _majority(chosen, np.minimum(sizes, LEAST)[sizes > 0]).view(np.int64) if len(own) else []
    out: list[int | None] = [None] * PARTS
    for k, x in zip(np.flatnonzero(sizes).tolist(), np.asarray(found).tolist(), strict=True):
        out[k] = x
    return out


def sketch(own: np.ndarray) -> bytes:
    """The parity of the hashes that fall on each bit, of 2 to 4 bits a hash."""
    size = min(SKETCH_BITS, 1 << max(6, (2 * len(own) - 1).bit_length()))
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def least_differences(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the numbers of hashes that are in one of two sets only."""
    sizes = np.array(list(map(len, sketches)), np.int64) // 8
    out, least = np.zeros(len(i), np.int64), np.minimum(sizes[i], sizes[j])
    for size in np.unique(least).tolist():
        at = np.flatnonzero(least == size)
        used = np.unique(np.concatenate([i[at], j[at]]))
        rows = np.zeros((len(used), size), np.uint64)
        for row, k in zip(rows, used.tolist(), strict=True):
            words = np.frombuffer(sketches[k], np.uint64)
            while len(words) > size:  # a half laid over the other is the smaller sketch
                words = words[: len(words) // 2] ^ words[len(words) // 2 :]
            row[:] = words
        x, y, step = np.searchsorted(used, i[at]), np.searchsorted(used, j[at]), max(1, WORDS // size)
        for lo in range(0, len(at), step):
            differ = rows[x[lo : lo + step]] ^ rows[y[lo : lo + step]]
            out[at[lo : lo + step]] = np.bitwise_count(differ).sum(1, dtype=np.int64)
    return out


def prints(docs: DataFrame, ident: str, text: str, width: int, seed: int) -> DataFrame:
    """``(ident, fp, n, sim, parts, sketch, own)``; a task gives the last five once a set."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(ident).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        seen: set[int] = set()
        for batch in batches:
            made = []
            for t in batch.column(1).to_pylist():
                own = shingle_set(t, width, seed)
                fp = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                if fp in seen or not len(own):
                    made.append((fp, None, None, None, None, None))
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
                sim = int(_majority(own, np.array([len(own)])).view(np.int64)[0])
                made.append((fp, len(own), sim, sub_documents(own), sketch(own), np.unique((own >> np.uint64(32)).astype(np.uint32)).tobytes()))
            columns = [pa.array(c, k) for c, k in zip(zip(*made) if made else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [ident, "fp", "n", "sim", "parts", "sketch", "own"])
        give_back()

    kind = docs.schema[ident].dataType.simpleString()
    return rows.mapInArrow(run, f"`{ident}` {kind}, fp bigint, n bigint, sim bigint, parts array<bigint>, sketch binary, own binary")


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges are a minimum spanning forest by ``d`` (Boruvka's rounds)."""
    order = np.lexsort((j, i, d))
    i, j = i[order], j[order]
    chosen, label, live = np.zeros(0, np.int64), np.arange(n), np.arange(len(i))
    while len(live := live[label[i[live]] != label[j[live]]]):
        best = np.full(n, len(i))
        np.minimum.at(best, label[i[live]], live)
        np.minimum.at(best, label[j[live]], live)
        chosen = np.union1d(chosen, best[best < len(i)])
        label = spanning_labels(n, i[chosen], j[chosen])
    return order[chosen]


def _near(nearest: bool):
    """Pairs of lists of ``(fp, sim, n, part, sketch)`` that trie, sizes and sketches leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            fp, sim, n, part = (flat.field(k).to_numpy() for k in range(4))
            sim, sketches = sim.view(np.uint64), flat.field(4)
            order = np.lexsort((sim, np.repeat(np.arange(len(sizes)), sizes)))
            fp, sim, n, part, sketches = fp[order], sim[order], n[order], part[order], sketches.take(pa.array(order))
            ends = np.cumsum(sizes)
            cut = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), len(sizes)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                base, end = ends[lo] - sizes[lo], ends[hi - 1]
                i, j = join_trie(sim[base:end], ends[lo:hi] - sizes[lo:hi] - base, ends[lo:hi] - base, BUDGET)
                x, y = n[base + i], n[base + j]
                possible = (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (part[base + i] != part[base + j])
                i, j = i[possible], j[possible]
                apart, both = least_differences(sketches.slice(base, end - base).to_pylist(), i, j), (x + y)[possible]
                possible = 9 * ((both - apart) // 2) >= 4 * both
                i, j = i[possible], j[possible]
                if nearest:
                    kept = nearest_forest(end - base, i, j, apart[possible] * 1000 // both[possible])
                    i, j = i[kept], j[kept]
                a, b = fp[base + i], fp[base + j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        give_back()

    return run


def _joined(rows: DataFrame, nearest: bool) -> DataFrame:
    """``(a, b)`` from ``(key, tile, fp, sim, n, part, sketch)``; a tile's rows are bounded."""
    lists = rows.groupBy("key", "tile").agg(F.collect_list(F.struct("fp", "sim", "n", "part", "sketch")).alias("own")).where(F.size("own") > 1)
    return lists.select("own").mapInArrow(_near(nearest), "a bigint, b bigint").distinct()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True))
            same.append(9 * both >= 4 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(same, pa.bool_()))


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets, of ``(fp, own)``, are similar."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(side), F.col("own").alias(f"own_{side}")), side)
    return materialize(pairs.select("a", "b", "own_a", "own_b").mapInArrow(_exact, "a bigint, b bigint"), "similar")


def similar_links(marked: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of digests at 0.8 or more that keep every component whole."""
    small_batches(marked.sparkSession)
    whole = marked.where("n is not null")
    parts = whole.select("fp", F.posexplode("parts").alias("k", "part")).where("part is not null")
    parts = parts.select(F.xxhash64("k", "part").alias("key"), "fp")
    # several tasks may give one set, so these counts are upper bounds
    buckets = materialize(parts.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    members = materialize(parts.join(buckets, "key").dropDuplicates(["key", "fp"]), "members")
    sets = whole.select("fp", "n", "sim", "sketch", "own").join(members.select("fp").distinct(), "fp", "left_semi")
    sets = materialize(sets.dropDuplicates(["fp"]), "sets")
    light = sets.select("fp", "n", "sim", "sketch")

    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    own_tile = F.pmod(F.xxhash64("key", "fp"), F.greatest(tiles, F.lit(1))).cast("int")
    first = members.join(light, "fp").select("key", own_tile.alias("tile"), "fp", "sim", "n", F.col("fp").alias("part"), "sketch")
    first = materialize(_joined(first, True), "nearest")
    links = similar_pairs(first, sets)

    named = members.join(connected_components(links, "a", "b").withColumnRenamed("node", "fp"), "fp", "left").withColumn("part", F.coalesce("component", "fp"))
    mixed = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    rest = named.join(mixed, "key", "left_semi").join(light, "fp").withColumn("t", own_tile)
    others = F.transform(F.sequence(F.lit(0), tiles - 1), lambda u: F.least(u, F.col("t")).cast("bigint") * 2**31 + F.greatest(u, F.col("t")))
    second = _joined(rest.select("key", F.explode(others).alias("tile"), "fp", "sim", "n", "part", "sketch"), False)
    second = materialize(second.join(first, ["a", "b"], "left_anti"), "across")
    return links.unionAll(similar_pairs(second, sets))


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5, seed: int = 42) -> DataFrame:
    """One row of each component of similar texts, the one with the least id, as in ``docs``.

    Of rows that repeat this id one stays. Rows without an id stay only if their
    component has no id at all, and then one of those with one text.
    """
    marked = materialize(prints(docs, ident, text, width, seed), "prints")
    named = named_classes(marked, ident, lambda _: similar_links(marked))
    return first_of_each(docs, named, ident, text, lambda rows, key: prints(rows, key, text, width, seed).select(key, "fp"))
