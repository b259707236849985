"""SimHash near-duplicate classes by a binary-trie self-join.

1. ``fingerprints``: per document, XXH64 of every word shingle, majority vote per bit.
2. Equal fingerprints are one class; only distinct fingerprints go on, so a group of
   a million copies is one trie leaf.
3. ``trie_links``: two fingerprints within ``budget`` differing bits agree on at
   least one of ``budget + 1`` disjoint bit blocks. Each is sent to the bucket of each
   of its blocks; in a bucket, the trie of the sorted fingerprints is joined with
   itself: node pairs go down together, differing bits add up, and a pair of nodes is
   pruned as soon as the budget is exceeded. A bucket of over ``BUCKET_ROWS`` is dealt
   anew by blocks of the bits that are still free; the blocks are spread so that after
   the last level ``FREE_BITS`` or so bits stay free, which bounds every bucket, as
   fingerprints in it are distinct. Nothing is capped or dropped.
4. A bucket returns a spanning forest of its links (links of a bucket are up to
   quadratic, a forest is linear), which keeps every component whole.
5. Components are closed with star contraction.

Nulls: a null text counts as empty; empty texts have fingerprint zero and are linked
like any other. Rows of one doc_id are rows of their own; null doc_ids are never a
component id while another id is there. Input columns other than id and text are not
used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.llm.arrow import map_text
from mediashoal.operators.graph import connected_components, spanning_labels
from mediashoal.storage import materialize, small_batches

#: Largest bucket that one trie join takes before it is dealt anew.
BUCKET_ROWS = 4096
#: Levels of blocks end when about so many bits are free.
FREE_BITS = 13
#: Words that are hashed at once, so that a huge text needs little memory.
BLOCK_WORDS = 1 << 16
ALL = (1 << 64) - 1


def simhash(text: str, width: int = 3, seed: int = 42) -> bytes:
    """Big-endian 64-bit fingerprint of the whole text."""
    digest, votes, total, carry = xxhash.xxh64_digest, np.zeros(64, np.int64), 0, []
    rest = text.encode().lower()
    while rest:
        words = rest.split(None, BLOCK_WORDS)
        rest = words.pop() if len(words) > BLOCK_WORDS else b""
        words = carry + words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*[words[j:] for j in range(width)], strict=False))
        elif words and not total and not rest:
            shingles = [b" ".join(words)]
        else:
            carry = words
            continue
        raw = np.frombuffer(b"".join([digest(x, seed) for x in shingles]), np.uint8).reshape(-1, 8)
        votes += np.add.reduce(np.unpackbits(raw, axis=1), axis=0, dtype=np.int32)
        total += len(raw)
        carry = words[len(words) - width + 1 :] if width > 1 else []
    return np.packbits(2 * votes > total).tobytes() if total else bytes(8)


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(ident, fp bigint)``; the bigint has the fingerprint's 64 bits."""

    def kernel():
        return lambda t: (int.from_bytes(simhash(t, width, seed), "big", signed=True),)

    return map_text(docs, ident, text, "fp bigint", kernel)


def join_trie(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) within ``budget`` differing bits, inside each [start, end).

    ``values``: uint64, ascending in each range: its binary trie, as a node is the range
    of values with one prefix. All ranges go down level by level; what is left below the
    last bit are repeats.
    """
    a_lo, a_hi, left = starts.astype(np.int64), ends.astype(np.int64), np.full(len(starts), budget, np.int8)
    b_lo, b_hi = a_lo, a_hi
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -1, -1):
        if not len(left):
            break
        ones = ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)
        zeros = np.concatenate([[0], np.cumsum(1 - ones)])
        a_mid, b_mid = a_lo + zeros[a_hi] - zeros[a_lo], b_lo + zeros[b_hi] - zeros[b_lo]
        same = a_lo == b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, left, slice(None)),
            (a_mid, a_hi, b_mid, b_hi, left, slice(None)),
            (a_lo, a_mid, b_mid, b_hi, left - 1, left > 0),
            (a_mid, a_hi, b_lo, b_mid, left - 1, (left > 0) & ~same),
        ]
        a_lo, a_hi, b_lo, b_hi, left = (np.concatenate([p[k][p[5]] for p in parts]) for k in range(5))
        size_a, size_b = a_hi - a_lo, b_hi - b_lo
        alive = (size_a > 0) & (size_b > 0) & ~((a_lo == b_lo) & (size_a < 2))
        leaves = alive & (size_a == 1) & (size_b == 1)
        if leaves.any():
            i, j, most = a_lo[leaves], b_lo[leaves], left[leaves]
            low = np.uint64((1 << bit) - 1)
            near = np.bitwise_count((values[i] ^ values[j]) & low) <= most
            found.append((np.minimum(i, j)[near], np.maximum(i, j)[near]))
            alive &= ~leaves
        a_lo, a_hi, b_lo, b_hi, left = a_lo[alive], a_hi[alive], b_lo[alive], b_hi[alive], left[alive]
    for lo, hi, low, high in zip(*(x.tolist() for x in (a_lo, a_hi, b_lo, b_hi)), strict=True):
        i, j = (x.ravel() for x in np.meshgrid(np.arange(lo, hi), np.arange(low, high), indexing="ij"))
        found.append((np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]) if lo != low else (i[i < j], j[i < j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@lru_cache
def block_masks(budget: int) -> list[list[int]]:
    """For each level, budget + 1 disjoint masks that cover all 64 bits."""
    n, levels, free, level = budget + 1, [], 64.0, 0
    while free > FREE_BITS:
        order = np.random.default_rng(level).permutation(64) if level else np.arange(64)
        levels.append([sum(1 << int(p) for p in order[j::n]) for j in range(n)])
        free, level = free * budget / n if budget else 0, level + 1
    return levels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once for each block: the bucket's key, and the bits still free."""
    blocks = [
        F.struct(
            F.xxhash64(F.col("key"), F.lit(j), F.col("fp").bitwiseAND(F.col("free")).bitwiseAND(F.lit(_signed(m)))).alias("key"),
            F.col("free").bitwiseAND(F.lit(_signed(ALL ^ m))).alias("free"),
        )
        for j, m in enumerate(masks)
    ]
    return rows.select("fp", F.explode(F.array(*blocks)).alias("b")).select("b.key", "fp", "b.free")


def _joined(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().view(np.uint64)
            bucket = np.repeat(np.arange(len(sizes)), sizes)
            values = flat[np.lexsort((flat, bucket))]
            ends = np.cumsum(sizes)
            # so many values at a time that the frontier of node pairs stays small
            cut = [0, *(np.flatnonzero(np.diff(ends // (4 * BUCKET_ROWS))) + 1).tolist(), len(sizes)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                base = ends[lo] - sizes[lo]
                part = values[base : ends[hi - 1]]
                i, j = join_trie(part, ends[lo:hi] - sizes[lo:hi] - base, ends[lo:hi] - base, budget)
                label = spanning_labels(len(part), i, j)
                moved = np.flatnonzero(label != np.arange(len(part)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[moved].view(np.int64)), pa.array(part[label[moved]].view(np.int64))], ["a", "b"]
                )

    return run


def trie_links(classes: DataFrame, budget: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)``: a spanning forest of all links among the distinct ``fp`` values."""
    small_batches(classes.sparkSession)
    rows = classes.select("fp", F.lit(0).cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("free"))
    links, masks = None, block_masks(budget)
    for level, blocks in enumerate(masks):
        rows = _dealt(rows, blocks)
        hot = None
        if level < len(masks) - 1:
            hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("key"), "hot")
            hot = None if hot.isEmpty() else hot
        calm = rows if hot is None else rows.join(hot, "key", "left_anti")
        # a hash that collides joins two buckets, which loses nothing; repeats within it go
        buckets = calm.groupBy("key").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        found = buckets.select("fps").mapInArrow(_joined(budget), "a bigint, b bigint")
        links = found if links is None else links.unionAll(found)
        if hot is None:
            break
        rows = materialize(rows.join(hot, "key", "left_semi").select("fp", "key", "free"), "dealt")
    return links


def classes(marked: DataFrame, ident: str, budget: int) -> DataFrame:
    """``(fp, component, component_id)`` of the fingerprints of ``marked``."""
    return named_classes(marked, ident, lambda distinct: trie_links(distinct, budget))


def named_classes(marked: DataFrame, ident: str, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(fp, component, component_id)``; ``links`` gives ``(a, b)`` from the distinct ``fp``."""
    distinct = materialize(marked.groupBy("fp").agg(F.min(ident).alias("least")), "classes")
    found = connected_components(links(distinct), "a", "b").withColumnRenamed("node", "fp")
    grouped = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialize(grouped.join(first, "component").select("fp", "component", "component_id"), "named")


def near_duplicates(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 3, budget: int = 2, seed: int = 42
) -> DataFrame:
    """``(ident, fp, component_id)`` per row of ``docs``."""
    marked = materialize(fingerprints(docs, ident, text, width, seed), "simhash")
    return marked.join(classes(marked, ident, budget), "fp").select(ident, "fp", "component_id")


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5, budget: int = 3, seed: int = 42) -> DataFrame:
    """One row of each component, the one with the least id, with the columns of ``docs``.

    Of rows that repeat this id one stays. Rows without an id stay only if their
    component has no id at all, and then one of those with one text.
    """
    marked = materialize(fingerprints(docs, ident, text, width, seed), "simhash")
    return first_of_each(docs, classes(marked, ident, budget), ident, text, lambda rows, key: fingerprints(rows, key, text, width, seed))


def first_of_each(docs: DataFrame, named: DataFrame, ident: str, text: str, prints: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that stay; ``prints(rows, key)`` gives ``(key, fp)``."""
    kept = named.where("component_id is not null").select(F.col("component_id").alias(ident)).distinct()
    first = docs.where(F.col(ident).isNotNull()).join(kept.hint("merge"), ident, "left_semi").select(docs.columns).dropDuplicates([ident])
    nameless = docs.where(F.col(ident).isNull())
    if nameless.isEmpty():
        return first
    alone = named.where("component_id is null").groupBy("component").agg(F.min("fp").alias("fp"))
    texts = nameless.select(text).distinct().withColumn("_key", F.coalesce(F.col(text).cast("string"), F.lit("")))
    chosen = prints(texts, "_key").join(alone, "fp").groupBy("fp").agg(F.min("_key").alias("_key"))
    mark = f"key_{uuid.uuid4().hex[:8]}"
    rest = nameless.withColumn(mark, F.coalesce(F.col(text).cast("string"), F.lit(""))).join(chosen.select(F.col("_key").alias(mark)), mark, "left_semi")
    return first.unionAll(rest.dropDuplicates([mark]).select(docs.columns))
