"""Reversible line dedup: sharded cuckoo filters over exact reference counts.

The exact side is a reference table, one row ``(h1, h2, doc)`` for each document and
each of its long line keys (two 64-bit halves of XXH3-128), in the shared folder.
``counts`` sums it up: documents and largest id of each key. Inserting documents adds a
segment of rows, deleting adds a list of ids that older segments lose; only the keys
that a change touches are counted again. Deleting what was inserted restores the state
and each verdict with it. Many segments are put together now and then.

Keys found in ``min_docs`` documents and more are put into cuckoo filters, one for each
shard of the key space, of ``SHARD_KEYS`` keys or so; their number grows with the keys.
Filters support deletion: a key that falls under ``min_docs`` is taken out of its filter.
All lines go through the filters. If these take ``FILTER_BYTES`` at most they go to every
executor; else keys go to the filter of their shard, 24 bytes each, salted so that no
shard's lines are one group. A line whose key misses its filter stays. Those that hit are
looked up in the exact counts, so a false hit costs a look-up and changes nothing.

A line's key is the line without blanks at both ends, A-Z in lower case. Keys of
``min_chars`` code points and more, in ``min_docs`` documents and more, lose all their
lines except in the largest id that holds them.

Nulls: a null or empty text is one empty line. Documents without an id are not counted
and keep all lines. Rows with one id are one document: a key counts once for it. Lines
repeated inside the document that keeps them stay. Very long texts are whole. Columns
besides id and text are carried by ``dedup`` whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashoal.llm.arrow import BLANKS
from mediashoal.storage import materialize, small_batches

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of a shard, from half of it to twice as many.
SHARD_KEYS = 1 << 17
#: All shards' filters together, if they are broadcast; 2 bytes and a bit for each shared key.
FILTER_BYTES = 64 << 20
#: Lines that meet a copy of a shard's filter, if they are not.
SHARD_LINES = 1 << 20
SLOTS = 4
KICKS = 500
#: Segments and lists of deleted ids before references are written anew.
SEGMENTS = 16


class CuckooFilter:
    """Buckets of four 16-bit tags; partial-key cuckoo hashing (Fan et al., 2014)."""

    def __init__(self, expected: int):
        size = 1
        while size * SLOTS * 0.8 < max(1, expected):
            size *= 2
        self.tags = np.zeros((size, SLOTS), np.uint16)
        self.full = False  # a filter that could not take a key says yes to every key

    @staticmethod
    def _tag(h2: np.ndarray) -> np.ndarray:
        return (h2 >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    def _other(self, bucket, tag):
        spread = tag.astype(np.uint64) * np.uint64(0x5BD1E995)
        return (bucket ^ spread) & np.uint64(len(self.tags) - 1)

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        tag = self._tag(h2)
        first = h1 & np.uint64(len(self.tags) - 1)
        return tag, first, self._other(first, tag)

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(h1), bool)
        tag, a, b = self._places(h1, h2)
        return (self.tags[a] == tag[:, None]).any(1) | (self.tags[b] == tag[:, None]).any(1)

    def _place(self, tags: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Put tags into free slots of their buckets; indexes of those left over."""
        order = np.argsort(buckets, kind="stable")
        own = buckets[order]
        first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
        turn = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
        free = np.cumsum(self.tags[own] == 0, axis=1)
        fits = turn < free[:, -1]
        slots = (free == turn[:, None] + 1).argmax(1)
        self.tags[own[fits], slots[fits]] = tags[order[fits]]
        return order[~fits]

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """All keys at once; in each round, one key of a full bucket turns a tag out."""
        tag, a, b = self._places(h1, h2)
        left = self._place(tag, a)
        tag, at = tag[left], b[left]
        left = self._place(tag, at)
        tag, at = tag[left], at[left]
        for k in range(KICKS):
            if not len(tag):
                return
            full, first = np.unique(at, return_index=True)
            out = self.tags[full, k % SLOTS].copy()
            self.tags[full, k % SLOTS] = tag[first]
            wait = np.delete(np.arange(len(tag)), first)
            other = self._other(full, out)
            left = self._place(out, other)
            tag, at = np.concatenate([tag[wait], out[left]]), np.concatenate([at[wait], other[left]])
        self.full = self.full or len(tag) > 0

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Only of keys that were inserted."""
        if self.full:
            return
        tag, a, b = self._places(h1, h2)
        left = self._take(tag, a)
        self._take(tag[left], b[left])

    def _take(self, tags: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Take tags out of their buckets; indexes of those that were not there."""
        todo, missed = np.arange(len(tags)), []
        while len(todo):  # equal tags of one bucket leave one after the other
            _, first = np.unique(buckets[todo] << np.uint64(16) | tags[todo], return_index=True)
            now = todo[first]
            same = self.tags[buckets[now]] == tags[now, None]
            hit = same.any(1)
            self.tags[buckets[now[hit]], same[hit].argmax(1)] = 0
            missed.append(now[~hit])
            todo = np.delete(todo, first)
        return np.concatenate(missed) if missed else todo

    def to_bytes(self) -> bytes:
        return (b"\1" if self.full else b"\0") + self.tags.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        self = cls(0)
        self.full = data[:1] == b"\1"
        self.tags = np.frombuffer(data[1:], np.uint16).reshape(-1, SLOTS).copy()
        return self


def line_key(line: str, min_chars: int) -> bytes | None:
    """The 16-byte hash of a long line's key."""
    key = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)


def references(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(h1, h2, doc)``: once for each document and key."""
    small_batches(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                own = {d for line in t.split("\n") if (d := line_key(line, min_chars))} if len(t) >= min_chars else ()
                digests += own
                rows += [k] * len(own)
            h = _halves(digests).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(pa.array(rows, pa.int64()))], ["h1", "h2", "doc"])

    rows = docs.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"h1 bigint, h2 bigint, doc {kind}")


def counts(refs: DataFrame) -> DataFrame:
    """``(h1, h2, n_docs, last)``; a document's repeated references count once."""
    once = refs.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("_"))
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last"))


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("h1", 40), F.lit(shards)).cast("int").alias("shard")


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """``(shard, filter)`` of the keys ``(h1, h2)``; each shard is built on its own."""

    def run(group: pa.Table) -> pa.Table:
        h1, h2 = (group.column(n).to_numpy().view(np.uint64) for n in ("h1", "h2"))
        made = CuckooFilter(len(h1))
        made.insert(h1, h2)
        return pa.table({"shard": group.column("shard")[:1], "filter": pa.array([made.to_bytes()], pa.binary())})

    return keys.select(_shard(shards), "h1", "h2").groupBy("shard").applyInArrow(run, "shard int, filter binary")


class LineIndex:
    """References and filters of a growing and shrinking set of documents.

    Immutable: changes give another index, and the old one stays as it was.
    """

    def __init__(self, spark, kind: str, min_chars: int, min_docs: int):
        self.spark, self.kind, self.min_chars, self.min_docs = spark, kind, min_chars, min_docs
        #: references with True, ids that older references lose with False
        self.log: list[tuple[bool, DataFrame]] = []
        self.shared: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1

    @classmethod
    def empty(cls, spark, kind: str = "bigint", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        return cls(spark, kind, min_chars, min_docs)

    @property
    def refs(self) -> DataFrame:
        """``(h1, h2, doc)`` as of now."""
        found = self.spark.createDataFrame([], f"h1 bigint, h2 bigint, doc {self.kind}")
        for added, table in self.log:
            found = found.unionAll(table) if added else found.join(table, "doc", "left_anti").select("h1", "h2", "doc")
        return found

    def insert(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> LineIndex:
        added = references(docs, ident, text, self.min_chars)
        if not self.log:
            added = materialize(added, "line-refs")
            return self._with([(True, added)], None)
        added = materialize(added.distinct(), "line-refs")
        known = self.refs.join(added.select("doc").distinct(), "doc", "left_semi")
        fresh = materialize(added.join(known, ["h1", "h2", "doc"], "left_anti"), "line-refs")
        return self._with([*self.log, (True, fresh)], fresh.select("h1", "h2").distinct())

    def delete(self, ids: DataFrame, ident: str = "doc_id") -> LineIndex:
        """Without the documents of these ids."""
        gone = materialize(ids.select(F.col(ident).alias("doc")).where("doc is not null").distinct(), "line-gone")
        if not self.log:
            return self
        keys = materialize(self.refs.join(gone, "doc", "left_semi").select("h1", "h2").distinct(), "line-keys")
        return self._with([*self.log, (False, gone)], keys)

    def _with(self, log: list[tuple[bool, DataFrame]], keys: DataFrame | None) -> LineIndex:
        """After a change that touched ``keys``; None: all."""
        new = LineIndex(self.spark, self.kind, self.min_chars, self.min_docs)
        new.log = log
        if len(log) > SEGMENTS:
            new.log = [(True, materialize(new.refs, "line-refs"))]
        if keys is None:
            shared = counts(new.refs).where(F.col("n_docs") >= self.min_docs)
        else:
            touched = counts(new.refs.join(keys, ["h1", "h2"], "left_semi")).where(F.col("n_docs") >= self.min_docs)
            shared = self.shared.join(keys, ["h1", "h2"], "left_anti").unionByName(touched)
        new.shared = materialize(shared, "line-counts")
        wanted = 1 << max(0, (new.shared.count() // SHARD_KEYS).bit_length())
        new.shards = self.shards if self.filters is not None and self.shards in (wanted // 2, wanted, wanted * 2) else wanted
        keys = new.shared.select("h1", "h2")
        new.filters = materialize(build_filters(keys, new.shards) if self.filters is None or new.shards != self.shards else self._moved(keys), "line-filters")
        return new

    def _moved(self, keys: DataFrame) -> DataFrame:
        """The filters after keys came and went."""
        old = self.shared.select("h1", "h2")
        moves = keys.join(old, ["h1", "h2"], "left_anti").withColumn("gone", F.lit(False)).unionAll(old.join(keys, ["h1", "h2"], "left_anti").withColumn("gone", F.lit(True)))
        moves = moves.select(_shard(self.shards), "h1", "h2", "gone")
        sizes = keys.groupBy(_shard(self.shards)).count()
        fit = self.filters.join(sizes, "shard").where((F.length("filter") - 1) / 2 * 0.9 >= F.col("count")).select("shard", "filter")

        def run(moved: pa.Table, before: pa.Table) -> pa.Table:
            made = CuckooFilter.from_bytes(before.column("filter")[0].as_py())
            gone = moved.column("gone").to_numpy(zero_copy_only=False)
            h1, h2 = (moved.column(n).to_numpy().view(np.uint64) for n in ("h1", "h2"))
            made.delete(h1[gone], h2[gone])
            made.insert(h1[~gone], h2[~gone])
            return pa.table({"shard": before.column("shard"), "filter": pa.array([made.to_bytes()], pa.binary())})

        updated = moves.join(fit.select("shard"), "shard", "left_semi").groupBy("shard").cogroup(fit.groupBy("shard"))
        touched = updated.applyInArrow(lambda m, b: run(m, b) if m.num_rows else b.select(["shard", "filter"]), "shard int, filter binary")
        # shards without a filter yet, or that outgrew it, are built anew
        rest = build_filters(keys.join(fit.select("shard"), _shard(self.shards) == F.col("shard"), "left_anti"), self.shards)
        return touched.unionAll(rest)

    def suspects(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (doc, h1, h2) that their shard's filter holds."""
        size, shards = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0, self.shards
        names = keys.columns

        if size <= FILTER_BYTES:  # a size that was just measured
            sent = self.spark.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.collect()})

            def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                filters = {s: CuckooFilter.from_bytes(b) for s, b in sent.value.items()}
                for batch in batches:
                    h1, h2 = (batch.column(n).to_numpy().view(np.uint64) for n in ("h1", "h2"))
                    shard = (h1 >> np.uint64(40)).astype(np.int64) % shards
                    hit = np.zeros(len(h1), bool)
                    for s in np.unique(shard):
                        if s in filters:
                            at = np.flatnonzero(shard == s)
                            hit[at] = filters[s].contains(h1[at], h2[at])
                    yield batch.filter(pa.array(hit))

            return keys.mapInArrow(probe, keys.schema)

        salts = max(1, keys.count() // (shards * SHARD_LINES))
        dealt = keys.select(_shard(shards), F.pmod(F.xxhash64("doc", "h2"), F.lit(salts)).alias("salt"), *names)
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"), "filter")

        def of_shard(group: pa.Table, own: pa.Table) -> pa.Table:
            if not own.num_rows or not group.num_rows:
                return group.select(names).slice(0, 0)
            h1, h2 = (group.column(n).to_numpy().view(np.uint64) for n in ("h1", "h2"))
            return group.select(names).filter(pa.array(CuckooFilter.from_bytes(own.column("filter")[0].as_py()).contains(h1, h2)))

        return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(of_shard, keys.schema)

    def dedup(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` with the text's remaining lines, and ``n_lines, n_dropped`` appended.

        Where ``docs`` has columns of these names, the new ones get underscores behind
        theirs until they are free.
        """
        small_batches(docs.sparkSession)
        mark = uuid.uuid4().hex[:8]
        own = {n: f"{mark}_{k}" for k, n in enumerate(docs.columns)}
        taken, added = {n.lower() for n in docs.columns}, []
        for name in ("n_lines", "n_dropped"):
            while name in taken:
                name += "_"
            added.append(name)
        renamed, ident, text = docs.toDF(*own.values()), own[ident], own[text]
        min_chars = self.min_chars
        found = self.suspects(references(renamed, ident, text, min_chars)) if self.filters is not None else self.refs
        shared = self.shared if self.shared is not None else counts(self.refs)
        gone = found.join(shared, ["h1", "h2"]).where("doc <> last")
        # a document's dropped keys, at most as many as it has lines
        lists = gone.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")).withColumnRenamed("doc", f"{mark}_doc")
        lists = materialize(lists, "line-drops")
        # lists grow with the documents: always by sorting, never by broadcast, at any size
        joined = renamed.join(lists.hint("merge"), F.col(ident) == F.col(f"{mark}_doc"), "left")
        counted = [f"{mark}_lines", f"{mark}_dropped"]

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.names.index(text)
                texts, n_lines, n_dropped = [], [], []
                for t, keys in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    lines = (t or "").split("\n")
                    n_lines.append(len(lines))
                    if keys:
                        bad = {k["h1"].to_bytes(8, "big", signed=True) + k["h2"].to_bytes(8, "big", signed=True) for k in keys}
                        kept = [x for x in lines if line_key(x, min_chars) not in bad]
                        n_dropped.append(len(lines) - len(kept))
                        texts.append("\n".join(kept))
                    else:
                        n_dropped.append(0)
                        texts.append(t or "")
                columns = batch.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*own.values(), *counted])

        schema = ", ".join(f"`{f.name}` {'string' if f.name == text else f.dataType.simpleString()}" for f in renamed.schema.fields)
        out = joined.select(*own.values(), "gone").mapInArrow(drop, f"{schema}, {counted[0]} bigint, {counted[1]} bigint")
        return out.select(*[F.col(new).alias(old) for old, new in [*own.items(), *zip(added, counted, strict=True)]])


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Insert all documents into a new index and apply it to them."""
    index = LineIndex.empty(docs.sparkSession, docs.schema[ident].dataType.simpleString(), min_chars, min_docs).insert(docs, ident, text)
    return index.dedup(docs, ident, text)
