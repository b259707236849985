"""Byte-level BPE: encoding with a hierarchical-bitmap rank queue, and decoding.

``merge`` keeps the symbols of a pre-token as a linked list over byte positions. The
queue has a bucket for each merge rank, a heap of the positions where that merge is
possible, and a two-level bitmap of the buckets in use: find-first-set in the summary,
then in its word, gives the lowest rank, and the least position in its bucket is the
next merge. A merge only adds entries; those that it made stale are recognised when
they come up (the position is dead, or its pair has another rank now) and skipped. So
a pre-token of n bytes takes O(n log n), however long.

Pre-tokens seen before come from a bounded cache of two generations: when the young one
is full it becomes the old one, and what is used again moves back.

A null text is an empty one and has no tokens. A null token list decodes to null.
Texts are whole; other columns of the input are not used, whatever their names;
repeated rows and null ids come back as they are; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediashoal.llm.arrow import give_back, kept
from mediashoal.storage import small_batches

#: Bytes of each of the two generations of a Python worker's cache, and what an entry's
#: objects and its place in the table take.
CACHE_BYTES = 96 << 20
ENTRY = 260
#: The neighbours of each position at first, for pre-tokens of up to SHORT bytes.
SHORT = 64
AFTER, BEFORE = list(range(1, SHORT + 1)), list(range(-1, SHORT - 1))
#: Longer pre-tokens are not kept.
CACHE_LENGTH = 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file of base64 tokens and numbers."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Encoder:
    """Merges by rank; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {
            (ranks[a] << 32) | ranks[b]: r for t, r in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks
        }
        #: rank of two bytes, or -1
        self.starts = [self.pairs.get(a << 32 | b, -1) for a in self.single for b in self.single]
        #: the bitmap's words; all zero between two calls, as the queue runs empty
        self.words = [0] * (max(ranks.values()) // 64 + 1)

    def merge(self, piece: bytes) -> list[int]:
        """The three pushes are written out: calls would take most of the time.

        ``rank_at[i]`` is the rank of the merge that position i can make now, or -1, so
        an entry of the queue is stale if it differs. A bucket is a position, or a heap.
        """
        pair, words, starts = self.pairs.get, self.words, self.starts
        ids = list(map(self.single.__getitem__, piece))
        n = len(ids)
        if n <= SHORT:
            after, before = AFTER[:n], BEFORE[:n]
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, int | list[int]] = {}
        rank_at: list[int] = []
        summary = i = 0
        left = piece[0]
        for right in piece[1:]:
            rank = starts[left << 8 | right]
            rank_at.append(rank)
            if rank >= 0:
                if rank not in buckets:
                    buckets[rank] = i
                    word = rank >> 6
                    words[word] |= 1 << (rank & 63)
                    summary |= 1 << word
                elif isinstance(bucket := buckets[rank], int):
                    buckets[rank] = [bucket, i]  # ascending, so a heap
                else:
                    bucket.append(i)
            left = right
            i += 1
        rank_at.append(-1)
        while summary:
            word = (summary & -summary).bit_length() - 1
            bits = words[word]
            low = bits & -bits
            rank = word << 6 | low.bit_length() - 1
            i = buckets[rank]
            if i.__class__ is int or len(i) == 1:
                del buckets[rank]
                words[word] = bits = bits ^ low
                if not bits:
                    summary ^= 1 << word
                if i.__class__ is not int:
                    i = i[0]
            else:
                i = heappop(i)
            if rank_at[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], rank_at[j] = rank, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair(rank << 32 | ids[k], -1)
                rank_at[i] = new
                if new >= 0:
                    if new not in buckets:
                        buckets[new] = i
                        word = new >> 6
                        words[word] |= 1 << (new & 63)
                        summary |= 1 << word
                    elif isinstance(bucket := buckets[new], int):
                        buckets[new] = [bucket, i] if bucket < i else [i, bucket]
                    else:
                        heappush(bucket, i)
            else:
                rank_at[i] = -1
            h = before[i]
            if h >= 0:
                new = pair(ids[h] << 32 | rank, -1)
                rank_at[h] = new
                if new >= 0:
                    if new not in buckets:
                        buckets[new] = h
                        word = new >> 6
                        words[word] |= 1 << (new & 63)
                        summary |= 1 << word
                    elif isinstance(bucket := buckets[new], int):
                        buckets[new] = [bucket, h] if bucket < h else [h, bucket]
                    else:
                        heappush(bucket, h)
        return [x for x in ids if x >= 0]


class _Cache(dict):
    """key -> made(key) in two generations; long keys are made each time.

    What a generation may hold is counted in bytes: ENTRY for the objects of an entry,
    and the characters of key and value.
    """

    def __init__(self, made):
        self.made, self.old, self.room = made, {}, CACHE_BYTES

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.made(key)
            if len(key) > CACHE_LENGTH:
                return found
        self.room -= ENTRY + len(key) + len(found)
        if self.room < 0:
            self.old.clear()
            self.old.update(self)
            self.clear()
            self.room = CACHE_BYTES
        self[key] = found
        return found


class Tokenizer:
    def __init__(self, data: bytes, pattern: str):
        self.encoder = Encoder(read_ranks(data))
        self.find = regex.compile(pattern).findall
        self.pieces = _Cache(self._piece)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.encoder.ranks.get(raw)
        return array("i", [rank] if rank is not None else self.encoder.merge(raw)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as native 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))


class Decoder:
    """All tokens' bytes in one array, gathered for many ids at once."""

    def __init__(self, data: bytes):
        tokens = {r: t for t, r in read_ranks(data).items()}
        every = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.sizes = np.array(list(map(len, every)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(every), np.uint8)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        ids = lists.flatten().to_numpy()
        ends = np.cumsum(np.diff(lists.offsets.to_numpy()))
        sizes = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - upto[:-1], sizes) + np.arange(upto[-1])
        offsets = np.concatenate([[0], upto[ends]]).astype(np.int64)
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(self.bytes[at])]).cast(pa.binary())
        return pc.if_else(lists.is_valid(), made, pa.scalar(None, pa.binary())) if lists.null_count else made


@lru_cache(maxsize=4)
def _tokenizer(data: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(data, pattern)


@lru_cache(maxsize=4)
def _decoder(data: bytes) -> Decoder:
    return Decoder(data)


kept["bpe"] = lambda: (_tokenizer.cache_clear(), _decoder.cache_clear())


def _encoded(tokenizer: Tokenizer, texts: list[str | None]) -> pa.ListArray:
    raw = [tokenizer.encode(t) if t else b"" for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in raw], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))


def _mapped(rows: DataFrame, ranks_path: str, made, schema: str) -> DataFrame:
    """``made(file)`` gives a function from a batch's second column to further columns."""
    with open(ranks_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the input
    small_batches(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = made(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(batch.column(1))], names)
        give_back("bpe")

    return rows.mapInArrow(run, schema)


def _texts(docs: DataFrame, ident: str, text: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text")), docs.schema[ident].dataType.simpleString()


def encode(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(ident, tokens array<int>)`` per row. ``ranks_path`` is read on the driver."""

    def made(data: bytes):
        tokenizer = _tokenizer(data, pattern)
        return lambda texts: [_encoded(tokenizer, texts.to_pylist())]

    rows, kind = _texts(docs, ident, text)
    return _mapped(rows, ranks_path, made, f"{ident} {kind}, tokens array<int>")


def decode(tokens: DataFrame, ranks_path: str, ident: str = "doc_id") -> DataFrame:
    """``(ident, tokens, decoded binary)`` per row of ``encode``."""

    def made(data: bytes):
        decoder = _decoder(data)
        return lambda lists: [lists, decoder.decode(lists)]

    kind = tokens.schema[ident].dataType.simpleString()
    return _mapped(tokens.select(ident, "tokens"), ranks_path, made, f"{ident} {kind}, tokens array<int>, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``decode`` of ``encode``, in one Python worker instead of two that stand behind
    each other."""

    def made(data: bytes):
        tokenizer, decoder = _tokenizer(data, pattern), _decoder(data)

        def columns(texts: pa.Array) -> list[pa.Array]:
            lists = _encoded(tokenizer, texts.to_pylist())
            return [lists, decoder.decode(lists)]

        return columns

    rows, kind = _texts(docs, ident, text)
    return _mapped(rows, ranks_path, made, f"{ident} {kind}, tokens array<int>, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode, and digest both: the rows of the op4 query."""
    return round_trip(docs, ranks_path, pattern, ident, text).select(
        ident,
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("tokens").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
