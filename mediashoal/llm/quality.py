"""Quality rules: base text rules, and perplexity bands of a modified Kneser-Ney model.

The model is over the n-grams of ORDER UTF-8 bytes and all shorter ones; its tables grow
with the corpus, are made by Spark, and stay distributed:

1. ``grams``: a task cuts its texts into chunks of ``CHUNK_BYTES`` or so, in the order of
   the scan, and gives each n-gram of a chunk once, with its count.
2. ``train``: the counts summed up, less those of repeated copies of a text, so that each
   distinct text counts once. Continuation counts, three discounts an order, context
   weights and probabilities follow by grouping and joining on the hashes (packed bytes,
   a perfect hash); contexts and suffixes have at most 256 n-grams, so no group is hot.
3. ``score``: each chunk asks for its own n-grams, not those of the corpus, and gets them
   as one sorted hash array with a probability beside each hash; texts are looked up in
   it by binary search. Texts travel once, compressed, to meet the array. A chunk is named
   by a digest of its texts; one that came out otherwise the second time raises an error.

A document's perplexity is given as bits a byte. For each language, the median and the
median absolute deviation (MAD) of all distinct texts with enough words make a lower and an
upper limit; a short text's limits are wider by the noise of a mean. Medians are exact
over thousandths of a bit, so reruns agree.

Nulls: a null text counts as empty (no words, base_failed); a null language is a
language of its own. A language with one text has that text in the middle of its band; a
text at a limit is inside. Very long texts are read in slices. Repeated rows are judged
like any other. Columns of the input besides id, text and lang are not used by ``judge``;
``keep`` returns the input's own columns, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediashoal.llm.arrow import BLANKS, give_back
from mediashoal.storage import materialize, small_batches

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bytes of the longest n-grams; at most 7, so that a packed one is a positive integer.
ORDER = 5
#: N-grams of so many bytes are few, 16.8 million at most; their tables are made as needed.
SMALL = 3
#: Bytes of text whose n-grams are asked for together; those that travel in one piece.
CHUNK_BYTES = 32 << 20
PIECE_BYTES = 2 << 20
#: Half the width of a band, in MADs, for texts of LONG_BYTES and more.
BAND_MADS = 6.0
LONG_BYTES = 1200
#: Least MAD, in bits a byte, so that a language of a few equal texts has a band.
LEAST_MAD = 0.01
STEPS = 1000
#: Positions of texts that are worked on at once.
SLICE = 1 << 17


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines, seen, repeated = text.split("\n"), set(), 0
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                repeated += 1
            elif line.strip(BLANKS):
                seen.add(line)
    return len(words), chars, symbols, repeated, repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = times[which] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, bool)
    covered[: n - 2] |= hit
    covered[1 : n - 1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


class _Bytes:
    """Texts behind each other, each after ORDER - 1 zero bytes."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        pad = b"\0" * (ORDER - 1)
        self.raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
        self.starts = np.cumsum(self.sizes + ORDER - 1) - self.sizes

    def grams(self) -> Iterator[tuple[int, np.ndarray]]:
        """Slices of the n-grams that end at each position, with the first position."""
        for lo in range(ORDER - 1, len(self.raw), SLICE):
            part = self.raw[lo - ORDER + 1 : lo + SLICE].astype(np.int64)
            keys = np.zeros(len(part) - ORDER + 1, np.int64)
            for k in range(ORDER):
                keys = keys << 8 | part[k : k + len(keys)]
            yield lo, keys

    def inside(self) -> np.ndarray:
        """Whether a position is in a text."""
        steps = np.zeros(len(self.raw) + 1, np.int8)
        some = self.sizes > 0
        np.add.at(steps, self.starts[some], 1)
        np.add.at(steps, (self.starts + self.sizes)[some], -1)
        return np.cumsum(steps[:-1], dtype=np.int8).astype(bool)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Over the positions of each text."""
        upto = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return upto[self.starts + self.sizes] - upto[self.starts]


class _Counter:
    """Counts of n-grams; what is held grows with the different ones."""

    def __init__(self):
        self.grams, self.counts, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def add(self, texts: list[bytes]) -> None:
        made = _Bytes(texts)
        inside = made.inside()
        for lo, keys in made.grams():
            self.held.append(np.unique(keys[inside[lo : lo + len(keys)]], return_counts=True))
            if len(self.held) == 32:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        grams = np.concatenate([self.grams, *[x[0] for x in self.held]])
        counts = np.concatenate([self.counts, *[x[1] for x in self.held]])
        self.held = []
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        first = np.flatnonzero(np.diff(grams, prepend=-1))
        self.grams, self.counts = grams[first], np.add.reduceat(counts, first) if len(first) else counts
        return self.grams, self.counts


class _Chunk:
    """Names a chunk by its texts, in order."""

    def __init__(self):
        self.digest, self.size = xxhash.xxh3_64(), 0

    def add(self, text: bytes) -> bool:
        """Whether the chunk is full."""
        self.digest.update(len(text).to_bytes(8, "little"))
        self.digest.update(text)
        self.size += len(text)
        return self.size >= CHUNK_BYTES

    def name(self) -> int:
        return self.digest.intdigest() - (1 << 63)


def grams(texts: DataFrame) -> DataFrame:
    """``(chunk, gram, n)`` of ``texts`` (_text): each n-gram of a chunk once."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        chunk, counter, held, size = _Chunk(), _Counter(), [], 0

        def done():
            counter.add(held)
            g, n = counter.merge()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), chunk.name())), pa.array(g), pa.array(n)], ["chunk", "gram", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                raw = t.encode() if t else b""
                held.append(raw)
                size += len(raw)
                full = chunk.add(raw)
                if full:
                    yield done()
                    chunk, counter = _Chunk(), _Counter()
                elif size >= PIECE_BYTES:
                    counter.add(held)
                if full or size >= PIECE_BYTES:
                    held, size = [], 0
        if chunk.size:
            yield done()
        give_back()

    return texts.select("_text").mapInArrow(run, "chunk bigint, gram bigint, n bigint")


def _negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of texts (_text, _times) as counts below zero, for all times but one."""
    for batch in batches:
        for t, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counter = _Counter()
            counter.add([t.encode()])
            g, n = counter.merge()
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n * (1 - times))], ["gram", "n"])


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_d1"), F.xxhash64(F.lit(1), text).alias("_d2")]


def count_grams(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``(gram, n)`` over the distinct texts; ``asked`` are the ``grams`` of all of them."""
    some = texts.select("_text").where("_text <> ''")
    marked = some.select("_text", *_digests(F.col("_text")))
    # written, so that Spark knows the size: broadcast if small, else joined by sorting
    many = materialize(marked.groupBy("_d1", "_d2").agg(F.count("*").alias("_times")).where("_times > 1"), "repeated")
    copies = marked.join(many, ["_d1", "_d2"]).dropDuplicates(["_d1", "_d2"]).select("_text", "_times")
    less = copies.mapInArrow(_negative, "gram bigint, n bigint")
    return asked.select("gram", "n").unionAll(less).groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Interpolated modified Kneser-Ney, as tables of one row an n-gram.

    ``probabilities[k]``: ``(gram, p)`` of the n-grams of k bytes; ``weights[k]``:
    ``(context, weight)`` of the lower order after a context of k - 1 bytes.
    """

    probabilities: dict[int, DataFrame]
    weights: dict[int, DataFrame]


def discounts(times: list[int]) -> list[float]:
    """D0 = 0, D1, D2, D3+ of Chen and Goodman from the counts of the counts 1 to 4."""
    n = [float(x) for x in times]
    if not n[0] or not n[1]:
        return [0, 0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 for k in (1, 2, 3)]
    return [0, *[min(max(x, 0.01), k) for k, x in enumerate(d, 1)]]


def kneser_ney(counts: DataFrame) -> Model:
    """From all longest n-grams ``(gram, n)``, with positive counts."""
    levels = {ORDER: materialize(counts.repartition("gram").sortWithinPartitions("gram"), "grams")}
    for k in range(ORDER - 1, 0, -1):  # continuations: bytes that stand before
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        levels[k] = levels[k + 1].select(shorter).groupBy("gram").agg(F.count("*").alias("n"))
        if k > SMALL:
            levels[k] = materialize(levels[k], "grams")
    tables = [t.groupBy(F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("times")).select(F.lit(k).alias("k"), "n", "times") for k, t in levels.items()]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionAll(t)
    times = {(r["k"], r["n"]): r["times"] for r in every.collect()}  # five numbers an order
    below, probabilities, weights = None, {}, {}
    for k in range(1, ORDER + 1):
        d = discounts([times.get((k, n), 0) for n in (1, 2, 3, 4)])
        cut = F.element_at(F.array(*[F.lit(float(x)) for x in d[1:]]), F.least("n", F.lit(3)).cast("int"))
        table = levels[k].select("gram", "n", cut.alias("cut"), F.shiftright("gram", 8).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("rest"))
        sums = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare"))
        lower = table.join(sums, "context")
        lower = lower.withColumn("lower", F.lit(1 / 256)) if below is None else lower.join(below.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest")
        below = lower.select("gram", ((F.col("n") - F.col("cut") + F.col("spare") * F.col("lower")) / F.col("total")).alias("p"))
        if k == SMALL:
            below = materialize(below, "model")
        probabilities[k] = below
        weights[k] = sums.select("context", (F.col("spare") / F.col("total")).alias("weight"))
    return Model(probabilities, weights)


def _texts(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *more)


def _scannable(docs: DataFrame) -> DataFrame:
    """``docs``, written first if its rows could come in another order the next time."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    return materialize(docs, "documents") if "Exchange" in plan or "QueryStage" in plan else docs


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all distinct texts; nothing of it is gathered."""
    rows = _texts(docs, text)
    return kneser_ney(count_grams(rows, grams(rows)))


def log_probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """``(gram, bits)`` of the distinct ``gram`` of ``wanted``: minus the binary logarithm.

    An n-gram not in the model has the probability of its shorter rest times the weight
    of its context, if that is known.
    """
    todo, found = wanted.select("gram", F.lit(0.0).alias("bits")).distinct(), None
    for k in range(ORDER, 0, -1):
        key = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        known = todo.withColumn("key", key).join(model.probabilities[k].select(F.col("gram").alias("key"), "p"), "key", "left")
        hit = known.where("p is not null").select("gram", (F.col("bits") - F.log2("p")).alias("bits"))
        found = hit if found is None else found.unionAll(hit)
        weights = model.weights[k].select(F.col("context").alias("key"), "weight")
        missed = known.where("p is null").select("gram", "bits", F.shiftright("key", 8).alias("key")).join(weights, "key", "left")
        todo = missed.select("gram", (F.col("bits") - F.log2(F.coalesce("weight", F.lit(1.0)))).alias("bits"))
    return found.unionAll(todo.select("gram", (F.col("bits") + 8).alias("bits")))


def _packed(rows: DataFrame) -> DataFrame:
    """``(chunk, piece)``: compressed record batches of the rows, the text first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        chunk, pieces, held, size = _Chunk(), [], [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))

        def pack():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=options) as out:
                out.write_table(table)
            pieces.append(sink.getvalue().to_pybytes())
            held.clear()

        def done():
            if held:
                pack()
            names = pa.array(np.full(len(pieces), chunk.name()))
            return [pa.RecordBatch.from_arrays([names[k : k + 1], pa.array([x], pa.binary())], ["chunk", "piece"]) for k, x in enumerate(pieces)]

        for batch in batches:
            first = 0
            for k, t in enumerate(batch.column(0).to_pylist()):
                raw = t.encode() if t else b""
                size += len(raw)
                full = chunk.add(raw)
                if full or size >= PIECE_BYTES:
                    held.append(batch.slice(first, k + 1 - first))
                    first, size = k + 1, 0
                    pack()
                if full:
                    yield from done()
                    chunk, pieces = _Chunk(), []
            if first < batch.num_rows:
                held.append(batch.slice(first))
        yield from done()
        give_back()

    return rows.mapInArrow(run, "chunk bigint, piece binary")


class _Lookup:
    """Values of n-grams in arrays sorted by hash; the hash's top bits give the place to
    start from, a few steps at most before the n-gram itself."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        bits = max(1, int(2 * len(grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        grams, first = np.unique(grams, return_index=True)
        slot = self._slot(grams)
        order = np.argsort(slot, kind="stable")
        self.grams, self.values = np.append(grams[order], -1), np.append(values[first][order], np.float32(0))
        self.starts = np.searchsorted(slot[order], np.arange(1 << bits)).astype(np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts[self._slot(keys)]
        todo = np.flatnonzero(self.grams[at] != keys)
        while len(todo):
            at[todo] += 1
            if at[todo].max() >= len(self.grams):
                raise RuntimeError("a chunk's n-grams are not those asked for: the table's rows came in another order; write it first")
            todo = todo[self.grams[at[todo]] != keys[todo]]
        return self.values[at]


def _scored(docs: DataFrame, text: str, lang: str, wanted: list[str], model: Model | None) -> DataFrame:
    """The ``wanted`` columns, two digests of the text, and what model and base rules measure."""
    small_batches(docs.sparkSession)
    rows = _texts(docs, text, F.col(lang).cast("string").alias("_lang"), *[F.col(f"`{n}`") for n in wanted])
    asked = grams(rows)
    if model is None:
        asked = materialize(asked, "asked")
        table = kneser_ney(count_grams(rows, asked)).probabilities[ORDER].select("gram", (-F.log2("p")).alias("bits"))
    else:
        table = log_probabilities(asked, model)
    arrays = asked.select("chunk", "gram").join(table, "gram").select("chunk", "gram", F.col("bits").cast("float").alias("bits"))
    measured = ["_words", "_chars", "_symbols", "_dup", "_repeat"]
    names = [*wanted, "_lang", "_d1", "_d2", "_bytes", "_bits", *measured]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bits_of = _Lookup(right.column("gram").to_numpy(), right.column("bits").to_numpy())
        out = []
        for piece in left.column("piece"):
            for batch in pa.ipc.open_stream(piece.as_buffer()):
                texts = batch.column(0).to_pylist()
                raw = [t.encode() for t in texts]
                made = _Bytes(raw)
                inside, values = made.inside(), np.zeros(len(made.raw), np.float32)
                for lo, keys in made.grams():
                    own = np.flatnonzero(inside[lo : lo + len(keys)])
                    values[lo + own] = bits_of(keys[own])
                each = made.sums(values) / np.maximum(made.sizes, 1)
                digests = [np.array([xxhash.xxh3_64_intdigest(x, seed) for x in raw], np.uint64).view(np.int64) for seed in (0, 1)]
                columns = [batch.column(k + 2) for k in range(len(wanted))] + [batch.column(1), *map(pa.array, digests), pa.array(made.sizes), pa.array(each)]
                columns += [pa.array(c, pa.int64()) for c in zip(*map(base_features, texts), strict=True)]
                out.append(pa.RecordBatch.from_arrays(columns, names))
        if not out:
            raise RuntimeError("n-grams were asked for by a chunk that did not come again; write the table first")
        give_back()
        return pa.Table.from_batches(out)

    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in wanted]
    schema = ", ".join([*kinds, "_lang string, _d1 bigint, _d2 bigint, _bytes bigint, _bits double", *[f"{n} bigint" for n in measured]])
    return _packed(rows).groupBy("chunk").cogroup(arrays.groupBy("chunk")).applyInArrow(run, schema)


def bands(scores: DataFrame, mads: float = BAND_MADS) -> DataFrame:
    """``(lang, middle, half)`` from rows of ``_lang, _bits``: median and band, in bits a byte.

    Each task counts the steps of its rows, so a language with most rows is a few
    thousand counts a task.
    """
    median = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast("bigint")
    steps = scores.select("_lang", F.round(F.col("_bits") * STEPS).cast("bigint").alias("step"))
    # written, so that Spark knows the size, as below
    middle = materialize(steps.groupBy(F.col("_lang").alias("lang")).agg(median("step").alias("middle")), "middles")
    away = steps.join(middle, F.col("_lang").eqNullSafe(F.col("lang"))).select("lang", "middle", F.abs(F.col("step") - F.col("middle")).alias("away"))
    both = away.groupBy("lang", "middle").agg(median("away").alias("mad"))
    return both.select("lang", (F.col("middle") / STEPS).alias("middle"), (mads * F.greatest(F.col("mad") / STEPS, F.lit(LEAST_MAD))).alias("half"))


def _judged(docs: DataFrame, text: str, lang: str, wanted: list[str], mads: float, model: Model | None) -> DataFrame:
    # small beside the texts: a few numbers a row
    scored = materialize(_scored(_scannable(docs), text, lang, wanted, model), "scored")
    once = scored.where(F.col("_words") >= MIN_WORDS).select("_lang", "_bits", "_d1", "_d2").dropDuplicates(["_lang", "_d1", "_d2"])
    # written, so that Spark knows the size: a broadcast under its threshold, as for any
    # usual number of languages, and else a join by sorting
    limits = materialize(bands(once, mads), "bands")
    joined = scored.join(limits.withColumnRenamed("lang", "_band_lang"), F.col("_lang").eqNullSafe(F.col("_band_lang")), "left")
    failed = (F.col("_words") < MIN_WORDS) | (100 * F.col("_repeat") > MAX_REPEAT_PERCENT * F.col("_words"))
    wide = F.col("half") * F.sqrt(F.greatest(F.lit(1.0), LONG_BYTES / F.greatest(F.col("_bytes"), F.lit(1)).cast("double")))
    inside = F.coalesce(F.abs(F.col("_bits") - F.col("middle")) <= wide, F.lit(True))
    return joined.select(
        *[F.col(f"`{n}`") for n in wanted], "_words", "_chars", "_symbols", "_dup", "_repeat", "_bits", "_lang",
        failed.alias("_failed"), (~failed & inside).alias("_kept"), (F.col("middle") - wide).alias("_low"), (F.col("middle") + wide).alias("_high"),
    )


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", mads: float = BAND_MADS, model: Model | None = None) -> DataFrame:
    """Per row: the base features, the perplexity with its band, and the verdict.

    Without a model, that of ``docs`` itself.
    """
    return _judged(docs, text, lang, [ident], mads, model).select(
        ident, F.col("_words").alias("n_words"), F.col("_chars").alias("word_chars"), F.col("_symbols").alias("n_symbols"), F.col("_dup").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"),
        F.round("_bits", 6).alias("bits_per_byte"), F.round("_low", 6).alias("low"), F.round("_high", 6).alias("high"),
    )


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", mads: float = BAND_MADS, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The verdict is a function of text and language, so rows are left out by these.
    """
    mark = uuid.uuid4().hex[:8]
    own = {n: f"{mark}_{k}" for k, n in enumerate(docs.columns)}
    renamed = _scannable(docs).toDF(*own.values())
    whole = F.coalesce(F.col(own[text]).cast("string"), F.lit(""))
    keys = [c.alias(f"{mark}_d{k}") for k, c in enumerate(_digests(whole))]
    judged = _judged(renamed.select("*", *keys), own[text], own[lang], [f"{mark}_d0", f"{mark}_d1"], mads, model)
    # written, so that Spark knows the size, as above
    out = materialize(judged.where("not _kept").select("_lang", F.col(f"{mark}_d0").alias("_r0"), F.col(f"{mark}_d1").alias("_r1")).distinct(), "rejected")
    same = (F.col(f"{mark}_d0") == F.col("_r0")) & (F.col(f"{mark}_d1") == F.col("_r1")) & F.col(f"{mark}_lang").eqNullSafe(F.col("_lang"))
    passed = renamed.select("*", *keys, F.col(own[lang]).cast("string").alias(f"{mark}_lang")).join(out, same, "left_anti")
    return passed.select(*[F.col(new).alias(old) for old, new in own.items()])
