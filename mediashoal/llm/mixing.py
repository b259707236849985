"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: each source gets a share of the total by weight, at most ``max_repeats``
   times its own size; what is over goes to the others by weight.
2. Each source's documents, shuffled by hash, form a stream of words, cut into blocks
   of equal length (shorter for sources of under ``LEAST_BLOCKS`` blocks, so that each
   target can be met closely). Positions come from sums by hash bucket and running
   sums inside one, so no task holds a whole source.
3. Slot t of the schedule has the point frac(t * golden ratio), in 32-bit arithmetic,
   and belongs to the source in whose share of [0, 1) it falls. Slots are ranked by
   source, again by sums over chunks; a source stops when its quota is full, and slot
   rank r takes block r modulo the number of blocks: a repeat begins when all are taken.
4. Blocks join the documents that they cover, which gives the words taken of each.

Nothing is random: reruns agree. Nulls: a null text has no words; a null source is one
source, ordered last. Rows with one id and size are documents of their own. An empty
table, or one without a word, gives targets of zero. Slots behind the schedule are
ordered by rank, then source. Very long texts are counted and cut whole. The number of sources is that of
their small table: ranking and shares use one window over it; documents and slots never
meet in one task. Columns besides id, text and source are not used by ``mix``;
``apply_mix`` returns the input's own columns, whatever their names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediashoal.storage import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Slots are about so many over all sources, until blocks have MAX_BLOCK words.
SLOTS = 1 << 20
MIN_BLOCK, MAX_BLOCK = 16, 4096
LEAST_BLOCKS = 64
#: Hash buckets of a source, cells of [0, 1), and slots of a chunk.
BUCKETS, CELLS, CHUNK = 4096, 4096, 1 << 16
#: 2**32 divided by the golden ratio, odd.
GOLDEN = 2654435769
#: The schedule runs on for this much, which fills nearly all quotas; the rest of a quota
#: gets slots behind it.
EXTRA = 1.02
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_size, sid, target)`` from ``(source, source_size)``.

    A source is at its limit if the level (target over weight) that the sources with
    lower limits leave is over its own; the last level holds for all others.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source").cast("string").cast("binary"))
    table = sources.withColumn("sid", F.row_number().over(ordered).cast("bigint"))
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1))
    table = table.withColumn("most", (max_repeats * F.col("source_size")).cast("double")).withColumn("budget", share * F.sum("source_size").over(everything))
    lower = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("spent", F.coalesce(F.sum("most").over(lower), F.lit(0.0))).withColumn(
        "left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))
    )
    table = table.withColumn("full", F.col("most") * F.col("left") <= (F.col("budget") - F.col("spent")) * F.col("weight"))
    over = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(everything)
    level = F.try_divide(F.col("budget") - over("most"), F.sum("weight").over(everything) - over("weight"))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return table.select("source", "source_size", "sid", target.alias("target"))


def streams(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """``sized`` with ``sid, start``: each document's place in its source's stream."""
    rows = sized.join(shares.select("source", "sid", "block", "blocks"), sized["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    rows = rows.withColumn("h", F.xxhash64(F.col("id"), F.col("size"), F.lit("stream"))).withColumn("bucket", F.shiftrightunsigned("h", 64 - int(math.log2(BUCKETS))))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(sums, ["sid", "bucket"])
    return rows.withColumn("start", F.col("offset") + F.col("upto") - F.col("size")).drop("h", "bucket", "upto", "offset")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """``(slot, sid, block_no, repeat)``: the blocks to take, in the mix's order."""
    spark = shares.sparkSession
    everything = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("quota") / F.sum("quota").over(Window.partitionBy())
    spans = shares.where("quota > 0").withColumn("part", part).withColumn("hi", F.sum("part").over(everything)).withColumn("lo", F.col("hi") - F.col("part"))
    edges = spans.select(
        "sid", "blocks", "quota", F.round(F.col("lo") * 2.0**32).cast("bigint").alias("lo"), F.round(F.col("hi") * 2.0**32).cast("bigint").alias("hi")
    )
    width = 2**32 // CELLS
    cells = edges.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(2**31)) * F.lit(GOLDEN), F.lit(2**32)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") / width))
    owned = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "sid", "blocks", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = owned.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = owned.withColumn("place", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot"))).join(sums, ["sid", "chunk"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("place") - 1).where("rank < quota").select("slot", "sid", "blocks", "rank")
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = spans.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    late = short.select("sid", "blocks", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("rank"))  # a few a source
    late = late.select((F.col("rank") + slots).alias("slot"), "sid", "blocks", "rank")
    ranked = ranked.unionAll(late)
    return ranked.select("slot", "sid", F.pmod("rank", "blocks").alias("block_no"), F.floor(F.col("rank") / F.col("blocks")).alias("repeat"))


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(id, source, size, source_size, target, taken)`` per row of ``docs``."""
    sized = docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = materialize(sized, "mix-sizes")
    table = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    total = sized.agg(F.sum("size")).first()[0] or 0
    length = min(MAX_BLOCK, max(MIN_BLOCK, int(share * total) // SLOTS))
    table = table.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(length), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("bigint"))
    table = table.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))  # times that all blocks are taken, the short last one too
    rest = F.col("target") - whole * F.col("source_size")
    quota = F.coalesce(whole * F.col("blocks") + F.least(F.col("blocks"), F.round(rest / F.col("block")).cast("bigint")), F.lit(0))
    shares = materialize(table.withColumn("quota", quota.cast("bigint")), "mix-shares")
    slots = shares.agg(F.sum("quota"), F.count("*")).first()
    plan = schedule(shares, int((slots[0] or 0) * EXTRA) + 64)
    times = plan.groupBy("sid", "block_no").agg(F.count("*").alias("times"))
    covered = streams(sized.where("size > 0"), shares).select(
        "id", "sid", "size", "start", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))).alias("block_no")
    )
    words = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    met = covered.join(times, ["sid", "block_no"], "left").select("id", "sid", "size", "start", (words * F.coalesce("times", F.lit(0))).alias("part"))
    taken = met.groupBy("sid", "start", "size", "id").agg(F.sum("part").alias("taken"))
    named = taken.join(shares, "sid").select("id", "source", "size", "source_size", "target", "taken")
    empty = sized.where("size = 0").join(shares, sized["source"].eqNullSafe(shares["source"])).select("id", shares["source"], "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return named.unionAll(empty)


def apply_mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix's texts, with the columns of ``docs``: a document whose words are taken
    r times over has r rows; where a block ends inside it, a last row has the words up
    to there, joined by single blanks. Rows with one id, source and size share evenly.
    """
    mark = uuid.uuid4().hex[:8]
    own = {n: f"{mark}_{k}" for k, n in enumerate(docs.columns)}
    renamed, size = docs.toDF(*own.values()), f"{mark}_size"
    plan = mix(docs, ident, text, source, **options)
    plan = plan.groupBy("id", "source", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    rows = renamed.withColumn(size, word_count(F.col(own[text])))
    joined = rows.join(plan, rows[own[ident]].eqNullSafe(plan["id"]) & rows[own[source]].eqNullSafe(plan["source"]) & (rows[size] == plan["size"]))
    joined = joined.withColumn("mine", F.floor(F.col("taken") / F.col("rows")))
    joined = joined.withColumn("full", F.try_divide(F.col("mine") - F.pmod("mine", F.greatest("size", F.lit(1))), F.greatest("size", F.lit(1))).cast("int"))
    joined = joined.withColumn("over", (F.col("mine") - F.col("full") * F.col("size")).cast("int"))
    whole = F.when(F.col("full") > 0, F.array_repeat(F.lit(-1), F.col("full"))).otherwise(F.array().cast("array<int>"))
    pieces = F.concat(whole, F.when(F.col("over") > 0, F.array("over")).otherwise(F.array().cast("array<int>")))
    out = joined.withColumn("piece", F.explode(pieces))
    cut = F.array_join(F.slice(F.split(F.regexp_replace(F.col(own[text]), f"^{BLANK}+", ""), f"{BLANK}+"), 1, F.greatest("piece", F.lit(0))), " ")
    return out.select(*[(F.when(F.col("piece") < 0, F.col(new)).otherwise(cut) if old == text else F.col(new)).alias(old) for old, new in own.items()])
