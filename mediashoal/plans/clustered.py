"""Snapshots of media in files that are ranges of one key, and searches that open few of them.

``Clustered.build`` writes a table sorted by date, path or place, and beside it one row a file:
its rows, its first and last (date, id), its range of place cells and box of coordinates, and
a bitmap of the trigrams of its names and paths. A search turns each of its conditions into one
on these rows: dates and boxes by overlap, circles by ranges of Z-order cells that cover
them, and texts by the trigrams that every match must have. What passes is opened and
searched as any table is, so results are the same; patterns without three letters in a row
open all files. Pages in order of date open only as many files as fill them.

Null dates come first and null places are in no range, as in searches. Empty tables have no
files and give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediashoal.functions import geo
from mediashoal.functions.dates import sort_ts
from mediashoal.functions.rules import ascii_lower
from mediashoal.plans import filters
from mediashoal.plans.filters import SearchFilter

ROWS_A_FILE = 1 << 20
#: Bits of a bitmap: what one of Spark's bitmaps holds.
BITS = 32768


def _key() -> Column:
    """The order of pages: null dates lowest."""
    return F.struct(sort_ts().isNotNull().cast("int").alias("known"), F.coalesce(sort_ts(), F.lit(0)).cast("bigint").alias("ts"), F.col("id").cast("bigint").alias("id"))


def _gram_bits(text: Column) -> Column:
    """Places in a bitmap of the trigrams of a text."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda k: F.substring(low, k, F.lit(3)))
    return F.transform(F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3)), gram_bit)


def gram_bit(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS)).cast("bigint")


def required_grams(pattern: str) -> list[str]:
    """Trigrams of whatever matches ``%pattern%``: of its runs without a wildcard."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pattern.strip())
    runs = low.replace("_", "%").split("%")
    return sorted({run[k : k + 3] for run in runs for k in range(len(run) - 2)})


def _has_bit(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2.0), bit % 8).cast("int")) != 0


class Clustered:
    """A snapshot in a folder; ``by``: date, path or place."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = spark.read.parquet(f"{self.folder}/rows").schema
        #: Files that the last search opened.
        self.opened: list[str] = []

    @classmethod
    def build(cls, media: DataFrame, folder: str, by: str, files: int | None = None) -> Clustered:
        spark, folder = media.sparkSession, folder.rstrip("/")
        rows = media.withColumn("place_cell", geo.cell(F.col("latitude"), F.col("longitude")))
        keys = {"date": [_key()], "path": [F.col("path")], "place": [F.col("place_cell"), F.col("id")]}[by]
        n = files or max(1, math.ceil(media.count() / ROWS_A_FILE))
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("maxRecordsPerFile", 0).parquet(f"{folder}/rows")
        written = spark.read.schema(rows.schema).parquet(f"{folder}/rows").withColumn("file", F.col("_metadata.file_path"))
        bounds = written.groupBy("file").agg(
            F.count("*").alias("n"), F.min(_key()).alias("first"), F.max(_key()).alias("last"), F.min(sort_ts()).alias("from_ts"), F.max(sort_ts()).alias("to_ts"),
            *[f(c).alias(f"{name}_{c}") for c in ("place_cell", "latitude", "longitude") for name, f in (("min", F.min), ("max", F.max))],
        )
        bits = written.select("file", F.explode(F.array_union(_gram_bits(F.col("path")), _gram_bits(F.col("file_name")))).alias("bit")).distinct()
        grams = bits.groupBy("file").agg(F.bitmap_construct_agg("bit").alias("grams"))
        bounds.join(grams, "file", "left").write.parquet(f"{folder}/files")
        return cls(spark, folder)

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/files")

    def open(self, files: list[str]) -> DataFrame:
        self.opened = files
        if not files:
            return self.spark.createDataFrame([], self.schema).drop("place_cell")
        return self.spark.read.schema(self.schema).parquet(*files).drop("place_cell")

    def candidates(self, f: SearchFilter) -> DataFrame:
        """Files that may hold a match."""
        found = self.files()
        if f.from_ts is not None:
            found = found.where(F.col("to_ts") >= f.from_ts)
        if f.to_ts is not None:
            found = found.where(F.col("from_ts") <= f.to_ts)
        for gram in required_grams(f.query or ""):
            found = found.where(_has_bit(F.col("grams"), gram_bit(F.lit(gram))))
        if geo.valid(f.lat, f.lng, f.radius_km):
            south, north, west, east = geo.bounding_box(f.lat, f.lng, f.radius_km)
            found = found.where((F.col("max_latitude") >= south) & (F.col("min_latitude") <= north))
            if west is not None:
                found = found.where((F.col("max_longitude") >= west) & (F.col("min_longitude") <= east))
            ranges = geo.cover(south, north, -180.0 if west is None else west, 180.0 if east is None else east)
            found = found.where(reduce(lambda a, b: a | b, [(F.col("max_place_cell") >= low) & (F.col("min_place_cell") <= high) for low, high in ranges]))
        return found

    def matching(self, f: SearchFilter, faces: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
        return filters.matching(self.open([r["file"] for r in self.candidates(f).select("file").collect()]), f, faces, people)

    def search(self, f: SearchFilter, faces: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
        return filters.page(self.matching(f, faces, people), f.sort_order, f.limit, f.offset)

    def page_after(self, f: SearchFilter, last_ts: int | None, last_id: int, limit: int | None = None) -> DataFrame:
        """``filters.page_after`` of what matches. Files come by their last row, the newest
        first, as many as hold a page, and twice as many while matches don't fill it."""
        after = (int(last_ts is not None), last_ts or 0, last_id)
        found = [(tuple(r["last"]), r["n"], r["file"]) for r in self.candidates(f).select("first", "last", "n", "file").collect() if tuple(r["first"]) < after]
        found.sort(reverse=True)
        size = min(max(filters.PAGE_DEFAULT if limit is None else limit, 1), filters.PAGE_MOST)
        n = held = 0
        while n < len(found) and held <= size:
            n, held = n + 1, held + (found[n][1] if n else 0)
        while True:
            page = filters.page_after(filters.matching(self.open([x[2] for x in found[:n]]), f), last_ts, last_id, limit)
            if n >= len(found) or page.count() >= size:
                return page
            n *= 2


def near_centres(media: DataFrame, centres: DataFrame) -> DataFrame:
    """``(centre_id, id, km)``: media in the circle of each of ``centres`` (centre_id, lat, lng,
    radius_km), box and distance as in a search. Centres that a search would not take give none.

    A circle is covered by cells at a level by its radius, a few each but near the poles;
    media meet them by their cell at each level that there is, at most LEVELS, so neither
    side is sent whole to every task and no pair outside of neighbouring cells is made.
    """
    lat, lng, radius = F.col("lat"), F.col("lng"), F.col("radius_km")
    ok = lat.between(-90, 90) & lng.between(-180, 180) & (radius > 0) & (radius < float("inf"))
    south, north, west, east = geo.box_of(lat, lng, radius)
    level = F.greatest(F.lit(0), F.least(F.lit(geo.LEVELS), F.floor(F.log2(180.0 / (radius / geo.KM_PER_DEGREE))))).cast("int")
    boxed = centres.where(ok).select("centre_id", "lat", "lng", "radius_km", south.alias("south"), north.alias("north"), west.alias("west"), east.alias("east"), level.alias("level"))
    steps = lambda c, span, low: geo.step(F.col(c), span, low, F.col("level"))
    cells = boxed.withColumn("y", F.explode(F.sequence(steps("south", 180, -90), steps("north", 180, -90))))
    cells = cells.withColumn("x", F.explode(F.sequence(steps("west", 360, -180), steps("east", 360, -180))))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # at most LEVELS + 1
    rows = media.where("latitude is not null and longitude is not null").select("id", "latitude", "longitude", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("level"))
    own = lambda c, span, low: geo.step(F.col(c), span, low, F.col("level"))
    rows = rows.withColumn("y", own("latitude", 180, -90)).withColumn("x", own("longitude", 360, -180))
    met = cells.join(rows, ["level", "y", "x"])
    inside = F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east"))
    km = geo.distance(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lng"))
    return met.where(inside).withColumn("km", km).where(F.col("km") <= F.col("radius_km")).select("centre_id", "id", "km")
