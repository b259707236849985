"""Incremental runs as Structured Streaming: file ingest by micro-batch, and progress."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from mediashoal.operators.incremental import scan_diff, upsert_media


def progress_counts(events: DataFrame) -> DataFrame:
    """Progress rows by type, of a table."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.max("event_id").alias("last_id"))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What Spark calls the stream that a checkpoint belongs to, from its first start on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/metadata")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())["id"]
    finally:
        stream.close()


class ProgressState:
    """A row for each event type and user in a folder, kept up by batches of a stream.

    Spark's state store holds the counts; a batch writes only the rows that it changed, as
    one segment under its number, so a batch that is run again after a failure replaces its
    own. The newest row of a key counts. Every ``EVERY`` batches what is there is folded
    into one segment, which is written whole before the pointer to it, and before old ones go.
    """

    EVERY = 16
    SCHEMA = "event_type string, user_id {user}, n bigint, last_id {event}"

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = self.SCHEMA.format(user=schema["user_id"].dataType.simpleString(), event=schema["event_id"].dataType.simpleString())

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _segments(self) -> list[tuple[str, int]]:
        """Names and batches: the newest fold, and the changes after it."""
        fs, path = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = [n for n in names if self._fs(f"{n}/_SUCCESS")[0].exists(self._fs(f"{n}/_SUCCESS")[1])]
        folds = [int(n[5:]) for n in done if n.startswith("fold-")]
        last = max(folds, default=-1)
        return [(f"fold-{last}", last)] * bool(folds) + sorted((n, int(n[7:])) for n in done if n.startswith("change-") and int(n[7:]) > last)

    def table(self) -> DataFrame:
        """``(event_type, user_id, n, last_id)`` as of the last batch."""
        rows = self.spark.createDataFrame([], f"{self.schema}, batch bigint")
        for name, batch in self._segments():
            rows = rows.unionAll(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}").withColumn("batch", F.lit(batch).cast("bigint")))
        return rows.groupBy("event_type", "user_id").agg(F.max_by("n", "batch").alias("n"), F.max_by("last_id", "batch").alias("last_id"))

    def keep(self, changed: DataFrame, batch: int) -> None:
        changed.select("event_type", "user_id", "n", "last_id").write.mode("overwrite").parquet(f"{self.folder}/change-{batch}")
        if batch % self.EVERY == self.EVERY - 1:
            old = [n for n, _ in self._segments()]
            self.table().write.mode("overwrite").parquet(f"{self.folder}/fold-{batch}")
            for name in old:
                fs, path = self._fs(name)
                fs.delete(path, True)

    def counts(self) -> DataFrame:
        return self.table().groupBy("event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"), F.max("last_id").alias("last_id"))


def stream_progress(spark: SparkSession, source: str, schema: StructType, checkpoint: str, files_a_batch: int | None = None) -> DataFrame:
    """``progress_counts`` of a stream of event files after all that there are now.

    What was counted before lies beside the checkpoint, so a run that finds nothing new
    gives the same rows as the one before, after a restart too. Events count whenever
    they come: there is no watermark, and the state grows with types and users only.
    """
    state = ProgressState(spark, f"{checkpoint.rstrip('/')}-table", schema)
    reader = spark.readStream.schema(schema)
    events = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(source)
    users = events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    users.writeStream.outputMode("update").foreachBatch(state.keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state.counts()


def ingest_listings(catalog, source: str, schema: StructType, checkpoint: str, on_batch: Callable[[int, DataFrame], None] | None = None) -> StreamingQuery:
    """Upserts each new file of listings under ``source`` into ``catalog`` and ends when
    there is none left. A batch that is run again after a failure is known by its stream
    and number, which the catalog keeps with the snapshot, and changes nothing; batches of
    other streams into the same catalog are told apart.
    """
    spark: SparkSession = catalog.spark

    def apply(batch: DataFrame, number: int) -> None:
        stream = _stream_id(spark, checkpoint)
        if catalog.last_batch(stream) >= number:
            return
        newest = batch.groupBy("path").agg(*[F.max_by(c, "imported_at").alias(c) for c in batch.columns if c != "path"])
        media = catalog.read("media_items")
        diff = scan_diff(newest, media)
        catalog.commit("media_items", upsert_media(media, diff.where("action <> 'unchanged'")), batch=(stream, number))
        if on_batch:
            on_batch(number, diff.groupBy("action").count())

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class ProgressTable(StreamingQueryListener):
    """Progress of all queries as rows, at most one every ``every`` batches."""

    def __init__(self, every: int = 1):
        self.every, self.rows = every, []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.rows.append((str(event.id), "started", -1, 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.batchId % self.every == 0:
            self.rows.append((str(p.id), "progress", p.batchId, p.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.rows.append((str(event.id), "ended" if event.exception is None else "failed", -1, 0))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "query string, event string, batch bigint, rows bigint")
