"""Streams: ordered messages, envelopes, offset-aligned windows, an exactly-once sink."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from strata.functions.storage import stored
from strata.sources.raw import exists


def to_messages(lines: DataFrame, file: str, line: str, raw: str, sha: str, run: str) -> DataFrame:
    """Lines of files as messages: the key is the file, so that a file stays in one partition; headers carry the rest.
    Blank lines are no messages."""
    headers = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in (("file", F.col(file)), ("line", F.col(line)), ("file_sha", F.col(sha)), ("run", F.lit(run)))])
    return lines.where(F.trim(raw) != "").select(F.col(file).alias("key"), F.col(raw).alias("value"), headers.alias("headers"))


def header(name: str) -> Column:
    """A header's value, NULL if it is missing."""
    return F.get(F.transform(F.filter("headers", lambda h: h["key"] == name), lambda h: h["value"]), 0)


def envelope(messages: DataFrame, ingest: str) -> DataFrame:
    """The eight fields of a message as they are stored. messages: key, value, headers, offset, timestamp."""
    return messages.select("offset", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("kafka_ts"), "key", header("file").alias("file"), header("line").try_cast("long").alias("line"), header("file_sha").alias("file_sha"), F.col("value").alias("raw"), F.lit(ingest).alias("ingest_ts"))


def offset_windows(df: DataFrame, size: int, ends: DataFrame | None = None) -> DataFrame:
    """topic, partition, window, first, last, n, ready: windows of `size` offsets. One is ready if its last offset is
    there, a later window exists, or the log's end (ends: topic, partition, end) is reached."""
    windows = df.groupBy("topic", "partition", F.floor(F.col("offset") / size).cast("long").alias("window")).agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("*").alias("n"))
    latest = F.max("window").over(Window.partitionBy("topic", "partition"))
    ready = (F.col("last") == (F.col("window") + 1) * size - 1) | (F.col("window") < latest)
    if ends is not None:
        windows = windows.join(ends, ["topic", "partition"], "left")
        ready = ready | F.coalesce(F.col("last") >= F.col("end") - 1, F.lit(False))
    return windows.select("topic", "partition", "window", "first", "last", "n", ready.alias("ready"))


def object_name(topic: Column, partition: Column, first: Column, last: Column) -> Column:
    return F.format_string("topic=%s/partition=%d/offsets=%012d-%012d.jsonl", topic, partition, first, last)


def merge_windows(batch: DataFrame, folder: str, size: int, span_rows: int = 1_000_000) -> None:
    """Append a micro-batch's rows that folder doesn't have yet, each offset once, with the number of their window. The
    same batch again adds nothing, and a batch of which a part was written before adds the rest. A directory holds a span
    of whole windows, about span_rows offsets of a partition, so that files grow with the rows and not with the windows;
    of what is stored, only offsets within the batch's range are read."""
    spark = batch.sparkSession
    key, directory = ["topic", "partition", "offset"], ["topic", "partition", "span"]
    window = F.floor(F.col("offset") / size).cast("long")
    new = batch.withColumn("window", window).withColumn("span", F.floor(window / max(1, span_rows // size)).cast("long"))
    once = new.dropDuplicates(key)
    if exists(spark, folder):
        ends = new.agg(*[f(c).alias(f"{n}_{c}") for c in ("span", "offset") for n, f in (("first", F.min), ("last", F.max))]).first()
        if ends.first_offset is None:
            return
        old = spark.read.schema(new.schema).parquet(folder).where(F.col("span").between(ends.first_span, ends.last_span) & F.col("offset").between(ends.first_offset, ends.last_offset))
        once = once.join(old.select(*key), key, "left_anti").select(*new.columns)
    once.repartition(*directory).write.mode("append").partitionBy(*directory).parquet(folder)


def bronze_stream(source: DataFrame, folder: str, checkpoint: str, size: int):
    """Run until the source is drained: micro-batches go to their windows, progress to the checkpoint."""
    return source.writeStream.foreachBatch(lambda df, _: merge_windows(df, folder, size)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(query) -> list[dict]:
    """Wait for the end; the progress of all batches."""
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.asDict() if hasattr(p, "asDict") else dict(p) for p in query.recentProgress]


class Progress(StreamingQueryListener):
    """Rows and time of the last batch with rows, of one query."""

    def __init__(self):
        self.rows, self.last, self.query = 0, time.monotonic(), None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if self.query is not None and str(event.progress.id) == self.query and event.progress.numInputRows > 0:
            self.rows, self.last = self.rows + event.progress.numInputRows, time.monotonic()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def until_drained(query: StreamingQuery, lag: Callable[[int], int], idle_seconds: float = 5.0, most_seconds: float = 600.0) -> tuple[str, int]:
    """Let a continuous query run until it has had no rows for idle_seconds and the lag is 0, or most_seconds have gone by;
    it is stopped either way, and what it didn't finish comes again next time. lag is asked when the query is idle; it is
    given the rows of all batches that this run has committed, and says how many messages are due. Returns why the run
    ended (`drained` or `out of time`) and those rows. An error of the query is raised."""
    spark, progress, began = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active(), Progress(), time.monotonic()
    progress.query = str(query.id)
    spark.streams.addListener(progress)
    why = "out of time"
    try:
        while time.monotonic() - began < most_seconds:
            if query.awaitTermination(0.2):
                break
            if time.monotonic() - progress.last >= idle_seconds:
                if lag(progress.rows) <= 0:
                    why = "drained"
                    break
                progress.last = time.monotonic()  # rows are due: wait another span
    finally:
        query.stop()
        spark.streams.removeListener(progress)
    if query.exception():
        raise query.exception()
    return why, progress.rows


def running_stream(source: DataFrame, folder: str, checkpoint: str, size: int, every: str = "200 milliseconds") -> StreamingQuery:
    """bronze_stream that goes on: a micro-batch whenever there is something. A batch is read once, so that its rows count
    once in the progress."""
    return source.writeStream.foreachBatch(lambda df, _: merge_windows(stored(df, "batch"), folder, size)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def first_deliveries(df: DataFrame) -> DataFrame:
    """One row per (file, file sha, line): the delivery of the smallest offset."""
    w = Window.partitionBy("file", "file_sha", "line").orderBy("offset")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
