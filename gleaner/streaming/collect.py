"""O-42 ``collect_stream``: pages arriving over time are collected once each.

Structured Streaming: a file source of page snapshots (explicit schema) →
``foreachBatch`` running the batch ``collect_content`` on each micro-batch.

* Each URL once: with an event time by ``dropDuplicatesWithinWatermark``, whose state
  the watermark bounds; without one, ``transformWithState`` remembers the hash of every URL
  that came (on RocksDB) and passes the first page of a URL on, the least of its
  micro-batch. A batch so costs what arrives, whatever the sink holds. The hashes are
  kept, without a time to live.
* The checkpoint belongs to the sink: a second call on the same sink goes on where the
  first ended. Another checkpoint on it begins with the URLs that the sink then holds as
  its state. Every epoch of every checkpoint has a folder of its own, written with
  ``overwrite``, so a replayed micro-batch replaces itself and nothing else.

``Trigger.AvailableNow`` drains what is there and stops; a processing-time trigger keeps
it running.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.content import collect_content
from ..session import checkpoint_dir, ensure_shipped
from ..sources.pages import read_pages_from

PAGES_SCHEMA = "page_id bigint, url string, html string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first_of_url() -> StatefulProcessor:
    """The processor of ``first_of_each``. Spark's streaming runner on the driver loads it without
    the shipped package, so its class is defined here and travels whole."""

    class FirstOfUrl(StatefulProcessor):
        """Passes a URL's first page on, of several in a micro-batch the least ``(page_id, html)``, nulls first."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "seen boolean")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            if self.seen.exists():
                return
            least = min(rows, key=lambda r: (r.page_id is not None, r.page_id or 0, r.html is not None, r.html or ""))
            self.seen.update((True,))
            yield Row(**{c: v for c, v in least.asDict().items() if c != "key"})

        def handleInitialState(self, key, initialState: Row, timerValues) -> None:
            self.seen.update((True,))

        def close(self) -> None:
            pass

    return FirstOfUrl()


def _key(url: str = "url") -> Column:
    """URLs by hash; rows without one are the one URL null."""
    return F.sha2(F.coalesce(F.concat(F.lit("u"), url), F.lit("")), 256).alias("key")


def first_of_each(pages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The first page of every URL of a stream that is not among ``held`` (read once, at the stream's start)."""
    ensure_shipped(pages.sparkSession)
    initial = held.select(_key()).distinct().groupBy("key") if held is not None else None
    return pages.select(_key(), "*").groupBy("key").transformWithState(
        _first_of_url(), pages.schema, "Append", "None", initialState=initial
    )


def page_stream(spark: SparkSession, source_dir: str, glob: str = "*.parquet", schema: str = PAGES_SCHEMA,
                event_time: str | None = None, watermark: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """Streaming pages of the files in ``source_dir`` whose own names match ``glob``, at any depth;
    ``source_dir`` may be a table, a file or a folder of part files. With an event time each URL
    once within the watermark."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    pages = reader.parquet(_as_folder(spark, source_dir))
    if event_time:
        return pages.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["url"])
    return pages


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _as_folder(spark: SparkSession, path: str) -> str:
    """A path to stream from: Spark takes a plain one for a folder, so a file goes as a pattern of its name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{p.getParent()}/{{{p.getName()}}}" if fs.exists(p) and fs.getFileStatus(p).isFile() else path


def _committed(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream with this checkpoint has ended a micro-batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def collect_stream(
    spark: SparkSession,
    source_dir: str,
    selectors,
    sink_path: str | None = None,
    checkpoint_location: str | None = None,
    glob: str = "*.parquet",
    available_now: bool = True,
    processing_time: str | None = None,
    schema: str = PAGES_SCHEMA,
    event_time: str | None = None,
    watermark: str = "1 hour",
    max_files: int | None = None,
    **content_options,
) -> tuple[StreamingQuery, str]:
    """Start the stream; returns the query and the sink folder (parquet, a folder per checkpoint and epoch).

    With ``event_time`` (a timestamp column in ``schema``) duplicates are dropped within
    the watermark, so the de-duplication state stays bounded; without one
    a URL is taken once."""
    base = checkpoint_dir(spark).rstrip("/") + f"/gleaner-stream-{uuid.uuid4().hex[:12]}"
    sink = sink_path or f"{base}/sink"
    ckpt = checkpoint_location or f"{sink}/_checkpoint"
    stream = hashlib.sha256(ckpt.encode()).hexdigest()[:32]
    pages = page_stream(spark, source_dir, glob, schema, event_time, watermark, max_files)

    if not event_time:
        held = None
        if not _committed(spark, ckpt) and path_exists(spark, sink):
            held = spark.read.schema("url string, stream string, epoch long").option("basePath", sink).parquet(sink)
            held = held.where(F.col("stream") != stream)  # a first batch that broke off is replayed
        pages = first_of_each(pages, held)

    def per_batch(df: DataFrame, epoch_id: int) -> None:
        own = f"{sink}/stream={stream}/epoch={epoch_id}"
        rec = collect_content(read_pages_from(df), selectors, **content_options)
        rec.write.mode("overwrite").parquet(own)

    w = pages.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return w.start(), sink  # the query keeps the settings it started with
    finally:
        spark.conf.set(STATE_STORE, before)
