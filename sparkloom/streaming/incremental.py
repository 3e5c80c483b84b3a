"""Incremental refresh as a stream: whole snapshots a batch, or state kept by URL (the batch form is operators.selection.changed)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from sparkloom.operators.selection import changed, next_state


def refresh_batch(pages: DataFrame, state_path: str, out_path: str, epoch: int, fetched: str = "") -> None:
    """One micro-batch: changed pages to out_path/epoch, a new snapshot of the state. A replayed epoch writes the same again."""
    spark = pages.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{state_path}/{epoch - 1}")
    if epoch and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        state = spark.read.parquet(f"{state_path}/{epoch - 1}")
    else:
        state = spark.createDataFrame([], "url string, etag string, last_modified string, content_sha1 string, last_fetch string")
    changed(pages, state).write.mode("overwrite").parquet(f"{out_path}/{epoch}")
    next_state(pages, state, fetched or str(epoch)).write.mode("overwrite").parquet(f"{state_path}/{epoch}")


def refresh_stream(pages: DataFrame, state_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Changed pages of a stream of pages (url, html), available data then stop."""
    return pages.writeStream.foreachBatch(lambda df, epoch: refresh_batch(df, state_path, out_path, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; on a stream, later rows than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


#: The state store that keyed state needs; a session sets it before its first stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGED = "url string, html string, content_sha1 string, previous_sha1 string"


class KnownPages(StatefulProcessor):
    """Holds each URL's content hash and passes on the pages whose hash differs from it."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "content_sha1 string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for part in rows:  # of several fetches of a URL in one batch the last counts
            best = part.loc[part["ordinal"].idxmax()]
            last = best if last is None or best["ordinal"] > last["ordinal"] else last
        before = self.known.get()[0] if self.known.exists() else None
        if last is not None and last["content_sha1"] != before:
            self.known.update((last["content_sha1"],))
            yield pd.DataFrame({"url": [key[0]], "html": [last["html"]], "content_sha1": [last["content_sha1"]], "previous_sha1": [before]})

    def close(self) -> None:
        pass


def refresh_keyed(pages: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Changed pages of a stream of pages (url, html, ordinal) as Parquet, from state kept by URL; available data, then stop.

    A batch reads and writes the state of its own URLs only, so its work grows with the batch, not with all pages known. State and files are
    committed with the checkpoint: a replayed batch gives the same rows once. Null URLs are left out; a null page counts as "".
    """
    pages.sparkSession.conf.set(*STATE_STORE)
    rows = pages.filter("url is not null").select("url", F.coalesce("html", F.lit("")).alias("html"), F.col("ordinal").cast("long").alias("ordinal"))
    rows = rows.withColumn("content_sha1", F.sha1("html"))
    out = rows.groupBy("url").transformWithStateInPandas(statefulProcessor=KnownPages(), outputStructType=CHANGED, outputMode="Append", timeMode="None")
    return out.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
