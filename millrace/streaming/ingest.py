"""Incremental indexing of files that keep arriving, and event-time windows over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import text as t
from millrace.index import Index
from millrace.operators import chunking
from millrace.schema import FILES


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of files (schema FILES) as Parquet files of them arrive in a folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def index_stream(files: DataFrame, index: Index, checkpoint: str) -> StreamingQuery:
    """Indexes each micro-batch; a batch that is run again finds its chunks there and adds none."""

    def add(batch: DataFrame, _: int) -> None:
        taken = batch.filter(F.col("language").isNotNull() & ~t.is_blank(F.coalesce("content", F.lit(""))))
        index.add(chunking.chunk_files(taken))

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILE_EVENTS = f"{FILES}, event string"


def changed_files(files: DataFrame, silent: str = "1 day") -> DataFrame:
    """The files of a stream (schema FILES) whose mtime or size is not the last that was seen, as
    event ``changed``; those that no scan has brought for ``silent`` come as ``gone``, without
    content. What was seen is state by repository and path, which outlives restarts."""
    columns = files.sparkSession.createDataFrame([], FILE_EVENTS).columns
    millis = int(pd.Timedelta(silent).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            mtime, size = state.get
            state.remove()
            yield pd.DataFrame([(*key, mtime, size, None, None, "gone")], columns=columns)
            return
        last = pd.concat(list(frames)).sort_values("mtime", kind="stable").iloc[-1]
        now = float(last["mtime"]), int(last["size"])
        if not state.exists or tuple(state.get) != now:
            yield pd.DataFrame([[*(last[c] for c in columns[:-1]), "changed"]], columns=columns)
        state.update(now)
        state.setTimeoutDuration(millis)

    grouped = files.groupBy("repo_id", "path")
    return grouped.applyInPandasWithState(run, FILE_EVENTS, "mtime double, size bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(events: DataFrame, time: str, every: str, late: str, *keys: str) -> DataFrame:
    """Counts by window and keys of a stream; events later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts by session, which ends where a key is silent for ``gap``."""
    return events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
