"""Files that are fully written: a stream of folder listings becomes a stream of files whose size has settled.

Each tick lists the folder and appends its rows. Per file the stream keeps its last size, for how many ticks it has been so,
and the size that was handed on last; a file goes on when its size has held for ``ticks`` listings, and again when it has
changed since and settled anew. A tick is the time of its listing, in whole seconds. What the stream keeps of a file that is
listed no more goes by a timer, once later listings are ``forget_s`` past its last one. Listings that come twice, as after a
restart, change nothing: a tick not later than the last one seen is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrata.sources.files import FolderFiles, folder_files

LISTINGS = "tick bigint, file_name string, bytes bigint"
_STATE, _OUT = "tick bigint, bytes bigint, held bigint, handed bigint", "file_name string, bytes bigint, tick bigint"


def append_listing(spark: SparkSession, folder: str, listings: str, tick: int, source: type[FolderFiles] = FolderFiles) -> None:
    """Add the listing of one tick; ticks have to grow."""
    rows = folder_files(spark, folder, source=source).where("listed_bytes is not null")
    rows.select(F.lit(tick).cast("long").alias("tick"), "file_name", F.col("listed_bytes").alias("bytes")).write.mode("append").parquet(listings)


def settled(listings: DataFrame, ticks: int = 2, forget_s: float = 7 * 86400.0) -> DataFrame:
    """A stream of ``LISTINGS`` -> file_name, bytes, tick (of the listing that settled it)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tick, size, held, handed = state.get if state.exists else (-1, -1, 0, -1)
        rows = pd.concat(list(batches)).sort_values("tick")  # one file's listings of a batch
        out = []
        for t, n in zip(rows["tick"].tolist(), rows["bytes"].tolist(), strict=True):
            if t <= tick:
                continue
            tick, held, size = t, held + 1 if n == size else 1, n
            if held >= ticks and handed != size:
                handed = size
                out.append((key[0], size, tick))
        state.update((tick, size, held, handed))
        state.setTimeoutTimestamp(int((tick + forget_s) * 1000))
        if out:
            yield pd.DataFrame(out, columns=["file_name", "bytes", "tick"])

    timed = listings.select("tick", "file_name", "bytes", F.timestamp_seconds("tick").alias("at")).withWatermark("at", "0 seconds")
    return timed.groupBy("file_name").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def watch(spark: SparkSession, listings: str, out: str, checkpoint: str, ticks: int = 2, forget_s: float = 7 * 86400.0, once: bool = True):
    """Start a stream from the folder of listings to a table of settled files."""
    stream = spark.readStream.schema(LISTINGS).parquet(listings)
    writer = settled(stream, ticks, forget_s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
