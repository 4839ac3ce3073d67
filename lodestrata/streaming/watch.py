"""Watching a folder: each version of a file is handed on once, after it was fully written.

The engine's file source lists a file once per path, so a watcher reads a folder of *arrivals*: rows (file_name,
content) that a writer puts there in whole files. State is the set of fingerprints seen within ``KEEP``, kept by the
stream's own checkpoint, so it doesn't grow for ever; what comes again after that, or in a batch that is replayed after a
failure, finds its fingerprint known to the registry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ids import pack_fingerprint
from lodestrata.functions.text import file_type

ARRIVALS = "file_name string, content binary"
KEEP = "7 days"


def arrivals(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    stream = spark.readStream.schema(ARRIVALS).format(fmt).load(folder)
    packed = pack_fingerprint(F.sha2("content", 256), F.length("content"))
    return stream.withColumn("file_type", file_type("file_name")).withColumn("fingerprint", packed)


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "parquet", once: bool = True, keep: str = KEEP):
    """Start a stream that calls ``handle(batch, number)`` with file versions not seen within ``keep``."""
    timed = arrivals(spark, folder, fmt).withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", keep)
    fresh = timed.dropDuplicatesWithinWatermark(["file_name", "fingerprint"])
    writer = fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
