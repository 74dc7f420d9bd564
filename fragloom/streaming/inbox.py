"""An inbox of XML files: each micro-batch parses the new files and replaces them in the store, exactly once. [2.13]

A batch and its number are committed together, in the record of the version, so a batch that is replayed after the writer stopped between
its commit and the checkpoint is recognised and left out; and a batch that stopped before its commit has left nothing that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fragloom import log
from fragloom.functions import text as tx
from fragloom.plans import runs
from fragloom.sources.store import FragmentStore

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, inbox: str, max_files: int = 1000) -> DataFrame:
    """The XML files of a folder as a stream of (cst_file, content)."""
    arrived = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", max_files).load(inbox)
    return arrived.select(F.element_at(F.split("path", "/"), -1).alias("cst_file"), tx.decoded(F.col("content")).alias("content"))


def absorb(store: FragmentStore, files: DataFrame, stream: str, number: int, mapping: DataFrame | None = None) -> bool:
    """A batch of files, parsed into the store with their corrections kept, unless the store has this batch of the stream already. Of
    several texts of one file in a batch the largest counts."""
    if store.applied(stream) >= number:
        log.info("batch %d of %s is there already", number, stream)
        return False
    files = files.groupBy("cst_file").agg(F.max("content").alias("content"))
    runs.reparse(store, files, mapping, batch=(stream, number))
    return True


def watch(files: DataFrame, store: FragmentStore, checkpoint: str, mapping: DataFrame | None = None, available_now: bool = True) -> StreamingQuery:
    """files: a stream of (cst_file, content), as arrivals() has. The stream is known by the id in its checkpoint."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            absorb(store, rows, rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number, mapping)

    writer = files.select("cst_file", "content").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
