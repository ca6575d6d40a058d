"""Incremental indexing: new chunk files are picked up by Structured Streaming, and chunks already indexed are skipped by id."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

LOG = logging.getLogger("quarry")


class Progress(StreamingQueryListener):
    """Tells of each batch how many rows it read and how many there have been."""

    def __init__(self, tell: Callable[[int, int], None] = lambda rows, so_far: LOG.info("%d rows, %d so far", rows, so_far)):
        self.tell, self.so_far = tell, 0

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows:
            self.so_far += event.progress.numInputRows
            self.tell(event.progress.numInputRows, self.so_far)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def new_chunks(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    return chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def index_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], files_at_once: int = 1000) -> None:
    """Encode and append all chunks that have arrived at `source` since the last call; stops when none is left.

    A batch that fails midway is done again, and what it has already appended is skipped by id.
    """

    def block(df: DataFrame, number: int) -> None:
        try:
            df = new_chunks(df, spark.read.parquet(target))
        except Exception as e:  # the first block: nothing is indexed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        encode(df.dropDuplicates(["chunk_id"])).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(source)
    stream.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
