"""Block streams into a Store: micro-batches of Structured Streaming, each committed as a whole.

Order is by height.  Late data is a reorganised chain: the batch's first block doesn't link to the store's tip, and the
store is rolled back to the node's chain before the batch counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coinstrata.sources.files import facts
from coinstrata.streaming.store import Store, Unrecoverable

#: Files of blocks that a batch takes.
FILES_PER_BATCH = 1


class Ingest:
    """The callback of foreachBatch."""

    def __init__(self, store: Store, canonical: Callable[[], DataFrame] | None = None, compact_every: int = 50, name: str = "blocks"):
        self.store, self.canonical, self.compact_every, self.name = store, canonical, compact_every, name
        self.reorgs = self.last_depth = 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            first = batch.agg(F.min_by(F.struct("height", "prev_hash"), "height").alias("f")).first()["f"]
            if first is None:
                return
            tip, tip_hash = self.store.tip()
            if tip >= 0 and self.canonical is not None and (first["height"] <= tip or bytes(first["prev_hash"]).hex() != tip_hash):
                self._reorganise()
            outs, ins, meta = facts(batch)
            self.store.commit(f"{self.name}-{batch_id}", outs, ins, meta)
            if batch_id and batch_id % self.compact_every == 0:
                self.store.compact()
        finally:
            batch.unpersist()

    def _reorganise(self) -> None:
        try:
            depth = self.store.follow(self.canonical())
        except Unrecoverable as e:
            self.store.halt(str(e))
            raise
        if depth:
            self.reorgs, self.last_depth = self.reorgs + 1, depth


def run(spark: SparkSession, source: str, schema, ingest: Ingest, checkpoint: str, once: bool = True, seconds: int = 1) -> StreamingQuery:
    """Streams decoded blocks (Parquet files in order of time) of a folder into the store."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(source)
    writer = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def admitted(heights: DataFrame, tip: int, most: int = 200) -> DataFrame:
    """The next blocks after the tip that a batch takes."""
    return heights.filter((F.col("height") > tip) & (F.col("height") <= tip + most))
