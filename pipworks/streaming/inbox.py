"""The inbox as a stream: new files are read once, and matches that are stored already are not stored again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pipworks.operators.transcripts import summaries
from pipworks.storage import exists

_FILE = "path string, modificationTime timestamp, length long, content binary"


def store_new(spark: SparkSession, found: DataFrame, store: str, batch: int) -> None:
    """Appends the matches of `found` whose content the store does not have, each once. Repeating a batch adds nothing: it overwrites its own folder."""
    good = found.filter("content_hash is not null")
    once = good.groupBy("content_hash").agg(F.min_by(F.struct("path", "p0", "p1", "match_length", "date", "event", "s0", "s1"), "path").alias("m")).select("content_hash", "m.*")
    if exists(spark, store):
        held = spark.read.parquet(store).filter(F.col("batch") < batch).select("content_hash")
        once = once.join(held, "content_hash", "left_anti")
    once.write.mode("overwrite").parquet(f"{store}/batch={batch}")


def ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> StreamingQuery:
    """Processes what is in the inbox and stops; what was processed is remembered in `checkpoint`."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").load(inbox)
    run = lambda df, batch: store_new(spark, summaries(df), store, batch)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
