"""Change capture as a stream (an addition to the batch log): versions counted by object across micro-batches.

Beside the log at ``path`` lies ``path``-tops: the last version and seq of objects, a folder for each micro-batch with
the objects that it touched, and every COMPACT batches one with all objects. A batch so reads three columns of at most
COMPACT folders, never the log, whatever the log's length; and each folder depends on earlier ones alone, so a replayed
batch writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import history

COMPACT = 20


def write_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Appends micro-batch number ``epoch`` (from 0 on, none left out) to the log; what an earlier try of it wrote is replaced.

    An object's first batch in an empty log keeps its seq; else versions and seq count on. Rows without obj_id count
    as new objects' rows each batch, since null meets nothing. An empty batch writes an empty folder."""
    spark, tops, rows = batch.sparkSession, None, None
    if epoch:
        kept = spark.read.parquet(f"{path}-tops").where(F.col("batch").between((epoch - 1) // COMPACT * COMPACT, epoch - 1))
        tops = kept.groupBy("obj_id").agg(F.max("top").alias("top"), F.max("top_seq").alias("top_seq"))
        rows = history.counted_on(tops.join(batch.select("obj_id").distinct(), "obj_id", "left_semi"), batch)
    else:
        rows = history.numbered(batch)
    rows.write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    new = spark.read.schema(rows.schema).parquet(f"{path}/batch={epoch}").groupBy("obj_id").agg(F.max("version").alias("top"), F.max("seq").alias("top_seq"))
    if tops is not None and epoch % COMPACT == 0:
        new = tops.unionByName(new).groupBy("obj_id").agg(F.max("top").alias("top"), F.max("top_seq").alias("top_seq"))
    new.write.mode("overwrite").parquet(f"{path}-tops/batch={epoch}")


def capture(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch of changes to the log at ``path``, one folder for each batch."""
    write = stream.writeStream.foreachBatch(lambda batch, epoch: write_batch(batch, epoch, path))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
