"""What the training-data operators share: inputs, written intermediates and hot keys.

Every operator takes ``documents``-like frames (``doc_id``, ``text`` and any further columns;
columns that an operator doesn't name are ignored, whatever they are called) and gives
``doc_id`` back as it came, nulls and repeats included.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: So many keys at most are treated as hot, so each other key has under a 256th of all rows.
HOT_KEYS = 256
#: Keys with fewer rows than this fit in any task and are never hot.
HOT_ROWS = 2000

#: Rows of two longs that are broadcast at most.
BROADCAST_ROWS = 500_000


#: Rows of an Arrow batch, where the session doesn't say; with Spark's own 10,000 whole texts take tens of MB in JVM and worker each.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. Where the session sets no size of Arrow batches, BATCH_ROWS is set."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where Spark runs in one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_type(df: DataFrame) -> str:
    """The type of doc_id, which the operators carry as it is."""
    return df.schema["doc_id"].dataType.simpleString()


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives its memory back to the system at the end of a task: workers outlive their tasks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        yield from f(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return run


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # no glibc
        return None


def slices(batch, column: int, most: int = 1 << 20) -> Iterator:
    """Parts of an Arrow batch whose texts take about ``most`` bytes, or one row that takes more."""
    import pyarrow.compute as pc

    sizes, at, total = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def drop(*frames: DataFrame) -> None:
    """Deletes what save() wrote, once nothing reads it any more."""
    for df in frames:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def hot_hashes(rows: DataFrame, key: Column) -> list[int]:
    """The at most HOT_KEYS most frequent values of a 64-bit key; a bounded list, however large the input."""
    counts = rows.groupBy(key.alias("h")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "h").limit(HOT_KEYS)
    return [r.h for r in top.collect()]


def attach(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Left-joins one row of ``groups`` for each key to ``rows``. The largest groups, HOT_KEYS rows at most, are
    broadcast, so no task gets all rows of a hot key; the rest meet in a shuffle."""
    on = list(keys)
    hot = F.broadcast(groups.where(F.col(size) >= HOT_ROWS).orderBy(F.desc(size), *on).limit(HOT_KEYS))
    return rows.join(hot, on, "inner").unionByName(rows.join(hot.select(*on), on, "left_anti").join(groups, on, "left"))


def by_id(text: str = "text"):
    """With doc_id, what tells one row of a table of documents from another; rows alike in both are copies."""
    return F.xxhash64(F.col(text))


def without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay. ``decided`` has a row for each of them: doc_id, mark (by_id of its text), kept.
    Of rows alike in doc_id and text of which one stays, one does. The rows to drop are broadcast up to BROADCAST_ROWS;
    beyond that both sides meet in a shuffle."""
    key = ["doc_id", "mark"]
    keys = save(decided.groupBy(*key).agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n")).where("stay < n"), "decided")
    few = keys.count() <= BROADCAST_ROWS
    named = keys.select(F.col("doc_id").alias("k_doc_id"), F.col("mark").alias("k_mark"), "stay")
    met = lambda side: docs["doc_id"].eqNullSafe(side["k_doc_id"]) & (by_id() == side["k_mark"])
    side = F.broadcast(named) if few else named
    rest = docs.join(side, met(named), "left_anti")
    if not keys.where("stay > 0").head(1):
        return rest
    twice = named.where("stay > 0")
    again = docs.join(F.broadcast(twice) if few else twice, met(twice), "left_semi")
    mark = max(docs.columns, key=len) + "_"  # a name that no column has
    return rest.unionByName(again.withColumn(mark, by_id()).dropDuplicates(["doc_id", mark]).select(*docs.columns))


def runs(batches: Iterator, column: int = 0) -> Iterator:
    """Of rows sorted by a column, each run of one value as an Arrow table, across batches. A run is held whole, so its size must be bounded."""
    import numpy as np
    import pyarrow as pa

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        key = t.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield t.slice(lo, hi - lo)
        held = t.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of an undirected graph of longs (a, b), root being the least node of its component.

    Alternates the large-star and small-star steps until nothing changes; after each, what is left is written, so
    lineage stays short. A node with many edges gets its least neighbour through attach(), never in one task."""

    def least(e: DataFrame) -> DataFrame:
        near = e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
        return attach(e, near, ["u"], "d").withColumn("m", F.least("u", "m"))

    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def tally(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = tally(now)
    while True:
        large = save(least(both(now)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        down = least(large)
        small = down.select("u", F.col("m").alias("v")).union(down.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        new = save(small, "edges")
        seen, before = tally(new), seen
        same = seen == before and not new.join(now, ["u", "v"], "left_anti").head(1)
        drop(now, large)
        now = new
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
