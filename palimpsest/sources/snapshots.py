"""Batches of several tables that appear together or not at all.

Each table of a batch is written to a folder of its own attempt: ``root/table/batch=B/attempt=A``. A batch is published by one small file, written last and
moved into place, which names the attempt; readers take only rows of published attempts, by a semi-join on the partition columns, so Spark
prunes the folders of all others. A driver that dies between two tables leaves nothing to be seen; a batch that is published already isn't written again,
whoever tries, and of two attempts at once the first to publish counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "_published"


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, root: str) -> DataFrame:
    """(batch, attempt, tables) of what is published."""
    path, fs = _path(spark, root, PUBLISHED)
    schema = "batch string, attempt string, tables array<string>"
    return spark.read.schema(schema).json(f"{root}/{PUBLISHED}") if fs.exists(path) else spark.createDataFrame([], schema)


def publish(root: str, batch: str, tables: dict[str, DataFrame]) -> bool:
    """Writes the tables and publishes them as one; False, with nothing to be seen of it, if the batch is there already. Names of batches
    are letters, digits, ``-`` and ``_``."""
    if not tables or not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a batch: {batch!r} of {sorted(tables)}")
    spark = next(iter(tables.values())).sparkSession
    final, fs = _path(spark, root, PUBLISHED, f"{batch}.json")
    if fs.exists(final):
        return False
    attempt = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}/batch={batch}/attempt={attempt}")
    made, _ = _path(spark, root, f".{batch}-{attempt}.json")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt, "tables": sorted(tables)}).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        return False
    return True


def published(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """The rows of a table in all published batches, with ``batch``."""
    path, fs = _path(spark, root, table)
    full = f"{schema}, batch string, attempt string"
    if not fs.exists(path):
        return spark.createDataFrame([], full).drop("attempt")
    known = batches(spark, root).where(F.array_position("tables", table) > 0).select("batch", "attempt")  # a comparison: only by such is a join seen as one that prunes
    rows = spark.read.schema(full).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    return rows.join(known, ["batch", "attempt"], "left_semi").drop("attempt")


def latest(spark: SparkSession, root: str) -> str | None:
    """The last batch by name."""
    return batches(spark, root).agg(F.max("batch")).first()[0]


def keep_newest(spark: SparkSession, root: str, most: int) -> list[str]:
    """Withdraws all published batches but the last ``most`` by name, then deletes their files; those withdrawn. Withdrawn first, so no reader
    sees half a batch."""
    old = [r.batch for r in batches(spark, root).orderBy(F.desc("batch")).offset(most).collect()]  # names alone: one a batch
    tables = {n for r in batches(spark, root).where(F.col("batch").isin(old)).select(F.explode("tables").alias("t")).distinct().collect() for n in [r.t]}
    for batch in old:
        path, fs = _path(spark, root, PUBLISHED, f"{batch}.json")
        fs.delete(path, False)
        for name in tables:
            path, fs = _path(spark, root, name, f"batch={batch}")
            fs.delete(path, True)
    return sorted(old)
