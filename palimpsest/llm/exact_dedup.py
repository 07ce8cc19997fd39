"""Exact deduplication by deterministic block naming, in DataFrame functions alone.

A normalised text is cut into blocks of a fixed number of characters. Equal blocks get one integer
name: blocks are dealt into buckets and sorted there, and a block's name is its bucket and its rank
among the bucket's distinct blocks. Then adjacent names are paired, and equal pairs are named in the
same way, until a document has one name. Documents of as many blocks and one name are equal, and
only those: a name stands for a text, not for a digest of it, so there are no collisions.

At scale: whole texts cross the network once, for the first naming; after that only integers do.
A frequent block or pair is named through a broadcast of at most HOT_KEYS of them, so no task gets
all its rows. Nothing depends on how rows were dealt to tasks, so a lost task gives the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import base

#: Characters that don't count: space, and tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: Buckets that blocks are dealt to, whatever the input's size; a name is bucket * 2**32 + rank.
BUCKETS = 1 << 24
#: Stands for the missing second half of the last pair.
NONE = -(1 << 62)


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANK:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (with a unique ``rid``) and, instead of ``keys``, the integer ``name`` of their values."""
    h = F.xxhash64(*keys)
    if hot := base.hot_hashes(rows, h):
        found = rows.where(h.isin(hot)).select(*keys).distinct()
        named = found.select(*keys, (-F.row_number().over(Window.orderBy(*keys))).cast("long").alias("hot"))
        rows = rows.join(F.broadcast(named), keys, "left")
    else:
        rows = rows.withColumn("hot", F.lit(None).cast("long"))
    cold = F.col("hot").isNull()
    rows = rows.withColumn("bucket", F.pmod(F.when(cold, h).otherwise(F.xxhash64("rid", "pos")), F.lit(BUCKETS)))
    rows = rows.withColumns({k: F.when(cold, F.col(k)) for k in keys})
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*keys))
    name = F.coalesce("hot", F.col("bucket") * F.lit(1 << 32) + rank)
    return rows.withColumn("name", name).drop(*keys, "hot", "bucket")


def dedup(docs: DataFrame, block: int = 4096) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, mark (base.by_id of the text).

    Texts are equal when they are identical without BLANK. Of equal ones the row with the most code
    points stays, then the smallest doc_id (null last); of rows alike in that too, any one. A null
    text counts as empty, and all empty texts are one group. An empty table gives an empty result.
    """
    norm = normalised(F.col("text"))
    parts = F.when(F.length("norm") <= block, F.array("norm")).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    rows = (
        docs.select("doc_id", base.by_id().alias("mark"), F.coalesce(F.length("text"), F.lit(0)).alias("n_code"), norm.alias("norm"), F.monotonically_increasing_id().alias("rid"))
        .select("doc_id", "mark", "n_code", "rid", F.sha2("norm", 256).alias("text_sha256"), parts.alias("parts"))
        .select("*", F.size("parts").alias("n_blocks"))
        .select("rid", "n_blocks", "n_code", "doc_id", "mark", "text_sha256", F.posexplode("parts").alias("pos", "block"))
        .withColumns({c: F.when(F.col("pos") == 0, F.col(c)) for c in ("doc_id", "mark", "text_sha256", "n_code")})
    )
    first = base.save(_named(rows, ["block"]), "blocks")
    heads = first.where("pos = 0")
    left = first.where("n_blocks > 1").select("rid", "n_blocks", F.col("n_blocks").alias("n"), "pos", "name")
    most = left.agg(F.max("n")).first()[0] or 1
    done: list[DataFrame] = []
    while most > 1:
        half = (F.col("pos") / 2).cast("int")
        pairs = left.groupBy("rid", "n_blocks", ((F.col("n") + 1) / 2).cast("int").alias("n"), half.alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NONE)).alias("b")
        )
        named = base.save(_named(pairs.withColumnRenamed("half", "pos"), ["a", "b"]), "pairs")
        done.append(named.where("n = 1").select("rid", F.col("name").alias("whole")))
        left, most = named.where("n > 1"), (most + 1) // 2
    if done:
        names = done[0]
        for more in done[1:]:
            names = names.union(more)
        long = heads.where("n_blocks > 1").join(names, "rid").withColumn("name", F.col("whole")).drop("whole")
        heads = base.save(heads.where("n_blocks = 1").unionByName(long), "named")
    best = F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("no"), "doc_id", "rid")
    groups = heads.groupBy("n_blocks", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best"))
    out = base.attach(heads, groups, ["n_blocks", "name"], "group_size")
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "mark"
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with."""
    return base.without(docs, dedup(docs))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(base.table(spark, sf_dir, "documents")).drop("mark")


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLE = {"op9_exact_dedup": OP9_SQL}
