"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

An item's words give a set of n five-word shingles (an item of fewer words: one shingle of them all).
Items are partitioned by n into bands that double in size. A band has one sketch size: as many
shingles as its largest item may miss, and one in SPARE of that size more. An item's MinHash sketch is
that many of its shingles with the least hashes, those that few items share before others. The share
of a sketch that a document holds estimates the containment; whatever the document's length, one
that holds the threshold's share of an item hits its sketch at least so many times as the sketch has
more shingles than the item may miss. So asking for these hits loses nothing. What has them is
verified by the exact share of the item's shingles, as texts, that the document holds.

At scale: one pass over the documents' shingles, all widths at once, each an 8-byte hash that probes a
broadcast of the sketches, which is used up to BROADCAST hashes; a larger benchmark is joined in a
shuffle instead, in which a shingle that very many documents hold is split. Only documents with a
candidate are read again, and only shingles that their candidates have are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import base

WORDS = 5
THRESHOLD = 0.8
#: A band's sketches have one spare shingle for so many of its largest item's, and so many hits more are asked for.
SPARE = 16
#: Items may share a shingle this often before it goes to the end of a sketch's order.
COMMON = 8
#: Sketch hashes (12 bytes each with the width) that are broadcast at most, and bytes of shingle texts.
BROADCAST = 1_000_000
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def _shingles(w: Column, width: Column | int) -> Column:
    """The shingle texts of an array of words; none if there are fewer words."""
    width = width if isinstance(width, Column) else F.lit(width)
    n = F.size(w) - width + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(w, i, width), " ")))


def _hashes(width: int) -> Column:
    """64-bit hashes of the shingles, from those of the words in ``h0``; equal shingles have equal hashes."""
    n = F.size("h0") - width + 1
    one = lambda i: F.xxhash64(*(F.get("h0", i + k) for k in range(width)))
    return F.when(n < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one))


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(item_id, key, width, n, band, size, hits of each item that has a word; key, width, shingle, h, sketched of its
    shingles). ``key`` tells items of one id and different texts apart."""
    w = items.select("item_id", F.monotonically_increasing_id().alias("key"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = base.save(w.withColumn("width", F.least(F.size("w"), F.lit(WORDS))), "items")
    rows = None
    for k in range(1, WORDS + 1):
        h0 = w.where(F.col("width") == k).withColumn("h0", F.transform("w", lambda x: F.xxhash64(x)))
        part = h0.select("item_id", "key", "width", F.explode(F.arrays_zip(_shingles(F.col("w"), k).alias("shingle"), _hashes(k).alias("h"))).alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    rows = base.save(rows.select("item_id", "key", "width", "x.shingle", "x.h").dropDuplicates(["key", "shingle"]), "item_shingles")
    miss = lambda n: n - F.ceil(F.lit(threshold) * n - 1e-9)
    sized = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("band", F.floor(F.log2("n") + 1e-9).cast("int"))
    top = F.pow(F.lit(2), F.col("band") + 1) - 1
    sized = sized.withColumn("size", F.least(F.col("n"), miss(top) + F.greatest(F.lit(1), F.floor(top / SPARE))).cast("int"))
    sized = sized.withColumn("hits", F.col("size") - miss(F.col("n")))
    shared = rows.groupBy("width", "h").agg(F.count(F.lit(1)).alias("items")).where(F.col("items") > COMMON)
    ranked = rows.join(shared, ["width", "h"], "left").join(sized.select("key", "size"), "key")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("items").isNotNull(), "h", "shingle"))
    ranked = ranked.withColumn("sketched", place <= F.col("size")).select("item_id", "key", "width", "shingle", "h", "sketched")
    return rows.select("item_id", "key", "width").distinct().join(sized, "key"), ranked


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, containment of each document and item with at least ``threshold`` of the item's shingles in it.

    Null and empty texts and items without a word match nothing. Rows that repeat a doc_id or an
    item_id count as one document or item for each different text. Empty tables give an empty result.
    """
    return _met(docs, items, threshold).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def _exploded(docs: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, t (hash of the text), width, h of every shingle of every document, for all widths in one pass."""
    h0 = docs.select("doc_id", F.xxhash64("text").alias("t"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h0"))
    named = lambda k: F.transform(_hashes(k), lambda h: F.struct(F.lit(k).alias("width"), h.alias("h")))
    every = [named(k) for k in widths]
    return h0.select("doc_id", "t", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("x")).select("doc_id", "t", "x.width", "x.h")


def _met(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """As contaminated(), with the hash t of the text that holds the item; a row for each text."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    known, shingle_rows = sketches(items.select("item_id", "text").distinct(), threshold)
    known, shingle_rows = base.save(known, "bands"), base.save(shingle_rows, "sketches")
    docs = docs.select("doc_id", "text")
    widths = sorted(r.width for r in known.select("width").distinct().collect())
    if not widths:
        return docs.select("doc_id", F.xxhash64("text").alias("t"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("containment")).limit(0)
    probes = base.save(shingle_rows.where("sketched").select("width", "h", "key"), "probes")
    size = shingle_rows.agg(F.count_if("sketched"), F.sum(F.octet_length("shingle") + 32)).first()
    probe = base.save(probes.select("width", "h").distinct(), "probe")
    small, light = size[0] <= BROADCAST, size[1] <= BROADCAST_BYTES
    hits = base.save(_exploded(docs, widths).join(F.broadcast(probe) if small else probe, ["width", "h"]).distinct(), "hits")
    found = hits.join(F.broadcast(probes) if small else probes, ["width", "h"]).groupBy("doc_id", "t", "key").agg(F.count(F.lit(1)).alias("got"))
    rule = known.select("key", "item_id", "width", "n", "hits")
    pairs = base.save(found.join(F.broadcast(rule) if light else rule, "key").where(F.col("got") >= F.col("hits")).select("doc_id", "t", "key", "item_id", "width", "n"), "pairs")
    return _verified(docs, pairs, shingle_rows.select("key", "shingle"), threshold, light)


def _verified(docs: DataFrame, pairs: DataFrame, shingle_rows: DataFrame, threshold: float, light: bool) -> DataFrame:
    """Of the candidate pairs those whose document holds the threshold's share of the item's shingles, compared as texts."""
    asked = pairs.groupBy("doc_id", "t").agg(F.collect_set("width").alias("widths")).select(F.col("doc_id").alias("m"), F.col("t").alias("mt"), "widths")
    few = pairs.count() <= BROADCAST
    texts = docs.join(F.broadcast(asked) if few else asked, F.col("doc_id").eqNullSafe(F.col("m")) & (F.xxhash64("text") == F.col("mt"))).select("doc_id", F.col("mt").alias("t"), "widths", words(F.col("text")).alias("w"))
    has = texts.select("doc_id", "t", F.explode(F.flatten(F.transform("widths", lambda k: _shingles(F.col("w"), k)))).alias("shingle"))
    every = shingle_rows.select("shingle").distinct()
    has = has.join(F.broadcast(every) if light else every, "shingle", "left_semi").distinct().select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), F.col("shingle").alias("s"))
    wanted = pairs.join(F.broadcast(shingle_rows) if light else shingle_rows, "key")
    both = wanted.join(has, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")) & (F.col("shingle") == F.col("s")))
    share = both.groupBy("doc_id", "t", "item_id", "key", "n").agg(F.count(F.lit(1)).alias("got")).withColumn("containment", F.col("got") / F.col("n"))
    return share.where(F.col("containment") >= threshold - 1e-9).select("doc_id", "t", "item_id", "containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a doc_id (or null) of which no row holds an item."""
    bad = contaminated(docs, items, threshold).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, each judged by its own text where a doc_id is null or repeats."""
    bad = _met(docs, items, threshold).select(F.col("doc_id").alias("bad_id"), F.col("t").alias("bad_t")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (base.by_id() == bad["bad_t"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark
), s AS (
  SELECT item_id, least(len(w), 5) AS width,
         list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i : i + least(len(w), 5) - 1], ' '))) AS sh
  FROM iw WHERE len(w) > 0
), e AS (SELECT item_id, width, len(sh) AS n, unnest(sh) AS x FROM s),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT DISTINCT width FROM e),
d AS (
  SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(w[i : i + width - 1], ' '))) AS x
  FROM dw, k WHERE len(w) >= width
)
SELECT doc_id, item_id, count(*) / any_value(n) AS containment
FROM e JOIN d USING (width, x) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.8 - 1e-9
"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLE = {"op5_decontaminate": OP5_SQL}
