"""Full-text search over a stored index: postings by term, dealt so that neither a frequent term nor a long text is one task's, and many queries ranked at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import documents as D

#: What lies between words, as a pattern.
GAP = r"[^\p{L}\p{N}]+"


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, length): how often each document (doc_id, unique, and text) holds each word in lower case, and its length in characters.
    A null or empty text has none; a document without an id isn't indexed. Words are counted where the document is read, so what is shuffled are its different words."""
    each = docs.where("doc_id IS NOT NULL").select("doc_id", F.length("text").alias("length"), F.explode(F.split(F.lower("text"), GAP)).alias("term")).where("term <> ''")
    return each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write(post: DataFrame, folder: str, buckets: int = 1024, parts: int = 16) -> DataFrame:
    """Postings written in ``buckets`` folders by term, in each sorted by term, and read back with ``bucket``. A bucket is dealt by document over as many as ``parts`` tasks
    and files, as a frequent term has a posting in most documents."""
    rows = post.withColumn("bucket", _bucket(F.col("term"), buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(folder)
    return post.sparkSession.read.schema(rows.schema).parquet(folder)


def of_terms(index: DataFrame, terms: Sequence[str], buckets: int = 1024) -> DataFrame:
    """The postings of some terms: only the folders they are in are read (``buckets`` as written), and of those the row groups that may hold one."""
    return index.where(F.col("bucket").isin(*(_bucket(F.lit(t), buckets) for t in terms)) & F.col("term").isin(*terms)) if terms else index.where("false")


def best(post: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """(query, place, doc_id, rank): for each of ``queries`` (query, terms: different ones) the first documents that hold all terms. The rank is how often they do over
    1 + ln(length), of equal ones the larger doc_id comes first. A query without terms finds none. Each task keeps no more than ``most`` of a query before rows are shuffled to it."""
    want = queries.select("query", F.explode("terms").alias("term"), F.size("terms").alias("needed"))
    met = post.join(want, "term").groupBy("query", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("needed").alias("needed"), F.sum("tf").alias("tf"), F.max("length").alias("length"))
    rank = F.round(F.col("tf") / (1 + F.log(F.col("length").cast("double"))), 9)
    rows = met.where("n = needed").select("query", "doc_id", rank.alias("rank"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rank"), F.desc("doc_id")))).where(F.col("place") <= most)


def shown(found: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """What ``best`` found with ``at``, the first place in the text where any of the query's terms stands, within a word too, and a snippet around it."""
    rows = found.join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query", "terms"), "query")
    at = F.array_min(F.transform("terms", lambda term: F.position(term, F.lower("text")))) - 1
    return rows.withColumn("at", at).withColumn("snippet", D.snippet(F.col("text"), F.col("at"))).drop("text", "terms")
