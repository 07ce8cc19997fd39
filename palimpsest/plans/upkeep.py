"""Registered queries of places of empty subtrees, dates as shown, search by index, notifications read, blobs collected and extractors identified, with their DuckDB forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.functions import layout as Y
from palimpsest.operators import documents as D
from palimpsest.operators import index as I
from palimpsest.operators import projections as P
from palimpsest.operators import snapshot as Z
from palimpsest.operators import stored as K
from palimpsest.plans.registry import LAST, log, query, t
from palimpsest.sources import staging

BUCKETS = 32


@query("""WITH lf AS (SELECT conv_id AS content_id, lpad(CAST(turn // 2 + 1 AS VARCHAR), 4, '0') AS up, lpad(CAST(turn % 2 + 1 AS VARCHAR), 4, '0') AS k, (turn // 2 + conv_id) % 3 <> 0 AND turn % 7 <> 0 AS placed, length(coalesce(text, '')) AS n FROM conversations),
pl AS (SELECT *, CASE WHEN placed THEN coalesce(sum(CASE WHEN placed THEN n + 2 END) OVER (PARTITION BY content_id ORDER BY up, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS s FROM lf),
se AS (SELECT content_id, up, min(s) AS s, max(s + n) AS e FROM pl GROUP BY 1, 2),
sp AS (SELECT *, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY content_id ORDER BY up ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  last_value(e IGNORE NULLS) OVER (PARTITION BY content_id ORDER BY up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS point FROM se),
lp AS (SELECT pl.*, sp.s AS above, sp.point, coalesce(first_value(pl.s IGNORE NULLS) OVER (PARTITION BY content_id, up ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  last_value(pl.s + n IGNORE NULLS) OVER (PARTITION BY content_id, up ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS beside FROM pl JOIN sp USING (content_id, up))
SELECT content_id, up AS path, coalesce(s, point)::BIGINT AS text_start, coalesce(e, point)::BIGINT AS text_end FROM sp
UNION ALL SELECT content_id, up || '.' || k, coalesce(s, CASE WHEN above IS NULL THEN point ELSE beside END)::BIGINT, coalesce(s + n, CASE WHEN above IS NULL THEN point ELSE beside END)::BIGINT FROM lp""")
def W15_empty_places(spark, d):
    """A conversation's sections of two turns each, some turns being without a place and so some sections empty."""
    seg = lambda c: F.lpad(c.cast("string"), 4, "0")
    pair = F.floor(F.col("turn") / 2)
    up = seg(pair + 1)
    turns = t(spark, d, "conversations").select(F.col("conv_id").alias("content_id"), up.alias("up"), F.concat_ws(".", up, seg(F.col("turn") % 2 + 1)).alias("path"), F.coalesce("text", F.lit("")).alias("text"), (((pair + F.col("conv_id")) % 3 != 0) & (F.col("turn") % 7 != 0)).alias("placed"))
    given = D.text_offsets(turns.where("placed").withColumn("nid", F.col("path"))).select("content_id", "path", F.col("text_start").cast("long"), F.col("text_end").cast("long"))
    bare = lambda rows, path: rows.select("content_id", F.col(path).alias("path"), F.lit(None).cast("long").alias("text_start"), F.lit(None).cast("long").alias("text_end"))
    nodes = given.unionByName(bare(turns.where("NOT placed"), "path")).unionByName(bare(turns.select("content_id", "up").distinct(), "up"))
    return Z.places(nodes).select("content_id", "path", "text_start", "text_end")


@query("""WITH b AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 9 AS k FROM orders),
r AS (SELECT o_orderkey, k, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN d WHEN 4 THEN date_trunc('month', d)::DATE WHEN 5 THEN date_trunc('year', d)::DATE WHEN 6 THEN make_date(year(d) // 10 * 10, 1, 1) ELSE d END AS lo,
  CASE k WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN d WHEN 4 THEN last_day(d) WHEN 5 THEN make_date(year(d), 12, 31) WHEN 6 THEN make_date(year(d) // 10 * 10 + 9, 12, 31) WHEN 7 THEN (d + INTERVAL 9 DAY)::DATE WHEN 8 THEN (d + INTERVAL 200 DAY)::DATE ELSE d END AS hi FROM b),
f AS (SELECT *, strftime(lo, '%b') || ' ' || day(lo) AS sl, strftime(hi, '%b') || ' ' || day(hi) AS sh FROM r)
SELECT o_orderkey, CASE WHEN k = 0 THEN 'undated' WHEN k = 1 THEN 'on or before ' || sh || ', ' || year(hi) WHEN k = 2 THEN 'on or after ' || sl || ', ' || year(lo) WHEN k = 3 THEN sl || ', ' || year(lo) WHEN k = 4 THEN strftime(lo, '%b') || ' ' || year(lo)
  WHEN k = 5 THEN year(lo)::VARCHAR WHEN k = 6 THEN year(lo) || 's' WHEN year(lo) <> year(hi) THEN sl || ', ' || year(lo) || ' – ' || sh || ', ' || year(hi) WHEN month(lo) <> month(hi) THEN sl || ' – ' || sh || ', ' || year(hi)
  ELSE sl || '–' || day(hi) || ', ' || year(hi) END || ' (' || CASE o_orderkey % 2 WHEN 0 THEN 'explicit' ELSE 'inherited' END || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ', ' || printf('%.2f', (o_orderkey % 1001) / 1000.0) END || ')' AS shown FROM f""")
def E5_shown_estimate(spark, d):
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 9
    ten = F.floor(F.year(day) / 10) * 10
    new_year = lambda y: F.make_date(y.cast("int"), F.lit(1), F.lit(1))
    last = lambda y: F.make_date(y.cast("int"), F.lit(12), F.lit(31))
    lo = F.when(k.isin(0, 1), None).when(k == 4, F.trunc(day, "month")).when(k == 5, new_year(F.year(day))).when(k == 6, new_year(ten)).otherwise(day)
    hi = F.when(k.isin(0, 2), None).when(k == 4, F.last_day(day)).when(k == 5, last(F.year(day))).when(k == 6, last(ten + 9)).when(k == 7, F.date_add(day, 9)).when(k == 8, F.date_add(day, 200)).otherwise(day)
    source = F.when(F.col("o_orderkey") % 2 == 0, "explicit").otherwise("inherited")
    conf = F.when(F.col("o_orderkey") % 4 != 1, (F.col("o_orderkey") % 1001) / 1000.0)
    return t(spark, d, "orders").select("o_orderkey", Y.estimate(lo, hi, source, conf).alias("shown"))


@query("""WITH q AS (SELECT item_id AS query, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')[1:2]) AS terms FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf, max(n) AS n FROM (SELECT doc_id, length(text) AS n, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2),
m AS (SELECT query, any_value(terms) AS terms, doc_id, sum(tf) AS tf, max(n) AS n FROM (SELECT query, terms, unnest(terms) AS term FROM q) JOIN p USING (term) GROUP BY query, doc_id HAVING count(*) = any_value(len(terms))),
r AS (SELECT query, terms, doc_id, round(tf / (1 + ln(n)), 9) AS rank FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank DESC, doc_id DESC) AS place FROM r QUALIFY place <= 20),
s AS (SELECT o.*, text, list_min(list_transform(terms, lambda w: strpos(lower(text), w))) - 1 AS hit FROM o JOIN documents USING (doc_id))
SELECT query, place, doc_id, rank, hit AS at, CASE WHEN hit > 60 THEN '…' ELSE '' END || trim(regexp_replace(substr(text, greatest(hit - 60, 0) + 1, least(hit + 120, length(text)) - greatest(hit - 60, 0)), '\\s+', ' ', 'g')) || CASE WHEN hit + 120 < length(text) THEN '…' ELSE '' END AS snippet FROM s""")
def G10_indexed(spark, d):
    """The first two words of each benchmark item as a query, all answered from one stored index."""
    docs = t(spark, d, "documents")
    words = F.filter(F.split(F.lower("text"), I.GAP), lambda w: w != "")
    queries = t(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.array_distinct(F.slice(words, 1, 2)).alias("terms"))
    index = I.write(I.postings(docs), f"{staging.shared_folder(spark)}/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}", BUCKETS)
    found = I.shown(I.best(index, queries), docs, queries)
    return found.select("query", F.col("place").cast("long").alias("place"), "doc_id", "rank", F.col("at").cast("long").alias("at"), "snippet")


@query("SELECT o_orderkey AS id, o_custkey AS owner_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN DATE '2000-01-01' END AS read_at, o_orderstatus <> 'F' AND o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AS marked FROM orders")
def P10_marked_read(spark, d):
    """Orders as notifications, read where filled; each second is asked for, twice, of these each third by another's owner."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("read_at"))
    asked = o.where("id % 2 = 0").select("id", (F.col("owner_id") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("owner_id"))
    return P.marked_read(o, asked.unionByName(asked), F.lit("2000-01-01").cast("date")).select("id", "owner_id", "read_at", "marked")


@query(LAST + "SELECT obj_id, version, deleted FROM log UNION ALL SELECT obj_id, version + 1, true FROM last WHERE NOT deleted AND obj_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AND obj_id NOT IN (SELECT s_suppkey FROM supplier)")
def P14_collected(spark, d):
    customers = t(spark, d, "customer").where("c_acctbal > 5000")
    return P.collected(log(spark, d), [(customers, "c_custkey"), (t(spark, d, "supplier"), "s_suppkey")]).select("obj_id", F.col("version").cast("long").alias("version"), "deleted")


@query("""WITH a AS (SELECT l_orderkey AS seq, 'm' || (l_suppkey % 7) AS name, l_linenumber AS tool_version, l_returnflag || l_linestatus AS said FROM lineitem),
f AS (SELECT name, tool_version, min(seq) AS made, arg_min(said, seq) AS first FROM a GROUP BY 1, 2)
SELECT seq, name, tool_version, CASE WHEN said <> CASE WHEN tool_version <= 3 THEN 'NO' ELSE first END THEN 'refuse' WHEN tool_version > 3 AND seq = made THEN 'create' ELSE 'use' END AS op FROM a JOIN f USING (name, tool_version)""")
def X40_extractors(spark, d):
    """Line items as runs of an extractor by supplier's remainder and line number, flag and status being its config; those of lines 1 to 3 are on record.
    Of runs with one order's key the first in the table is the first."""
    l = t(spark, d, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index")  # noqa: E741
    config = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus"))
    asked = l.select(F.col("l_orderkey").alias("seq"), F.concat(F.lit("m"), F.col("l_suppkey") % 7).alias("name"), F.col("l_linenumber").alias("tool_version"), config.alias("config"), "file_path", "row_index")
    known = asked.where("tool_version <= 3").select("name", "tool_version").distinct().withColumn("config", F.create_map(F.lit("status"), F.lit("O"), F.lit("flag"), F.lit("N")))
    return K.identified(asked, known, ["file_path", "row_index"]).select("seq", "name", "tool_version", "op")
