"""Registered queries of cards, failed pages, imports, the events of a source, notifications and contexts of writes, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import history as H
from palimpsest.operators import library as Y
from palimpsest.operators import reads as R
from palimpsest.operators import requests as Q
from palimpsest.plans.reads import EVENTS, _events
from palimpsest.plans.registry import LOG, log, query, t


@query("SELECT l_orderkey AS content_id, l_linenumber::INT AS number, (l_orderkey % 4 = 0 AND l_linenumber IN (1, 3)) OR (l_orderkey % 4 = 3 AND l_linenumber = 2) AS failed FROM lineitem")
def G18_failed_pages(spark, d):
    """Line items as pages of their order, whose stats name pages as numbers, as text, as no list, or are null."""
    kind = F.col("o_orderkey") % 4
    stats = F.when(kind == 0, '{"failed_pages": [1, 3, 3]}').when(kind == 1, '{"failed_pages": "all"}').when(kind == 3, '{"n": 1, "failed_pages": ["2", "x", null, 9]}')
    contents = t(spark, d, "orders").select(F.col("o_orderkey").alias("content_id"), stats.alias("stats"))
    return Y.page_rows(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("content_id"), F.col("l_linenumber").cast("int").alias("number")), contents)


@query("""WITH n AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
x AS (SELECT o_orderkey AS doc_id, o_orderdate AS occurred_at, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey::VARCHAR ELSE o_orderstatus || o_custkey END AS title, CASE o_orderstatus WHEN 'F' THEN 'application/pdf' WHEN 'O' THEN 'text/html' ELSE 'csv' END AS mime, o_totalprice AS size FROM orders)
SELECT doc_id, occurred_at, title, CASE mime WHEN 'application/pdf' THEN 'PDF' WHEN 'text/html' THEN 'HTML' ELSE 'CSV' END || CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN ', 1 page' ELSE ', ' || n || ' pages' END AS description, mime, size, n AS page_count, mime = 'application/pdf' OR n IS NOT NULL AS shown FROM x LEFT JOIN n USING (doc_id)""")
def P8_cards(spark, d):
    """Orders as documents with their line items as pages; every fifth has none yet, every sixth no title."""
    status = F.col("o_orderstatus")
    mime = F.when(status == "F", "application/pdf").when(status == "O", "text/html").otherwise("csv")
    title = F.when(F.col("o_orderkey") % 12 == 0, "").when(F.col("o_orderkey") % 6 != 0, F.concat(status, F.col("o_custkey").cast("string")))
    docs = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), title.alias("title"), mime.alias("mime"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("created"))
    return Y.cards(docs, t(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("doc_id")))


@query(LOG + """, v AS (SELECT obj_id AS doc_id, max(version) AS version FROM log GROUP BY 1),
x AS (SELECT doc_id, text, coalesce(lang, '') IN ('en', 'de') AS ok, CASE WHEN lang = 'en' THEN 'v1.' || source || '.CSV' WHEN lang = 'de' THEN '.' || source ELSE source || '.csv.pdf' END AS title FROM documents)
SELECT doc_id, CASE WHEN ok AND version IS NOT NULL THEN CASE WHEN doc_id % 4 = 0 THEN 'set ' || doc_id WHEN title LIKE 'v1.%' THEN regexp_replace(title, '[.]CSV$', '') ELSE 'Imported dataset' END END AS name,
CASE WHEN ok AND version IS NOT NULL THEN greatest(0, length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND text NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END - 1)::BIGINT END AS row_count,
CASE WHEN ok THEN version::BIGINT END AS source_version, CASE WHEN NOT ok THEN 'not delimited text' WHEN version IS NULL THEN 'no version' END AS problem FROM x LEFT JOIN v USING (doc_id)""")
def P11_imported(spark, d):
    """Documents imported as data sets: English ones by their name, German ones by their type, others refused; a user's events are the versions of the document of that id."""
    lang = F.coalesce("lang", F.lit(""))
    title = F.when(lang == "en", F.concat(F.lit("v1."), "source", F.lit(".CSV"))).when(lang == "de", F.concat(F.lit("."), "source")).otherwise(F.concat("source", F.lit(".csv.pdf")))
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("set "), F.col("doc_id").cast("string")))
    docs = t(spark, d, "documents").select("doc_id", title.alias("title"), F.when(lang == "de", "text/csv").otherwise("text/plain").alias("mime"), "text", name.alias("name"))
    versions = H.latest(log(spark, d)).select(F.col("obj_id").alias("doc_id"), F.col("version"))
    made, edges, refused = Y.imported(docs, versions)
    sets = made.join(edges.withColumnRenamed("source_id", "doc_id"), "doc_id").select("doc_id", "name", "row_count", F.col("source_version").cast("long").alias("source_version"))
    return sets.unionByName(refused, allowMissingColumns=True)


@query(EVENTS + "SELECT id, source_id, event_type, retired OR source_id % 3 = 0 OR (source_id % 3 = 1 AND event_type = 'click') AS retired, NOT retired AND (source_id % 3 = 0 OR (source_id % 3 = 1 AND event_type = 'click')) AS changed FROM ev")
def P3_removed(spark, d):
    """Users' events: all of each third's retired, of another third's those of one type, each asked for more than once."""
    e = _events(spark, d)
    typed = F.when(F.col("source_id") % 3 == 1, "click")
    asked = e.where("source_id % 3 < 2").select("source_id", typed.alias("event_type"))
    return Y.removed(e, asked).select("id", "source_id", "event_type", "retired", "changed")


@query(EVENTS + "SELECT source_id, id, event_type, row_number() OVER (PARTITION BY source_id ORDER BY created DESC, id DESC) AS place FROM ev WHERE NOT retired AND source_id IN (SELECT c_custkey FROM customer)")
def P6_events_of_source(spark, d):
    sources = t(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    return Y.events_of(_events(spark, d), sources).select("source_id", "id", "event_type", F.col("place").cast("long").alias("place"))


@query("""WITH e AS (SELECT user_id AS worker, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)
SELECT worker, k AS seq, CASE WHEN k % 10 IN (4, 5) AND worker % 5 <> 0 THEN 'inner-' || k // 10 WHEN k % 10 BETWEEN 2 AND 8 THEN 'outer-' || k // 10 END AS run,
CASE WHEN k % 10 IN (4, 5) AND worker % 5 <> 0 THEN 2 WHEN k % 10 BETWEEN 2 AND 8 THEN 1 ELSE 0 END::INT AS depth FROM e WHERE k % 10 NOT IN (1, 3, 6, 9)""")
def L20_attributed(spark, d):
    """A user's events as marks: of each ten the second and tenth open and close a run, the fourth and seventh one within it, which names someone for each fifth user; others are writes."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = t(spark, d, "events").select(F.col("user_id").alias("worker"), k.cast("long").alias("seq"))
    place = F.col("seq") % 10
    kind = F.when(place.isin(1, 3), "open").when(place.isin(6, 9), "close").otherwise("write")
    run = F.when(place.isin(1, 9), F.concat(F.lit("outer-"), F.floor(F.col("seq") / 10).cast("string"))).when(place.isin(3, 6), F.concat(F.lit("inner-"), F.floor(F.col("seq") / 10).cast("string")))
    named = F.create_map(F.lit("step"), F.when((place == 3) & (F.col("worker") % 5 == 0), "{00000000-0000-4000-8000-00000000000a}").otherwise("read"))
    return Q.attributed(e.select("worker", "seq", kind.alias("kind"), run.alias("run"), named.alias("metadata")))[0]


@query(EVENTS + """, h AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY source_id, event_type ORDER BY retired, created DESC, id DESC) = 1)
SELECT id, source_id, event_type, CASE WHEN hit THEN 'new' ELSE 'old' END AS payload, retired AND NOT hit AS retired, CASE WHEN id % 3 = 0 THEN created END AS read_at FROM (SELECT *, source_id % 2 = 0 AND id IN (SELECT id FROM h) AS hit FROM ev)
UNION ALL SELECT NULL, c_custkey, 'welcome', 'new', FALSE, NULL FROM customer WHERE c_custkey % 7 = 0""")
def P9_notified(spark, d):
    """Events as notifications, each third read: even users' are announced again and stay read, and each seventh customer is welcomed."""
    e = _events(spark, d).withColumns({"payload": F.lit("old"), "read_at": F.when(F.col("id") % 3 == 0, F.col("created"))})
    want = e.where("source_id % 2 = 0").select("source_id", "event_type").distinct()
    new = t(spark, d, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").alias("source_id"), F.lit("welcome").alias("event_type"))
    told = R.upserted(e, want.unionByName(new).withColumn("payload", F.lit("new")), ["source_id", "event_type"], "payload", keep=["read_at"])
    return told.select("id", "source_id", "event_type", "payload", "retired", "read_at")
