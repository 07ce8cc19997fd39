"""More registered queries: reads of lineage and history, document and listing reads, upserts, pruning, and pages put together.

The tables stand in as in ``registry``. An order is a version of its customer; a line of an order is an edge from that version to
a version of its supplier (as many as there are line numbers). Conversations are contents, their turns nodes or lines.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import assembly as A
from palimpsest.functions import expressions as E
from palimpsest.functions import layout as Y
from palimpsest.operators import documents as D
from palimpsest.operators import history as H
from palimpsest.operators import lineage as L
from palimpsest.operators import projections as P
from palimpsest.operators import reads as R
from palimpsest.plans.registry import LOG, PAGES, _tree, log, query, t

# --- lineage

EDGE = """WITH v AS (SELECT o_custkey AS obj_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders),
e AS (SELECT l_orderkey AS target_event, l_suppkey AS source_obj, min(l_linenumber)::BIGINT AS source_version, min(l_shipdate) AS created FROM lineitem GROUP BY 1, 2),
sv AS (SELECT s_suppkey AS obj_id, unnest(range(1, 2 + s_suppkey % 7))::BIGINT AS version FROM supplier), top AS (SELECT obj_id, max(version) AS latest FROM sv GROUP BY 1) """


def _chain(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, d, "orders").select(F.col("o_custkey").alias("obj_id"), F.col("o_orderkey").alias("event_id"), F.row_number().over(w).alias("version"))


def _lines(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target_event"), F.col("l_suppkey").alias("source_obj")).agg(F.min("l_linenumber").cast("long").alias("source_version"), F.min("l_shipdate").alias("created"))


def _sources(spark, d):
    return t(spark, d, "supplier").select(F.col("s_suppkey").alias("obj_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("s_suppkey") % 7 + 1)).alias("version"))


@query(EDGE + "SELECT obj_id, version, source_obj, source_version FROM e JOIN (SELECT obj_id, max_by(event_id, version) AS event_id, max(version) AS version FROM v GROUP BY 1) ON event_id = target_event")
def L4_sources_of_current(spark, d):
    return L.sources_of(_lines(spark, d), _chain(spark, d)).select("obj_id", "version", "source_obj", "source_version")


@query(EDGE + "SELECT obj_id, source_obj, source_version FROM e JOIN v ON event_id = target_event WHERE version = 2")
def L5_sources_of_version(spark, d):
    return L.sources_of_version(_lines(spark, d), _chain(spark, d), 2).select("obj_id", "source_obj", "source_version")


@query(EDGE + "SELECT obj_id, count(*) AS edges, count(DISTINCT source_obj) AS sources, min(created) AS first FROM e JOIN v ON event_id = target_event GROUP BY 1")
def L6_all_sources(spark, d):
    return L.all_sources(_lines(spark, d), _chain(spark, d)).groupBy("obj_id").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("source_obj").alias("sources"), F.min("created").alias("first"))


@query(EDGE + "SELECT source_obj, target_event FROM e WHERE source_version = 3")
def L8_derived_from_version(spark, d):
    return L.derived_from_version(_lines(spark, d), 3).select("source_obj", "target_event")


@query(EDGE + ", f AS (SELECT obj_id, source_obj, min(created) AS created FROM e JOIN v ON event_id = target_event GROUP BY 1, 2) SELECT obj_id, source_obj, row_number() OVER (PARTITION BY obj_id ORDER BY created, source_obj) AS pos FROM f")
def L10_distinct_sources(spark, d):
    return L.distinct_ends(L.all_sources(_lines(spark, d), _chain(spark, d)), "obj_id", ["source_obj"]).select("obj_id", "source_obj", "pos")


@query(EDGE + "SELECT source_obj, count(*) FILTER (WHERE source_version < latest) AS stale FROM e JOIN top ON obj_id = source_obj GROUP BY 1")
def L14_stale_counts(spark, d):
    return L.stale_counts(_lines(spark, d), _sources(spark, d))


@query(EDGE + "SELECT target_event, source_obj, s_name AS label, coalesce(source_version < latest, FALSE) AS is_stale FROM e LEFT JOIN top ON obj_id = source_obj LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON s_suppkey = source_obj")
def D4_source_refs(spark, d):
    labels = t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("obj_id"), F.col("s_name").alias("label"))
    return L.source_refs(_lines(spark, d), _sources(spark, d), labels).select("target_event", "source_obj", "label", "is_stale")


@query(EDGE + "SELECT target_event, source_obj FROM e WHERE source_obj IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def L18_deleted_ends(spark, d):
    return L.deleted_ends(_lines(spark, d), t(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("obj_id"))).select("target_event", "source_obj")


@query(EDGE + "SELECT target_event, source_obj, source_version, source_obj * 100 + source_version AS source_event FROM e JOIN sv ON obj_id = source_obj AND version = source_version")
def J10_paired_edges(spark, d):
    v = _sources(spark, d).withColumn("event_id", F.col("obj_id") * 100 + F.col("version"))
    return L.paired(_lines(spark, d), v).select("target_event", "source_obj", "source_version", "source_event")


@query(EDGE + "SELECT obj_id, target_event, source_obj FROM e JOIN v ON event_id = target_event")
def J8_edge_targets(spark, d):
    return L.all_sources(_lines(spark, d), _chain(spark, d)).select("obj_id", "target_event", "source_obj")


@query("SELECT n_regionkey, n_nationkey, 1 < 1 + n_regionkey % 2 AS is_stale FROM nation WHERE n_regionkey = 1")
def L11_graph_edges(spark, d):
    e = t(spark, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("source_id"), F.concat(F.lit("N"), "n_nationkey").alias("target_id"), F.lit(0).alias("created"), F.col("n_nationkey").alias("edge_id"), F.lit(1).alias("source_version"))
    latest = t(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("obj_id"), (F.col("r_regionkey") % 2 + 1).alias("latest"))
    got = L.graph_edges(e, L.graph(e, "R1", 2), latest)
    return got.select(F.substring("source_id", 2, 9).cast("long").alias("n_regionkey"), F.substring("target_id", 2, 9).cast("long").alias("n_nationkey"), "is_stale")


# --- history


@query(LOG + "SELECT obj_id, version, event_id FROM log ORDER BY obj_id, version")
def W3_version_chain(spark, d):
    return log(spark, d).orderBy("obj_id", "version").select("obj_id", "version", "event_id")


@query(LOG + "SELECT obj_id, event_type, value FROM log WHERE version = 3")
def V3_reconstruct(spark, d):
    return H.as_of(log(spark, d), 3).where("version = 3").select("obj_id", "event_type", "value")


def _schemas(spark, tag: str):
    return spark.createDataFrame([("click", ["event_type"]), ("view", ["event_type", "value"]), ("error", ["deleted", "value"])], f"{tag} string, fields array<string>")


@query("SELECT event_type AS label, CASE event_type WHEN 'click' THEN 'event_type' WHEN 'view' THEN 'event_type,value' ELSE 'deleted,value' END AS fields, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1, 2")
def V5_schema_at(spark, d):
    rows = _schemas(spark, "label").withColumn("tag", F.lit("one")).unionByName(spark.createDataFrame([("click", ["other"], "two")], "label string, fields array<string>, tag string"))
    known = H.schema_at(H.schema_fold(rows, rows.withColumn("fields", F.array(F.lit("rewritten")))), "one")
    return t(spark, d, "events").join(F.broadcast(known), F.col("event_type") == F.col("label")).groupBy("label", F.array_join("fields", ",").alias("fields")).agg(F.count(F.lit(1)).alias("n"))


@query(LOG + """, p AS (SELECT *, lag(version) OVER w AS pv, lag(event_type) OVER w AS pe, lag(value) OVER w AS pval, lag(deleted) OVER w AS pd FROM log WINDOW w AS (PARTITION BY obj_id ORDER BY version)),
k AS (SELECT *, event_type IN ('click', 'view', 'error') AS known, pe IN ('click', 'view', 'error') AS pknown FROM p),
f AS (SELECT *, CASE event_type WHEN 'click' THEN ['event_type'] WHEN 'view' THEN ['event_type', 'value'] WHEN 'error' THEN ['deleted', 'value'] END AS now,
  CASE pe WHEN 'click' THEN ['event_type'] WHEN 'view' THEN ['event_type', 'value'] WHEN 'error' THEN ['deleted', 'value'] END AS was FROM k)
SELECT obj_id, version, CASE WHEN NOT known THEN '' WHEN pv IS NULL THEN concat_ws(',', CASE WHEN list_contains(now, 'deleted') AND deleted THEN 'deleted' END, CASE WHEN list_contains(now, 'event_type') THEN 'event_type' END, CASE WHEN list_contains(now, 'value') AND value <> 0 THEN 'value' END)
  WHEN NOT pknown THEN '' ELSE concat_ws(',', CASE WHEN list_contains(now, 'deleted') AND list_contains(was, 'deleted') AND deleted IS DISTINCT FROM pd THEN 'deleted' END, CASE WHEN list_contains(now, 'event_type') AND list_contains(was, 'event_type') AND event_type IS DISTINCT FROM pe THEN 'event_type' END,
  CASE WHEN list_contains(now, 'value') AND list_contains(was, 'value') AND value IS DISTINCT FROM pval THEN 'value' END) END AS changed,
  CASE WHEN NOT known THEN '*' WHEN pv IS NULL THEN '' WHEN NOT pknown THEN array_to_string(now, ',') ELSE concat_ws(',', CASE WHEN list_contains(now, 'deleted') <> list_contains(was, 'deleted') THEN 'deleted' END, CASE WHEN list_contains(now, 'event_type') <> list_contains(was, 'event_type') THEN 'event_type' END,
  CASE WHEN list_contains(now, 'value') <> list_contains(was, 'value') THEN 'value' END) END AS unknown FROM f""")
def U4_tagged_diff(spark, d):
    got = H.tagged_diff(log(spark, d).withColumn("schema_tag", F.col("event_type")), ["event_type", "value", "deleted"], _schemas(spark, "schema_tag"))
    return got.select("obj_id", "version", F.array_join(F.transform("changes", lambda c: c["field"]), ",").alias("changed"), F.array_join("unknown", ",").alias("unknown"))


@query("SELECT obj_id, event_id, label, row_number() OVER (PARTITION BY obj_id ORDER BY \"at\" DESC, event_id DESC, is_related, label) AS pos FROM (SELECT o_custkey AS obj_id, o_orderkey AS event_id, o_orderdate AS \"at\", NULL AS label, FALSE AS is_related FROM orders UNION ALL SELECT o_custkey, l_orderkey, l_shipdate, p_name || ', ' || s_name, TRUE FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)")
def D2_revisions_with_children(spark, d):
    own = t(spark, d, "orders").select(F.col("o_custkey").alias("obj_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("at"))
    kids = t(spark, d, "lineitem").join(own.select("obj_id", F.col("event_id").alias("l_orderkey")), "l_orderkey").select("obj_id", F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").alias("at"), "l_partkey", "l_suppkey")
    kids = R.described_children(kids, {"l_partkey": (t(spark, d, "part"), "p_partkey", "p_name"), "l_suppkey": (t(spark, d, "supplier"), "s_suppkey", "s_name")})
    return H.with_children(own, kids.select("obj_id", "event_id", "at", "label").distinct()).select("obj_id", "event_id", "label", "pos")


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_name || ', ' || s_name AS label FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def J16_child_labels(spark, d):
    kids = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return R.described_children(kids, {"l_partkey": (t(spark, d, "part"), "p_partkey", "p_name"), "l_suppkey": (t(spark, d, "supplier"), "s_suppkey", "s_name")}).select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query(LOG + ", m AS (SELECT obj_id, max(version) AS v, max_by(deleted, version) AS gone FROM log GROUP BY 1) SELECT obj_id, v + 1 AS version, 'bulk' AS event_type FROM m WHERE NOT gone AND obj_id % 2 = 0")
def K3_bulk_update(spark, d):
    before = log(spark, d)
    after = H.bulk_update(before, F.col("obj_id") % 2 == 0, {"event_type": F.lit("bulk")})
    return after.join(before.select("obj_id", "version"), ["obj_id", "version"], "left_anti").select("obj_id", "version", "event_type")


@query(LOG + ", m AS (SELECT obj_id, max(version) AS v FROM log GROUP BY 1) SELECT a.obj_id, a.v + 1 AS target_version, b.obj_id AS source_obj, b.v AS source_version FROM m AS a JOIN m AS b ON b.obj_id = a.obj_id + 1")
def K1_save_with_edges(spark, d):
    before = log(spark, d)
    rows = H.latest(before).drop("version")
    edges = spark.createDataFrame([], "obj_id long, target_version int, source_obj long, source_version int")
    asked = rows.select("obj_id", F.explode(F.array(F.col("obj_id") + 1, F.col("obj_id") + 1, F.col("obj_id"))).alias("source_obj"))
    return H.saved(before, edges, rows, asked)[1]


@query("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'new' WHEN user_id % 3 = 1 THEN NULL ELSE last END AS event_type FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY 1)")
def F20_patch(spark, d):
    row = t(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    given = F.when(F.col("user_id") % 3 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("event_type")))
    patch = row.select("user_id", given.alias("present"), F.when(F.col("user_id") % 3 == 0, "new").alias("event_type"))
    return R.patched(row, patch, "user_id", ["event_type"])


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' END AS shown FROM events")
def F18_rendered(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("s"))
    return e.select("event_id", H.rendered(F.col("s"), e.schema["s"].dataType).alias("shown"))


# --- documents and listings: a customer is a document, its orders are contents, lines are pages


CONTENT = "WITH c AS (SELECT o_custkey AS document_id, o_orderkey AS content_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'partial' END AS status, o_orderdate AS created, o_orderkey % 3 AS extractor, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders) "


def _contents(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("partial")
    o = t(spark, d, "orders")
    top = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("top"))
    return o.join(top, "o_custkey").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("content_id"), status.alias("status"), F.col("o_orderdate").alias("created"), (F.col("o_orderkey") % 3).alias("extractor"), (F.col("o_orderkey") == F.col("top")).alias("is_current"))


@query(CONTENT + "SELECT c_custkey AS document_id, max_by(status, (created, content_id)) AS status, coalesce(max(pages), 0) AS pages FROM customer LEFT JOIN c ON document_id = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1) ON is_current AND l_orderkey = content_id GROUP BY 1")
def G25_document_listing(spark, d):
    pages = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("content_id"))
    return R.listing(t(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), _contents(spark, d), pages)


@query(CONTENT + "SELECT status, count(*) AS n FROM c WHERE status IN ('succeeded', 'partial', 'failed') GROUP BY 1")
def F5_finished(spark, d):
    return _contents(spark, d).where(F.col("status").isin("succeeded", "partial", "failed")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(CONTENT + "SELECT document_id, content_id, content_id = min(content_id) OVER (PARTITION BY document_id) AS is_current FROM c")
def K9_current_flip(spark, d):
    c = _contents(spark, d)
    return R.flip(c, c.groupBy("document_id").agg(F.min("content_id").alias("content_id"))).select("document_id", "content_id", "is_current")


@query(CONTENT + "SELECT document_id, max_by(content_id, (created, content_id)) AS content_id FROM c GROUP BY 1")
def O9_latest_content(spark, d):
    return R.newest(_contents(spark, d).select("document_id", "created", "content_id"), "document_id", ["created", "content_id"]).select("document_id", "content_id")


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def A4_counts_per_page(spark, d):
    kids = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return R.child_counts(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", kids, F.col("l_returnflag") == "R").select("o_orderkey", "n")


@query(CONTENT + ", best AS (SELECT max_by(content_id, (created, content_id)) AS content_id FROM c WHERE status = 'succeeded' GROUP BY document_id, extractor) SELECT content_id FROM c WHERE NOT is_current AND status <> 'running' AND created < TIMESTAMP '1997-01-01' AND content_id NOT IN (SELECT content_id FROM best)")
def P13_prune_snapshots(spark, d):
    return R.prune_snapshots(_contents(spark, d), F.lit("1997-01-01").cast("timestamp_ntz")).select("content_id")


NODES = "WITH n AS (SELECT conv_id AS content_id, turn AS nid, CASE turn % 3 WHEN 0 THEN 'h2' WHEN 1 THEN 'h' || (1 + conv_id % 4) ELSE 'p' END AS tag, text FROM conversations) "


def _nodes(spark, d):
    tag = F.when(F.col("turn") % 3 == 0, "h2").when(F.col("turn") % 3 == 1, F.concat(F.lit("h"), (F.col("conv_id") % 4 + 1).cast("string"))).otherwise("p")
    return t(spark, d, "conversations").select(F.col("conv_id").alias("content_id"), F.col("turn").alias("nid"), tag.alias("tag"), "text")


@query(NODES + "SELECT content_id, nid, tag FROM n WHERE tag <> 'p' ORDER BY 1, 2")
def O7_outline(spark, d):
    return R.outline(_nodes(spark, d)).select("content_id", "nid", "tag")


@query(NODES + "SELECT content_id, min_by(text, (tag, nid)) AS title, substr(min_by(text, nid), 1, 200) AS first FROM n WHERE tag <> 'p' GROUP BY 1")
def O8_heading_title(spark, d):
    n = _nodes(spark, d)
    return R.heading_title(n).join(R.first_heading(n).withColumnRenamed("title", "first"), "content_id")


@query("WITH n AS (SELECT n_nationkey AS nid, lpad(CAST(n_regionkey AS VARCHAR), 4, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS path, n_name AS text FROM nation UNION ALL SELECT 100 + r_regionkey, lpad(CAST(r_regionkey AS VARCHAR), 4, '0'), r_name FROM region), on_page AS (SELECT *, k AS page FROM n, (VALUES (0), (1), (2)) AS x(k) WHERE nid % 3 = k OR (nid >= 100 AND k = 0)) SELECT CAST(page AS INT) AS page, string_agg(text, '' ORDER BY nid) AS text FROM on_page AS a WHERE NOT EXISTS (SELECT 1 FROM on_page AS b WHERE b.page = a.page AND a.path LIKE b.path || '.%') GROUP BY 1")
def G7_page_text(spark, d):
    seg = lambda c: F.lpad(F.col(c).cast("string"), 4, "0")
    n = t(spark, d, "nation").select(F.lit(1).alias("content_id"), F.col("n_nationkey").cast("long").alias("nid"), F.concat_ws(".", seg("n_regionkey"), seg("n_nationkey")).alias("path"), F.col("n_name").alias("text"))
    n = n.unionByName(t(spark, d, "region").select(F.lit(1).alias("content_id"), (F.col("r_regionkey") + 100).cast("long").alias("nid"), seg("r_regionkey").alias("path"), F.col("r_name").alias("text")))
    drawn = n.select("content_id", "nid", F.explode(F.array((F.col("nid") % 3).cast("int"), F.when(F.col("nid") >= 100, 0).otherwise((F.col("nid") % 3).cast("int")))).alias("page"))
    return R.page_text(n, drawn).select("page", "text")


@query("WITH w AS (SELECT p_partkey AS region, CAST(p_size % 3 AS INT) AS page, (p_partkey % 20) / 20.0 AS x0, (p_partkey % 13) / 13.0 AS y0, 0.01 + (p_size % 5) / 50.0 AS s FROM part), p AS (SELECT s_suppkey AS point, CAST(s_suppkey % 3 AS INT) AS page, (s_suppkey % 17) / 17.0 AS x, (s_suppkey % 11) / 11.0 AS y FROM supplier) SELECT p.page, point, min_by(region, (round(s * s, 9), region)) AS region FROM p JOIN w ON w.page = p.page AND x BETWEEN x0 AND x0 + s AND y BETWEEN y0 AND y0 + s GROUP BY 1, 2")
def G5_hit_word(spark, d):
    x, y, s = (F.col("p_partkey") % 20) / 20.0, (F.col("p_partkey") % 13) / 13.0, 0.01 + (F.col("p_size") % 5) / 50.0
    words = t(spark, d, "part").select(F.col("p_partkey").alias("region"), (F.col("p_size") % 3).cast("int").alias("page"), F.round(s * s, 9).alias("area"), F.lit(0).alias("seq"), x.alias("x0"), y.alias("y0"), (x + s).alias("x1"), (y + s).alias("y1"))
    points = t(spark, d, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") % 3).cast("int").alias("page"), ((F.col("s_suppkey") % 17) / 17.0).alias("x"), ((F.col("s_suppkey") % 11) / 11.0).alias("y"))
    return R.hit_word(points, words).select("page", "point", "region")


@query("SELECT doc_id, regexp_replace(text, '(ver|the|a\\.b)', '<mark>\\1</mark>', 'gi') AS marked FROM documents")
def G14_highlight(spark, d):
    return t(spark, d, "documents").select("doc_id", R.highlight(F.col("text"), "the x a.b ver").alias("marked"))


@query("SELECT s_suppkey, CAST(round((s_suppkey % 10) / 10.0 * 200, 6) AS DOUBLE) AS x, s_suppkey % 5 = 0 AS unlocated FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, NULL, TRUE FROM supplier WHERE s_suppkey % 5 = 0")
def G6_scaled(spark, d):
    ring = F.when(F.col("s_suppkey") % 5 != 0, F.array(F.struct(((F.col("s_suppkey") % 10) / 10.0).alias("x"), F.lit(0.5).alias("y"))))
    made = t(spark, d, "supplier").select("s_suppkey", R.scaled(ring, F.lit(200), F.lit(100)).alias("r"))
    return made.select("s_suppkey", F.round(F.get("r", F.lit(0))["x"], 6).alias("x"), F.col("r").isNull().alias("unlocated"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE n_name END AS n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def J18_unknown_names(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("n_nationkey"))
    return R.looked_up(c, "n_nationkey", t(spark, d, "nation"), "n_name").select("c_custkey", "n_name")


@query("SELECT l_orderkey, l_suppkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = 3 GROUP BY 1, 2")
def J11_nodes_on_page(spark, d):
    on = t(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    return t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(on, "l_suppkey", "left_semi").distinct()


@query("SELECT doc_id, count(*) AS hits, min(turn) AS first FROM (SELECT conv_id AS doc_id, turn FROM conversations WHERE lower(text) LIKE '%a%') GROUP BY 1")
def A16_hits_by_document(spark, d):
    return t(spark, d, "conversations").where(F.lower("text").contains("a")).groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("hits"), F.min("turn").alias("first"))


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY min(event_id)) AS INT) AS pos, count(*) AS n FROM events GROUP BY 1")
def A17_groups_in_order(spark, d):
    g = t(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("pos", F.row_number().over(Window.orderBy("first"))).drop("first")  # one row for each of a few groups


# --- upserts, maintenance, tenants


EVENTS = "WITH ev AS (SELECT event_id AS id, user_id AS source_id, event_type, ts AS created, event_id % 4 = 0 AS retired FROM events) "


def _events(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), "event_type", F.col("ts").alias("created"), (F.col("event_id") % 4 == 0).alias("retired"))


@query(EVENTS + "SELECT source_id, event_type, id FROM ev QUALIFY row_number() OVER (PARTITION BY source_id, event_type ORDER BY retired, created DESC, id DESC) = 1")
def P2_find_existing(spark, d):
    return R.existing(_events(spark, d), ["source_id", "event_type"]).select("source_id", "event_type", "id")


@query(EVENTS + ", h AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY source_id, event_type ORDER BY retired, created DESC, id DESC) = 1) SELECT id, source_id, event_type, CASE WHEN source_id % 2 = 0 AND id IN (SELECT id FROM h) THEN 'new' ELSE 'old' END AS payload, CASE WHEN source_id % 2 = 0 AND id IN (SELECT id FROM h) THEN FALSE ELSE retired END AS retired FROM ev")
def P1_upsert(spark, d):
    e = _events(spark, d).withColumn("payload", F.lit("old"))
    want = e.where("source_id % 2 = 0").select("source_id", "event_type").distinct().withColumn("payload", F.lit("new"))
    return R.upserted(e, want, ["source_id", "event_type"], "payload").select("id", "source_id", "event_type", "payload", "retired")


@query(EVENTS + "SELECT source_id, count(*) FILTER (WHERE NOT retired) AS unread FROM ev GROUP BY 1")
def P19_unread_counts(spark, d):
    return _events(spark, d).groupBy("source_id").agg(F.count_if(~F.col("retired")).alias("unread"))


@query(EVENTS + "SELECT id FROM ev WHERE NOT retired AND event_type = 'click'")
def F14_inbox(spark, d):
    return _events(spark, d).where("NOT retired AND event_type = 'click'").select("id")


@query("SELECT p_brand FROM part GROUP BY 1 HAVING count(*) FILTER (WHERE p_size > 48) = 0")
def P12_unused_tags(spark, d):
    p = t(spark, d, "part")
    return R.child_counts(p.select("p_brand").distinct(), "p_brand", p, F.col("p_size") > 48).where("n = 0").select("p_brand")


@query("SELECT o_custkey AS batch, coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL)), ','), '') || CASE WHEN count(*) > 25 THEN CASE WHEN count(f) > 0 THEN ',count' ELSE 'count' END ELSE '' END AS faults FROM (SELECT o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN 'name' WHEN o_orderkey % 70 = 1 THEN 'empty' WHEN o_orderstatus = 'P' THEN 'type' WHEN o_totalprice > CASE o_orderstatus WHEN 'F' THEN 300000 ELSE 400000 END THEN 'size' END AS f FROM orders) GROUP BY 1")
def P15_upload_faults(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.when(F.col("o_orderkey") % 50 != 0, "n").otherwise(" ").alias("name"), F.col("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 70 == 1, 0).otherwise(F.col("o_totalprice")).alias("size"))
    return R.upload_faults(o, 25, {"F": 300000, "O": 400000}).select("batch", F.coalesce(F.array_join("faults", ","), F.lit("")).alias("faults"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 OR o_orderstatus = 'P' AS fits, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'text/csv' ELSE 'application/octet-stream' END ELSE 'x/' || o_orderstatus END AS mime FROM orders")
def S16_importable_and_mime(spark, d):
    name = F.when(F.col("o_orderkey") % 3 == 0, "a.CSV").otherwise("a.bin")
    declared = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.concat(F.lit("x/"), "o_orderstatus"))
    return t(spark, d, "orders").select("o_orderkey", R.importable(name, declared, [".csv", ".tsv"], ["x/P"]).alias("fits"), R.mime_type(declared, name, {"csv": "text/csv"}).alias("mime"))


@query("SELECT 'customer' AS tab, count(*) FILTER (WHERE c_nationkey = 3) AS erased, count(*) FILTER (WHERE c_nationkey <> 3) AS left_over FROM customer UNION ALL SELECT 'supplier', count(*) FILTER (WHERE s_nationkey = 3), count(*) FILTER (WHERE s_nationkey <> 3) FROM supplier")
def T6_erase_tenant(spark, d):
    tables = {"customer": t(spark, d, "customer").withColumnRenamed("c_nationkey", "owner_id"), "supplier": t(spark, d, "supplier").withColumnRenamed("s_nationkey", "owner_id")}
    rest, counts = R.erased(tables, 3)
    left = None
    for name, df in rest.items():
        part = df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(name).alias("tab"), "left_over")
        left = part if left is None else left.unionByName(part)
    return counts.withColumnRenamed("n", "erased").join(left, "tab")


@query("SELECT md5(text) AS sha, min(doc_id) AS doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def K17_put_blobs(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.md5("text").alias("sha"))
    return P.reconcile(x.where("doc_id % 5 = 0"), x, ["sha"]).where("op = 'add'").select("sha").distinct().join(x, "sha").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))


# --- pages put together


@query("SELECT o_orderkey, CASE WHEN k THEN 'li' WHEN one AND s >= 15 THEN 'h2' WHEN one AND (s >= 11.2 OR (bold AND words <= 9)) THEN 'h3' ELSE 'p' END AS kind FROM (SELECT o_orderkey, o_orderkey % 7 = 0 AS k, o_orderkey % 2 = 0 AS one, 9 + o_orderkey % 8 AS s, o_orderkey % 3 = 0 AS bold, o_orderkey % 12 AS words FROM orders)")
def X7_block_kind(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", Y.block_kind(F.when(k % 2 == 0, 1).otherwise(2), 9 + k % 8, k % 3 == 0, k % 12, F.lit(10.0), k % 7 == 0).alias("kind"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '•' WHEN 1 THEN p_size || '.' END AS bullet FROM part")
def X8_bullets(spark, d):
    line = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("  • "), "p_name")).when(F.col("p_size") % 4 == 1, F.concat(F.col("p_size").cast("string"), F.lit(". x"))).when(F.col("p_size") % 4 == 2, F.lit("12345. x")).otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", Y.bullet(line).alias("bullet"))


@query("WITH b AS (SELECT s_suppkey, (s_suppkey % 10) * 10.0 AS x, 20.0 + s_suppkey % 50 AS y FROM supplier) SELECT s_suppkey, round(x / 100, 6) AS x0, round(1 - (y + 8) / 200, 6) AS y0, round(least(1, (x + 30) / 100), 6) AS x1, round(1 - (y - 2) / 200, 6) AS y1 FROM b")
def X5_box_flip(spark, d):
    k = F.col("s_suppkey")
    box = Y.flipped_box((k % 10) * 10.0, 20.0 + k % 50, F.lit(30.0), F.lit(10.0), F.lit(100.0), F.lit(200.0))
    return t(spark, d, "supplier").select("s_suppkey", box.alias("b")).select("s_suppkey", *(F.round(f"b.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || 'end' ELSE p_brand || chr(10) || 'end' END AS text FROM part")
def X9_joined_lines(spark, d):
    first = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_brand"), F.lit("-"))).otherwise(F.col("p_brand"))
    return t(spark, d, "part").select("p_partkey", Y.joined_lines(F.array(first, F.lit("end"))).alias("text"))


@query(NODES + "SELECT a.content_id, a.nid, max(b.nid) AS parent FROM n AS a LEFT JOIN n AS b ON b.content_id = a.content_id AND b.nid < a.nid AND b.tag <> 'p' AND (a.tag = 'p' OR b.tag < a.tag) GROUP BY 1, 2")
def W11_heading_nesting(spark, d):
    n = _nodes(spark, d).withColumn("level", F.substring("tag", 2, 1).try_cast("int"))
    return Y.nested(n.select("content_id", F.col("nid").alias("pos"), "level")).select("content_id", F.col("pos").alias("nid"), "parent")


@query("WITH x AS (SELECT conv_id, turn, turn * 10.0 + CASE WHEN turn % 4 = 3 THEN 20 ELSE 0 END AS down, role = 'user' AS bold FROM conversations), g AS (SELECT *, down - lag(down) OVER w AS gap, bold <> lag(bold) OVER w AS turned FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), m AS (SELECT *, median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY conv_id) AS lead FROM g) SELECT conv_id, turn, CAST(sum(CASE WHEN gap IS NULL OR gap > 1.55 * lead OR gap < 0 OR turned THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM m")
def W13_split_blocks(spark, d):
    down = F.col("turn") * 10.0 + F.when(F.col("turn") % 4 == 3, 20).otherwise(0)
    lines = t(spark, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), (-down).alias("y"), F.lit(10.0).alias("size"), (F.col("role") == "user").alias("bold"), F.lit("x").alias("text"))
    return Y.split_blocks(lines).select(F.col("page").alias("conv_id"), F.col("pos").alias("turn"), "block")


@query("SELECT count(*) AS pages, count(*) FILTER (WHERE text IS NULL) AS failed, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE length(trim(text)) <= 4 AND NOT regexp_matches(text, '[\\p{L}\\p{N}]')) AS noise FROM documents")
def A19_report_counters(spark, d):
    noise = A.noise(F.lit("p"), F.col("text")) & F.col("text").isNotNull()
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("text").isNull()).alias("failed"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(noise).alias("noise"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'until ' || strftime(hi, '%d.%m.%Y') END WHEN o_orderkey % 5 = 0 THEN 'from ' || strftime(lo, '%d.%m.%Y') ELSE strftime(lo, '%d.%m.%Y') || '–' || strftime(hi, '%d.%m.%Y') END AS shown FROM (SELECT o_orderkey, o_orderdate AS lo, o_orderdate + INTERVAL 30 DAY AS hi FROM orders)")
def E14_shown_dates(spark, d):
    from palimpsest.plans.registry import _bounds

    return _bounds(spark, d).select("o_orderkey", Y.shown_date(F.col("lo"), F.col("hi")).alias("shown"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CASE WHEN l_linenumber = 5 THEN 0.85 ELSE round((90 + l_linenumber) * 0.009, 2) END AS DOUBLE) AS conf FROM lineitem GROUP BY ALL")
def E11_inherited(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct().withColumn("conf", Y.inherited((F.col("l_linenumber") + 90) / 100))


@query("WITH n AS (SELECT s_suppkey AS nid, lpad(CAST(n_regionkey AS VARCHAR), 4, '0') || '.' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '.' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT nid, CASE WHEN substr(path, 6, 4)::INT % 2 = 0 THEN substr(path, 1, 9) ELSE substr(path, 1, 4) END AS dated FROM n")
def E12_dated_ancestor(spark, d):
    n = _tree(spark, d).select("content_id", "path", "nid")
    region, nation = n.select("content_id", F.substring("path", 1, 4).alias("path")).distinct(), n.where("cast(substring(path, 6, 4) AS int) % 2 = 0").select("content_id", F.substring("path", 1, 9).alias("path")).distinct()
    return D.dated_ancestor(n, region.unionByName(nation)).select("nid", F.col("above").alias("dated"))


@query("SELECT doc_id, CASE WHEN length(f) <= 220 THEN f ELSE regexp_replace(substr(f, 1, 220), '\\s+\\S*$', '') || '…' END AS about FROM (SELECT doc_id, trim(regexp_replace(regexp_extract(trim(text), '^((?s:.)*?)(\\n\\s*\\n|$)', 1), '\\s+', ' ', 'g')) AS f FROM documents)")
def G26_first_paragraph(spark, d):
    return t(spark, d, "documents").select("doc_id", R.first_paragraph(F.col("text")).alias("about"))


@query("SELECT event_id, ts >= TIMESTAMP '2024-01-08 10:00:00' AS rolling, ts >= TIMESTAMP '2024-01-09' AS today, ts >= TIMESTAMP '2024-01-08' AS week FROM events")
def F10_presets(spark, d):
    now = F.lit("2024-01-09 10:00:00").cast("timestamp_ntz")
    at = lambda k: R.preset_start(k, now).cast("timestamp_ntz")
    return t(spark, d, "events").select("event_id", (F.col("ts") >= at("24h")).alias("rolling"), (F.col("ts") >= at("today")).alias("today"), (F.col("ts") >= at("week")).alias("week"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts::DATE END AS day, event_id % 3 = 0 AS malformed FROM events")
def F13_parsed_bounds(spark, d):
    said = F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("2024-02-31")
    day, bad = R.parsed_bound(said)
    return t(spark, d, "events").select("event_id", day.alias("day"), bad.alias("malformed"))


@query("SELECT doc_id, toxic FROM labels WHERE quality = 0 AND toxic <= 0")
def F8_review_queue(spark, d):
    return t(spark, d, "labels").where("quality = 0 AND toxic <= 0").select("doc_id", "toxic")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET (SELECT ((count(*) + 19) // 20 - 1) * 20 FROM events)")
def O4_clamped_page(spark, d):
    e = t(spark, d, "events").select("event_id", "ts")
    return P.page(e, [F.desc("ts"), F.desc("event_id")], R.clamped_page(e.count(), 10**6), 20)


@query("SELECT doc_id, source, n_chars FROM documents")
def F16_projection(spark, d):
    return t(spark, d, "documents").select("doc_id", "source", "n_chars")


@query("SELECT p_partkey, 'r' || p_size AS tag FROM part ORDER BY p_size DESC, p_partkey DESC")
def O1_default_order(spark, d):
    return t(spark, d, "part").orderBy(F.desc("p_size"), F.desc("p_partkey")).select("p_partkey", F.concat(F.lit("r"), "p_size").alias("tag"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 0.25 ELSE 0.1 END AS DOUBLE) AS x0 FROM supplier")
def G17_box_or_ring(spark, d):
    point = lambda x: F.struct(F.lit(x).alias("x"), F.lit(x).alias("y"))
    box = F.when(F.col("s_suppkey") % 2 == 0, F.struct(*(F.lit(0.25).alias(c) for c in ("x0", "y0", "x1", "y1"))))
    return t(spark, d, "supplier").select("s_suppkey", R.box_or_ring(box, F.array(point(0.1), point(0.4)))["x0"].alias("x0"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE END AS day FROM orders")
def E17_created_day(spark, d):
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("D:19991231")
    return t(spark, d, "orders").select("o_orderkey", Y.created_day(said).alias("day"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'found' WHEN c_custkey % 3 = 1 THEN 'found' ELSE c_name END AS title FROM customer")
def K9_flipped_title(spark, d):
    title = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "scan.pdf").otherwise(F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", R.flipped_title(title, F.lit("scan.pdf"), F.lit("found")).alias("title"))


@query(PAGES + """, w AS (SELECT *, max(CASE WHEN d IS NOT NULL THEN number END) OVER b AS pn, last_value(d IGNORE NULLS) OVER b AS pd, min(CASE WHEN d IS NOT NULL THEN number END) OVER a AS nn, first_value(d IGNORE NULLS) OVER a AS nd
  FROM pg WINDOW b AS (PARTITION BY content_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY content_id ORDER BY number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, CASE WHEN content_id % 3 > 0 THEN DATE '1993-01-01' END AS lo, CASE WHEN content_id % 3 = 1 THEN DATE '1996-12-31' END AS hi FROM w)
SELECT content_id, number, CASE WHEN d IS NOT NULL THEN d WHEN pd IS NOT NULL AND nd IS NOT NULL THEN pd WHEN pd IS NOT NULL THEN CASE WHEN hi < pd OR lo IS NULL THEN pd ELSE greatest(pd, lo) END WHEN nd >= lo THEN lo END AS est_lo,
  CASE WHEN d IS NOT NULL THEN d WHEN pd IS NOT NULL AND nd IS NOT NULL THEN nd WHEN nd IS NOT NULL THEN CASE WHEN lo > nd OR hi IS NULL THEN nd ELSE least(nd, hi) END WHEN pd <= hi THEN hi END AS est_hi FROM q""")
def E10_narrowed_by_prior(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("date"))
    pages = t(spark, d, "orders").select(F.col("o_custkey").alias("content_id"), F.row_number().over(w).alias("number"), day.alias("lo"), day.alias("hi"))
    k, on = F.col("c_custkey"), lambda s: F.lit(s).cast("date")
    priors = t(spark, d, "customer").select(k.alias("content_id"), F.when(k % 3 > 0, on("1993-01-01")).alias("prior_lo"), F.when(k % 3 == 1, on("1996-12-31")).alias("prior_hi"))
    return D.interpolate(pages, priors).select("content_id", "number", "est_lo", "est_hi")
