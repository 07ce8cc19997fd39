"""More registered queries: datelines, pages put together, payloads, requests, and tenant exports.

The tables stand in as in ``registry``. Conversations are documents, two turns of which are a page.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import expressions as E
from palimpsest.operators import dating as T
from palimpsest.operators import history as H
from palimpsest.operators import pages as B
from palimpsest.operators import requests as Q
from palimpsest.operators import snapshot as Z
from palimpsest.plans.registry import LOG, log, query, t

# --- dates


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_orderkey % 27 = 3 AS heading, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN make_date(y, 5, d) WHEN 1 THEN make_date(y, m, d) WHEN 2 THEN make_date(y, 2, 1) WHEN 3 THEN CASE WHEN heading THEN make_date(y, m, d) END WHEN 4 THEN make_date(y, 1, 1) WHEN 5 THEN make_date(y, 3, d) WHEN 6 THEN make_date(y, m, d) WHEN 7 THEN make_date(y, 9, 1) END AS lo,
  CASE k WHEN 0 THEN make_date(y, 5, d) WHEN 1 THEN make_date(y, m, d) WHEN 2 THEN last_day(make_date(y, 2, 1)) WHEN 3 THEN CASE WHEN heading THEN make_date(y, m, d) END WHEN 4 THEN make_date(y, 12, 31) WHEN 5 THEN make_date(y, 3, d) WHEN 6 THEN make_date(y, m, d) WHEN 7 THEN make_date(y, 9, 30) END AS hi,
  CAST(CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN CASE WHEN heading THEN 0.95 END WHEN 4 THEN 0.7 WHEN 5 THEN 0.9 WHEN 6 THEN 0.85 WHEN 7 THEN 0.8 END AS DOUBLE) AS conf FROM o""")
def E6_datelines(spark, d):
    k, at = F.col("o_orderkey") % 9, F.col("o_orderdate")
    y, day = F.year(at).cast("string"), F.dayofmonth(at).cast("string")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    iso = F.date_format(at, "yyyy-MM-dd")
    text = (
        F.when(k == 0, say("Altdorf, den ", day, ". Mai ", y, "\nand more")).when(k == 1, say("  ", iso, " (copy)")).when(k == 2, say("31. Februar ", y)).when(k == 3, say("the letter was written on ", iso))
        .when(k == 4, say("Anno ", y, " ")).when(k == 5, say("March ", day, "th, ", y)).when(k == 6, F.date_format(at, "dd.MM.yyyy")).when(k == 7, say("99.99.", y, " Sept. ", y)).otherwise(say("It was in ", y, " that they met."))
    )
    made = T.datelines(t(spark, d, "orders").select("o_orderkey", text.alias("text"), (F.col("o_orderkey") % 27 == 3).alias("heading")))
    return made.select("o_orderkey", "dateline.lo", "dateline.hi", "dateline.conf")


@query("SELECT doc, month FROM (SELECT o_orderkey AS doc, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN 9 WHEN 3 THEN month(o_orderdate) END AS month FROM orders)")
def E7_month_numbers(spark, d):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "MÄRZ").when(k == 1, "dec.").when(k == 2, "Sept").when(k == 3, F.date_format("o_orderdate", "MM")).otherwise("Monat")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), T.month_number(name).alias("month"))


@query("""WITH p AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS path, DATE '1990-01-01' + CAST(n_nationkey AS INT) AS lo, DATE '1990-01-01' + CAST(n_nationkey AS INT) + 100 AS hi FROM nation),
c AS (SELECT lpad(CAST(s_nationkey AS VARCHAR), 4, '0') || '.' || CAST(s_suppkey AS VARCHAR) AS path, DATE '1990-01-01' + CAST(s_suppkey % 300 AS INT) AS lo, DATE '1990-01-06' + CAST(s_suppkey % 300 AS INT) AS hi, lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS above FROM supplier)
SELECT c.path, 'parent' AS problem FROM c JOIN p ON above = p.path WHERE c.lo < p.lo OR c.hi > p.hi UNION ALL SELECT path, 'content' FROM (SELECT path, hi FROM c UNION ALL SELECT path, hi FROM p) WHERE hi > DATE '1990-09-01'""")
def E13_dating_violations(spark, d):
    start = F.lit("1990-01-01").cast("date")
    top = F.lpad(F.col("n_nationkey").cast("string"), 4, "0")
    n = t(spark, d, "nation").select(top.alias("path"), F.date_add(start, F.col("n_nationkey").cast("int")).alias("lo"), F.date_add(start, (F.col("n_nationkey") + 100).cast("int")).alias("hi"))
    off = (F.col("s_suppkey") % 300).cast("int")
    s = t(spark, d, "supplier").select(F.concat(F.lpad(F.col("s_nationkey").cast("string"), 4, "0"), F.lit("."), F.col("s_suppkey").cast("string")).alias("path"), F.date_add(start, off).alias("lo"), F.date_add(start, off + 5).alias("hi"))
    whole = spark.range(1).select(F.lit(1).alias("content_id"), start.alias("lo"), F.lit("1990-09-01").cast("date").alias("hi"))
    return T.violations(n.unionByName(s).withColumn("content_id", F.lit(1)), whole).select("path", "problem")


@query()  # held against plain Python in tests/test_dating.py
def E8_dated_nodes(spark, d):
    plan = _plan(spark, d)
    said = F.when(F.col("nid") % 8 == 3, F.concat(F.lit("Altdorf, "), F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("nid") * 3).cast("int")), "dd.MM.yyyy")))
    plan = plan.withColumn("text", F.when(F.col("leaf"), F.coalesce(said, F.lit("text"))))
    spots = plan.where("leaf").select("content_id", "nid", F.ceil(F.col("nid") / 4).cast("int").alias("page"))
    pages = spots.select("content_id", F.col("page").alias("number")).distinct()
    priors = plan.select("content_id").distinct().select("content_id", F.when(F.col("content_id") % 3 == 0, "1990").alias("hint"), F.lit(None).cast("string").alias("metadata"))
    guesses = plan.where("nid % 11 = 5").select("content_id", "nid", F.lit("1990-02-01").cast("date").alias("lo"), F.lit("1990-02-28").cast("date").alias("hi"), F.lit(0.6).alias("conf"))
    nodes, _, _ = T.dated(plan, spots, pages, priors, guesses)
    return nodes.select("content_id", "nid", "date.lo", "date.hi", "date.conf", "date.source")


# --- pages


BLOCKS = """WITH b AS (SELECT conv_id AS content_id, turn // 2 AS page, turn AS pos, CASE WHEN conv_id % 11 = 0 AND turn % 2 = 0 THEN 'li' ELSE 'p' END AS kind,
  CASE (turn + conv_id) % 7 WHEN 0 THEN 'runs on' WHEN 1 THEN 'the hy-' WHEN 2 THEN 'phen goes' WHEN 3 THEN 'It ends.' WHEN 4 THEN '~ .' WHEN 5 THEN '   ' ELSE 'and so ' || turn END AS text,
  CASE WHEN (turn + conv_id) % 13 = 5 THEN 'page-number' END AS furniture FROM conversations),
pg AS (SELECT content_id, page, (content_id + page) % 9 = 4 AS failed FROM (SELECT DISTINCT content_id, page FROM b)),
j AS (SELECT b.*, CASE WHEN furniture IS NOT NULL THEN 'furniture' WHEN trim(text) = '' THEN 'dropped' WHEN text = '~ .' THEN 'noise' ELSE 'kept' END AS verdict FROM b JOIN pg USING (content_id, page) WHERE NOT failed) """


def _blocks(spark, d):
    s = (F.col("turn") + F.col("conv_id")) % 7
    text = F.when(s == 0, "runs on").when(s == 1, "the hy-").when(s == 2, "phen goes").when(s == 3, "It ends.").when(s == 4, "~ .").when(s == 5, "   ").otherwise(F.concat(F.lit("and so "), F.col("turn").cast("string")))
    b = t(spark, d, "conversations").select(
        F.col("conv_id").alias("content_id"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("pos"), F.when((F.col("conv_id") % 11 == 0) & (F.col("turn") % 2 == 0), "li").otherwise("p").alias("kind"),
        text.alias("text"), F.when((F.col("turn") + F.col("conv_id")) % 13 == 5, "page-number").alias("furniture"), F.lit(None).cast("string").alias("aside"), F.when(F.col("conv_id") % 17 == 3, F.col("turn") % 4 == 2).alias("continues"),
    )
    pages = b.select("content_id", "page").distinct().withColumn("failed", (F.col("content_id") + F.col("page")) % 9 == 4)
    return b, pages


@query(BLOCKS + ", n AS (SELECT content_id, page, count(*) FILTER (WHERE verdict = 'furniture') AS furniture, count(*) FILTER (WHERE verdict = 'dropped') AS dropped, count(*) FILTER (WHERE verdict = 'noise') AS noise, count(*) FILTER (WHERE verdict = 'kept') AS kept FROM j GROUP BY 1, 2) SELECT content_id, count(*) AS pages, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE NOT failed AND coalesce(kept, 0) = 0) AS empty, CAST(coalesce(sum(furniture), 0) AS BIGINT) AS furniture, CAST(coalesce(sum(dropped), 0) AS BIGINT) AS dropped, CAST(coalesce(sum(noise), 0) AS BIGINT) AS noise, CAST(coalesce(sum(kept), 0) AS BIGINT) AS kept FROM pg LEFT JOIN n USING (content_id, page) GROUP BY 1")
def X17_pages_read(spark, d):
    b, pages = _blocks(spark, d)
    return B.report(B.judged(b, pages), pages)


@query(BLOCKS + "SELECT content_id, page, min_by(trim(text), pos) AS label FROM j WHERE verdict = 'furniture' AND trim(text) <> '' GROUP BY 1, 2")
def X17_page_labels(spark, d):
    return B.labels(B.judged(*_blocks(spark, d)))


JOINED = BLOCKS + """, r AS (SELECT content_id, page, row_number() OVER (PARTITION BY content_id ORDER BY page) AS nth FROM pg WHERE NOT failed),
l AS (SELECT j.*, nth, lag(nth) OVER w AS pn, lag(kind) OVER w AS pk, rtrim(lag(text) OVER w) AS pt FROM j JOIN r USING (content_id, page) WHERE verdict = 'kept' WINDOW w AS (PARTITION BY content_id ORDER BY page, pos)),
g AS (SELECT *, coalesce(pn = nth - 1 AND kind = pk AND CASE WHEN content_id % 17 = 3 THEN pos % 4 = 2 WHEN pt LIKE '%-' THEN TRUE WHEN pt LIKE '%.' THEN FALSE ELSE regexp_matches(text, '^[a-z0-9]') END, FALSE) AS goes_on FROM l),
i AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER w AS item, coalesce(lead(goes_on) OVER w, FALSE) AS ahead FROM g WINDOW w AS (PARTITION BY content_id ORDER BY page, pos)),
f AS (SELECT *, CASE WHEN ahead AND text LIKE '%-' THEN text[:-2] WHEN ahead THEN text || ' ' ELSE text END AS piece, length(text) - CASE WHEN ahead AND text LIKE '%-' THEN 1 ELSE 0 END AS own FROM i) """


@query(JOINED + "SELECT content_id, CAST(item AS BIGINT) AS item, min_by(kind, pos) AS kind, string_agg(piece, '' ORDER BY page, pos) AS text, min(page) AS first_page, count(*) AS n_fragments FROM f GROUP BY 1, 2")
def X19_joined_pages(spark, d):
    b, pages = _blocks(spark, d)
    return B.items(B.fragments(B.judged(b, pages).where("verdict = 'kept'"), pages))


@query(JOINED + ", s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY content_id, item ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f) SELECT content_id, page, pos, CAST(start AS BIGINT) AS start, CAST(start + own AS BIGINT) AS stop FROM s")
def X22_fragments(spark, d):
    b, pages = _blocks(spark, d)
    return B.fragments(B.judged(b, pages).where("verdict = 'kept'"), pages).select("content_id", "page", "pos", "start", "stop")


@query("SELECT conv_id, to_json(list({'turn': turn, 'role': role, 'text': text} ORDER BY turn))::VARCHAR AS payload FROM (SELECT conv_id, turn, role, length(text) AS text FROM conversations) GROUP BY 1")
def K14_raw_payload(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("text"))
    return B.payload(c, "conv_id", "turn", ["text", "role"])


@query("SELECT o_custkey AS content_id, to_json(list({'nid': o_orderkey, 'status': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS payload FROM orders GROUP BY 1")
def K15_nodes_payload(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("content_id"), F.col("o_orderkey").alias("nid"), F.col("o_orderstatus").alias("status"))
    return B.payload(o, "content_id", "nid", ["nid", "status"])


# --- requests


def _wrote(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("obj_id"), F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderkey") % 7 != 0, day("o_orderdate")).alias("context_id"), F.col("o_orderstatus").alias("status"))
    lines = t(spark, d, "lineitem").select(F.col("l_partkey").alias("obj_id"), F.col("l_orderkey").alias("event_id"), day("l_shipdate").alias("context_id"))
    return Q.union_events({"orders": orders, "lineitem": lines})


WROTE = "WITH ev AS (SELECT 'orders' AS tab, o_custkey AS obj_id, o_orderkey AS event_id, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS context_id, o_orderstatus AS status FROM orders UNION ALL SELECT 'lineitem', l_partkey, l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), NULL FROM lineitem) "


@query(WROTE + "SELECT tab, status, count(*) AS n, count(DISTINCT obj_id) AS objects FROM ev GROUP BY 1, 2")
def U1_union_of_events(spark, d):
    return _wrote(spark, d).groupBy("tab", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("obj_id").alias("objects"))


@query(WROTE + ", e AS (SELECT strftime(l_shipdate + INTERVAL 3 DAY, '%Y-%m-%d') AS context_id, count(*) AS edges FROM lineitem GROUP BY 1) SELECT context_id, count(*) AS versions, count(DISTINCT tab) AS tabs, coalesce(max(edges), 0) AS edges FROM ev LEFT JOIN e USING (context_id) WHERE context_id IS NOT NULL GROUP BY 1")
def L15_writes_of_requests(spark, d):
    edges = t(spark, d, "lineitem").select(F.date_format(F.col("l_shipdate") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd").alias("context_id"))
    return Q.writes(_wrote(spark, d), edges)


CONTEXTS = ", ctx AS (SELECT context_id, min(event_type) AS label, min(event_id) AS request FROM log WHERE context_id IS NOT NULL AND obj_id % 4 <> 1 GROUP BY 1) "


def _contexts(rows):
    return rows.where("context_id IS NOT NULL AND obj_id % 4 <> 1").groupBy("context_id").agg(F.min("event_type").alias("label"), F.min("event_id").alias("request"))


@query(LOG + CONTEXTS + "SELECT obj_id, label FROM (SELECT obj_id, max_by(coalesce(context_id, ''), version) AS context_id FROM log GROUP BY 1) LEFT JOIN ctx USING (context_id)")
def L16_operation_of_rows(spark, d):
    rows = log(spark, d)
    return Q.with_context(H.latest(rows).select("obj_id", "context_id"), _contexts(rows), ["label"]).select("obj_id", "label")


@query(LOG + CONTEXTS + "SELECT event_id, label, request FROM log LEFT JOIN ctx USING (context_id)")
def L17_writers_of_revisions(spark, d):
    rows = log(spark, d)
    return Q.with_context(rows.select("event_id", "context_id"), _contexts(rows), ["label", "request"]).select("event_id", "label", "request")


@query(LOG + "SELECT context_id, min(ts) AS \"at\", min_by(event_id, (ts, event_id)) AS edge_id, count(*) AS n FROM log GROUP BY context_id, CASE WHEN context_id IS NULL THEN event_id END")
def A14_edges_by_context(spark, d):
    return Q.edges_by_context(log(spark, d).select(F.col("event_id").alias("edge_id"), "context_id", F.col("ts").alias("created")))


@query("SELECT 'line.shipped' AS event_type, l_orderkey AS source_id, l_shipdate AS \"at\" FROM lineitem UNION ALL SELECT 'order.placed', o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P'")
def P7_backfill(spark, d):
    known = Q.Projections()
    known.add("order.placed", lambda df: df.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("at")), "orders but for partial ones")
    known.add("line.shipped", lambda df: df.select(F.col("l_orderkey").alias("source_id"), F.col("l_shipdate").alias("at")))
    return known.backfill({"order.placed": t(spark, d, "orders"), "line.shipped": t(spark, d, "lineitem")})


# --- tenants


@query("SELECT 'customer' AS tab, to_json({'c_custkey': c_custkey, 'c_name': 'name', 'owner_id': c_nationkey})::VARCHAR AS row FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'supplier', to_json({'owner_id': s_nationkey, 's_name': s_name, 's_suppkey': s_suppkey})::VARCHAR FROM supplier WHERE s_nationkey = 3")
def K11_tenant_export(spark, d):
    tables = {"customer": t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("owner_id")), "supplier": t(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("owner_id"))}
    return Q.exported(tables, 3, {"c_name": F.lit("name")})


@query("SELECT p_partkey, p_partkey % 6 IN (0, 5) AS fine FROM part")
def K12_unpackable(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_brand")
    name = F.when(k == 0, F.concat(F.lit("a/..b/"), n)).when(k == 1, F.concat(F.lit("/"), n)).when(k == 2, F.concat(F.lit("a/../../"), n)).when(k == 3, F.concat(F.lit("a\\..\\"), n)).when(k == 4, F.concat(F.lit("c:"), n)).otherwise(n)
    return t(spark, d, "part").select("p_partkey", Q.unpackable(name).alias("fine"))


@query("SELECT DISTINCT owner_id, key FROM (SELECT user_id % 3 AS owner_id, CAST(event_id // 3 AS VARCHAR) AS key FROM events WHERE event_type <> 'view' UNION ALL SELECT o_custkey % 3, CAST(o_orderkey // 5 AS VARCHAR) FROM orders)")
def T7_tenant_files(spark, d):
    e = t(spark, d, "events").select((F.col("user_id") % 3).alias("owner_id"), F.when(F.col("event_type") != "view", F.floor(F.col("event_id") / 3).cast("string")).otherwise("").alias("thumb"))
    o = t(spark, d, "orders").select((F.col("o_custkey") % 3).alias("owner_id"), F.floor(F.col("o_orderkey") / 5).cast("string").alias("blob"))
    return Q.files_of({"events": (e, "thumb"), "orders": (o, "blob")})


@query("SELECT n_name AS tab, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' WHEN n_nationkey % 4 = 1 THEN 'changed' ELSE 'extra' END AS problem FROM nation WHERE n_nationkey % 4 <> 3")
def T4_policy_drift(spark, d):
    n, k = t(spark, d, "nation"), F.col("n_nationkey") % 4
    wanted = n.where(k.isin(0, 1, 3)).select(F.col("n_name").alias("tab"), F.lit("owner").alias("policy"))
    found = n.where(k.isin(1, 2, 3)).select(F.col("n_name").alias("tab"), F.when(k == 1, "none").otherwise("owner").alias("policy"))
    return Q.drift(wanted, found)


@query("SELECT p_partkey, p_brand || '|é' || '|' || p_name AS tags FROM part")
def G19_tag_list(spark, d):
    tags = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("é"), F.lower("p_brand"), F.lit(" "), F.lit("É"), "p_name")
    return t(spark, d, "part").select("p_partkey", F.array_join(Q.normalised_tags(tags), "|").alias("tags"))


# --- trees as they are stored: a conversation's sections of two turns each


TURNS = """WITH lf AS (SELECT conv_id AS content_id, lpad(CAST(turn // 2 + 1 AS VARCHAR), 4, '0') AS up, turn % 2 + 1 AS k, CASE WHEN turn % 5 = 2 THEN 'pre' WHEN turn % 7 = 0 THEN 'h2' ELSE 'p' END AS tag, coalesce(text, '') AS text FROM conversations),
n AS (SELECT content_id, up || '.' || lpad(CAST(k AS VARCHAR), 4, '0') AS path, tag, text FROM lf UNION ALL SELECT DISTINCT content_id, up, 'section', NULL FROM lf),
p AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY path) AS nid, text IS NOT NULL AS leaf FROM n),
o AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY content_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS text_start FROM p),
h AS (SELECT *, '<' || tag || ' data-nid="' || nid || '">' || CASE WHEN leaf THEN CASE tag WHEN 'pre' THEN chr(10) ELSE '' END || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>' ELSE '' END AS piece FROM p),
s AS (SELECT content_id, substr(path, 1, 4) AS up, string_agg(piece, '' ORDER BY path) || '</section>' AS part FROM h GROUP BY 1, 2),
d AS (SELECT content_id, string_agg(part, '' ORDER BY up) AS html FROM s GROUP BY 1) """


def _plan(spark, d):
    seg = lambda c: F.lpad(c.cast("string"), 4, "0")
    up = seg(F.floor(F.col("turn") / 2) + 1)
    tag = F.when(F.col("turn") % 5 == 2, "pre").when(F.col("turn") % 7 == 0, "h2").otherwise("p")
    turns = t(spark, d, "conversations").withColumn("up", up)
    leaves = turns.select(F.col("conv_id").alias("content_id"), F.concat_ws(".", "up", seg(F.col("turn") % 2 + 1)).alias("path"), tag.alias("tag"), F.coalesce("text", F.lit("")).alias("text"))
    tops = turns.select(F.col("conv_id").alias("content_id"), F.col("up").alias("path")).distinct().select("content_id", "path", F.lit("section").alias("tag"), F.lit(None).cast("string").alias("text"))
    return Z.planned(leaves.unionByName(tops))


@query(TURNS + "SELECT content_id, path, nid, leaf, CAST(text_start AS BIGINT) AS text_start, CAST(CASE WHEN leaf THEN text_start + length(text) ELSE max(text_start + length(text)) OVER (PARTITION BY content_id, substr(path, 1, 4)) END AS BIGINT) AS text_end FROM o")
def X30_plan(spark, d):
    return _plan(spark, d).select("content_id", "path", "nid", "leaf", "text_start", "text_end")


@query("SELECT p_partkey, unnest(list_filter([CASE WHEN p_size % 5 = 0 THEN 'tag' END, CASE WHEN p_size % 3 = 0 THEN 'both' END, CASE WHEN p_size % 7 = 0 THEN 'siblings' END], lambda x: x IS NOT NULL)) AS problem FROM part")
def X30_plan_problems(spark, d):
    k = F.col("p_size")
    tree = t(spark, d, "part").select("p_partkey", k, F.col("p_partkey").alias("content_id"), F.when(k % 7 == 0, "10000").otherwise("0001").alias("path"))
    top = tree.select("content_id", "path", F.when(k % 5 == 0, "script").otherwise("section").alias("tag"), F.when(k % 3 == 0, "x").alias("text"))
    low = tree.select("content_id", F.concat("path", F.lit(".0001")).alias("path"), F.lit("p").alias("tag"), F.lit("y").alias("text"))
    found = Z.plan_problems(Z.planned(top.unionByName(low)))
    return found.where("nid = 1").select(F.col("content_id").alias("p_partkey"), "problem")


@query(TURNS + "SELECT content_id, html FROM d")
def X32_rendered(spark, d):
    return Z.rendered(_plan(spark, d))


@query(TURNS + "SELECT content_id, nid, html_start, html_start + CASE WHEN leaf THEN length(piece) ELSE strpos(substr(html, html_start + 1), '</section>') + 9 END AS html_end FROM (SELECT h.*, html, strpos(html, ' data-nid=\"' || nid || '\">') - length(tag) - 2 AS html_start FROM h JOIN d USING (content_id))")
def X34_located(spark, d):
    return Z.located(_plan(spark, d))


@query(TURNS + "SELECT content_id, nid, 'slice' AS problem FROM p WHERE nid % 10 = 3 UNION ALL SELECT content_id, nid, 'parent' FROM p WHERE leaf AND nid % 10 = 3 AND path LIKE '%.0002'")
def X36_enclosure(spark, d):
    plan = _plan(spark, d)
    off = F.when(F.col("nid") % 10 == 3, 1).otherwise(0)  # a node is stored one place off
    kept = plan.join(Z.located(plan), ["content_id", "nid"])
    last = F.col("leaf") & F.col("path").endswith(".0002")
    moved = kept.withColumns({"html_start": F.col("html_start") + off, "text_end": F.col("text_end") + F.when(last, off).otherwise(0)})
    return Z.enclosure_problems(moved, Z.rendered(plan))


@query("""WITH i AS (SELECT conv_id AS content_id, turn AS item, CASE WHEN turn % 6 = 0 THEN 'h2' WHEN turn % 6 < 3 THEN 'li' WHEN turn % 6 = 3 THEN 'figcaption' WHEN turn % 6 = 4 THEN 'figure' ELSE CASE WHEN conv_id % 2 = 0 THEN 'figcaption' ELSE 'p' END END AS kind FROM conversations),
g AS (SELECT *, lag(kind) OVER w AS before FROM i WINDOW w AS (PARTITION BY content_id ORDER BY item))
SELECT content_id, item, CASE WHEN kind = 'li' THEN 'list' WHEN kind = 'h2' THEN 'heading' WHEN kind = 'figure' OR (kind = 'figcaption' AND lead(kind) OVER w = 'figure') THEN 'figure' ELSE 'block' END AS shape,
  sum(CASE WHEN kind = 'li' AND before = 'li' THEN 0 WHEN kind = 'figure' AND before = 'figcaption' THEN 0 ELSE 1 END) OVER (PARTITION BY content_id ORDER BY item)::BIGINT AS grp FROM g WINDOW w AS (PARTITION BY content_id ORDER BY item)""")
def X24_groups(spark, d):
    k = F.col("turn") % 6
    kind = F.when(k == 0, "h2").when(k < 3, "li").when(k == 3, "figcaption").when(k == 4, "figure").when(F.col("conv_id") % 2 == 0, "figcaption").otherwise("p")
    return Z.grouped(t(spark, d, "conversations").select(F.col("conv_id").alias("content_id"), F.col("turn").alias("item"), kind.alias("kind"))).select("content_id", "item", "shape", "grp")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'name' || chr(9) || 'size' || chr(10) ELSE '' END || p_name || chr(9) || p_size || chr(10) || CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN '' ELSE CASE WHEN p_size % 3 = 0 THEN 'name' || chr(9) || 'size' || chr(10) ELSE 'Name' || chr(9) || 'size' || chr(10) END END || p_brand || chr(9) AS text FROM part")
def X23_table_appended(spark, d):
    row = lambda a, b: F.array(a, b)
    size, head = F.col("p_size"), row(F.lit("name"), F.lit("size"))
    first = row(F.col("p_name"), size.cast("string"))
    table = Z.table_of(F.when(size % 2 == 0, F.array(head, first)).otherwise(F.array(first)), size % 2 == 0)
    more = Z.table_of(F.array(F.when(size % 3 == 0, head).otherwise(row(F.lit("Name"), F.lit("size"))), row(F.col("p_brand"), F.lit(None).cast("string"))), size % 5 == 0)
    return t(spark, d, "part").select("p_partkey", Z.table_text(Z.table_appended(table, more)).alias("text"))


@query("SELECT p_partkey FROM part WHERE p_size = 1")
def F15_subtree(spark, d):
    path = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("string")).otherwise(F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    return t(spark, d, "part").where(E.in_subtree(path, F.lit("1"))).select("p_partkey")
