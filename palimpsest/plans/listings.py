"""More registered queries: listing pages, feeds, projections, set operators and assembly expressions, with their DuckDB forms.

The tables stand in as in ``registry``; other analogues are named at their query.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import assembly as A
from palimpsest.functions import expressions as E
from palimpsest.operators import history as H
from palimpsest.plans.registry import BOUNDS, LAST, LEAVES, LOG, _bounds, _leaves, log, query, t

# --- filters and sorts of the listing pages


@query(BOUNDS + "SELECT o_orderkey, lo IS NOT NULL OR hi IS NOT NULL AS dated FROM b")
def F4_dated(spark, d):
    return _bounds(spark, d).select("o_orderkey", (F.col("lo").isNotNull() | F.col("hi").isNotNull()).alias("dated"))


@query("SELECT event_id, ts FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-09' ORDER BY ts DESC, event_id DESC")
def F6_feed(spark, d):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = t(spark, d, "events").where(F.col("event_type").isin("click", "view") & F.col("ts").between(at("2024-01-02"), at("2024-01-09")))
    return rows.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id"))


@query(LAST + "SELECT owner_id, count(*) AS n, count(*) FILTER (WHERE deleted) AS hidden FROM last GROUP BY 1")
def F11_live_or_deleted(spark, d):
    return H.latest(log(spark, d)).groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("deleted").alias("hidden"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END, ''), nullif(c_mktsegment, ''), CAST(c_custkey AS VARCHAR)) AS label FROM customer")
def F19_row_label(spark, d):
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("")
    return t(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(name, F.lit("")), F.nullif("c_mktsegment", F.lit("")), F.col("c_custkey").cast("string")).alias("label"))


@query("SELECT DISTINCT p_brand, lower(p_brand) AS folded FROM part")
def O14_folded_names(spark, d):
    return t(spark, d, "part").select("p_brand", F.lower("p_brand").alias("folded")).distinct().orderBy("folded", "p_brand")


# --- joins and aggregates


@query("SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def A1_filtered_counts(spark, d):
    live = t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return t(spark, d, "part").join(live, "p_partkey", "left").groupBy("p_brand").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(LOG + "SELECT obj_id, max(version) AS latest FROM log GROUP BY 1")
def A2_max_version(spark, d):
    return log(spark, d).groupBy("obj_id").agg(F.max("version").alias("latest"))


@query("SELECT count(*) AS n, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0")
def A6_summary_of_none(spark, d):
    return t(spark, d, "lineitem").where("l_quantity < 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("l_linenumber"), F.lit(0)).alias("total"))


@query("SELECT count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))) AS BIGINT) AS words FROM documents")
def A18_snapshot_stats(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^ \t\n\r]+)"), 1))
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(words).alias("words"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def J1_eager_parent(spark, d):
    nation = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return t(spark, d, "customer").join(nation, "c_nationkey", "left").select("c_custkey", "n_name")


@query("SELECT o_orderkey, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def J2_prefetch_children(spark, d):
    kids = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("k"))
    joined = F.array_join(F.transform("k", lambda x: x.cast("string")), ",")
    return t(spark, d, "orders").select("o_orderkey").join(kids, "o_orderkey", "left").select("o_orderkey", joined.alias("lines"))


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE upper(r_name) = upper('aSiA')")
def J17_any_case(spark, d):
    found = t(spark, d, "region").where(F.upper("r_name") == F.upper(F.lit("aSiA"))).select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return t(spark, d, "nation").join(found, "n_regionkey").select("n_nationkey", "r_name")


@query(LOG + "SELECT obj_id, version, lag(event_id) OVER (PARTITION BY obj_id ORDER BY version) AS before FROM log")
def J19_previous_version(spark, d):
    return log(spark, d).select("obj_id", "version", F.lag("event_id").over(Window.partitionBy("obj_id").orderBy("version")).alias("before"))


@query("SELECT 'customer' AS tab, c_custkey AS pk FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'part', p_partkey FROM part WHERE p_partkey = 5 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey = 5")
def J20_jump(spark, d):
    keys = {"customer": "c_custkey", "part": "p_partkey", "supplier": "s_suppkey"}
    parts = [t(spark, d, name).where(F.col(k) == 5).select(F.lit(name).alias("tab"), F.col(k).cast("long").alias("pk")) for name, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- set operators


@query("SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_brand, p_size FROM part WHERE p_partkey % 2 = 1")
def U2_node_difference(spark, d):
    p = t(spark, d, "part")
    side = lambda k: p.where(F.col("p_partkey") % 2 == k).select("p_brand", "p_size")
    return side(0).subtract(side(1))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def U6_ordered_distinct(spark, d):
    first = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(kinds, ",").alias("kinds"))


# --- text, pages and assembly


@query("SELECT p_partkey, p_size, concat_ws(',', CASE WHEN p_size >= 2 THEN '2' END, CASE WHEN p_size >= 3 THEN '3' END, CASE WHEN p_size >= 9 THEN '9' END) AS pages FROM part")
def S18_page_range(spark, d):
    pages = E.page_range(F.lit("9, 2-3,3"), F.col("p_size").cast("int"))
    return t(spark, d, "part").select("p_partkey", "p_size", F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"))


@query("""SELECT c_custkey, c_custkey || ',"' || c_name || ', ""of"" ' || c_mktsegment || '",' || c_mktsegment AS line FROM customer""")
def K10_csv_rows(spark, d):
    title = F.concat(F.col("c_name"), F.lit(', "of" '), F.col("c_mktsegment"))
    return t(spark, d, "customer").select("c_custkey", A.csv_row([F.col("c_custkey"), title, F.col("c_mktsegment")]).alias("line"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS ends, substr(text, 11, 20) AS slice FROM documents")
def G8_slice(spark, d):
    return t(spark, d, "documents").select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("ends"), F.substring("text", 11, 20).alias("slice"))


@query(LEAVES + "SELECT content_id, min_by(nid, (text_start, nid)) AS nid FROM o GROUP BY 1")
def G16_opening_leaf(spark, d):
    return _leaves(spark, d).groupBy("content_id").agg(F.min_by("nid", F.struct("text_start", "nid")).alias("nid"))


@query("""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, coalesce(CASE WHEN prev IS NULL THEN FALSE WHEN right(rtrim(prev, ' '), 1) = '-' THEN TRUE WHEN right(rtrim(prev, ' '), 1) IN ('.', '!', '?', ':', ';', '”', '"', '»', ')') THEN FALSE
  ELSE regexp_matches(substr(ltrim(text, ' '), 1, 1), '^[\\p{Ll}\\p{N}]') END, FALSE) AS goes_on FROM p""")
def X20_looks_continued(spark, d):
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = t(spark, d, "conversations").withColumn("prev", prev)
    return c.select("conv_id", "turn", A.continued(F.lit("p"), F.col("prev"), F.lit("p"), F.col("text")).alias("goes_on"))


@query("SELECT p_partkey, p_size < 20 AND p_partkey % 5 <> 0 AS dropped FROM part")
def X18_noise(spark, d):
    kind = F.when(F.col("p_partkey") % 5 == 0, "table").otherwise("p")
    text = F.when(F.col("p_size") < 20, " .. ").otherwise(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", A.noise(kind, text).alias("dropped"))
