"""Registered queries of attempts, resuming and the order of saving, with their DuckDB forms: a user's events as those of a content."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from palimpsest.operators import saving
from palimpsest.plans.registry import query, t
from palimpsest.streaming import lifecycle as Y

KINDS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'beat' END"


@query(f"""WITH e AS (SELECT user_id AS content_id, ts, event_id, {KINDS} AS kind FROM events),
b AS (SELECT *, lag(ts) OVER w AS pt, lag(kind) OVER w AS pk FROM e WINDOW w AS (PARTITION BY content_id ORDER BY ts, event_id)),
a AS (SELECT *, sum(CASE WHEN pt IS NULL OR pk IN ('succeeded', 'failed') OR ts > pt + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY content_id ORDER BY ts, event_id) AS attempt FROM b),
g AS (SELECT content_id, attempt, min(ts) AS started, max(ts) AS last_seen, max_by(kind, (ts, event_id)) AS last, bool_and(kind = 'pending') AS waiting FROM a GROUP BY 1, 2)
SELECT content_id, attempt::INTEGER AS attempt, started, last_seen, CASE WHEN last IN ('succeeded', 'failed') THEN last WHEN lead(attempt) OVER (PARTITION BY content_id ORDER BY attempt) IS NOT NULL OR last_seen + INTERVAL 12 HOUR < (SELECT max(ts) FROM events) THEN 'stale' WHEN waiting THEN 'pending' ELSE 'running' END AS status FROM g""")
def X38_attempts(spark, d):
    e = t(spark, d, "events")
    said = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("beat")
    now = F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    return Y.attempts(e.select(F.col("user_id").alias("content_id"), F.col("ts").alias("at"), said.alias("kind"), F.col("event_id").alias("seq")), now, dt.timedelta(hours=12))


def _progress(spark, d):
    c = t(spark, d, "conversations").select(F.col("conv_id").alias("content_id"), F.col("turn").alias("page"), "text")
    raw = F.to_json(F.struct(F.length("text").alias("chars")))
    tries = c.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).where((F.col("page") % 3 != 2) & ((F.col("attempt") == 2) | (F.col("page") < 3)))
    broken = (F.col("content_id") + F.col("page") + F.col("attempt")) % 4 == 0
    return c, tries.select("content_id", "attempt", "page", F.when(broken, F.substring(raw, 1, 5)).otherwise(raw).alias("raw"))


@query("""WITH c AS (SELECT conv_id, turn, (turn % 3 <> 2 AND ((turn < 3 AND (conv_id + turn + 1) % 4 <> 0) OR (conv_id + turn + 2) % 4 <> 0)) AS done FROM conversations)
SELECT conv_id AS content_id, count(*) AS pages, count(*) FILTER (WHERE done) AS read FROM c GROUP BY 1""")
def P18_pages_read(spark, d):
    pages, progress = _progress(spark, d)
    return Y.counted(pages, Y.read_so_far(progress, "chars int"))


@query("SELECT conv_id AS content_id, turn AS page, length(text)::INTEGER AS chars FROM conversations")
def X39_resumed(spark, d):
    """What two broken attempts read, and the pages that a third reads because they are open, are one clean run."""
    pages, progress = _progress(spark, d)
    done = Y.read_so_far(progress, "chars int")
    rest = Y.open_pages(pages, done).select("content_id", "page", F.length("text").alias("chars"))
    return done.select("content_id", "page", "payload.chars").unionByName(rest)


@query("SELECT 'R' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation UNION ALL SELECT 'C' || c_custkey, 2 FROM customer UNION ALL SELECT 'O' || o_orderkey, 3 FROM orders")
def K7_save_levels(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), c)
    tables = [("region", "R", "r_regionkey", None, None), ("nation", "N", "n_nationkey", "R", "n_regionkey"), ("customer", "C", "c_custkey", "N", "c_nationkey"), ("orders", "O", "o_orderkey", "C", "o_custkey")]
    nodes = refs = None
    for table, letter, key, other, foreign in tables:
        rows = t(spark, d, table)
        own = rows.select(name(letter, key).alias("node"))
        nodes = own if nodes is None else nodes.unionByName(own)
        if other:
            needs = rows.select(name(letter, key).alias("node"), name(other, foreign).alias("needs"))
            refs = needs if refs is None else refs.unionByName(needs)
    return saving.save_levels(nodes, refs)
