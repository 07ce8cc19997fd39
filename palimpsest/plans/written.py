"""Registered queries of documents as HTML and back, with their DuckDB forms: conversations as documents, their turns as blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import snapshot as Z
from palimpsest.operators import written as V
from palimpsest.plans import assembled as P
from palimpsest.plans.registry import log, query, t
from palimpsest.sources import markup as M
from palimpsest.sources import snapshots as S

LINES = "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"
READ = P.TURNS + f", r AS (SELECT content_id, nid, path, tag, CASE WHEN NOT leaf THEN '' WHEN tag = 'pre' THEN chr(10) || text ELSE {LINES} END AS text, leaf FROM p) "


def _read(spark, d):
    return M.own_rows(Z.rendered(P._plan(spark, d)))


@query(READ + "SELECT content_id, nid AS pos, path, tag, text FROM r")
def X16_own_rows(spark, d):
    return _read(spark, d).select("content_id", F.explode("rows").alias("r")).select("content_id", F.col("r.pos").cast("long").alias("pos"), "r.path", "r.tag", "r.text")


@query(READ + "SELECT content_id, nid AS pos, tag AS kind, text, CASE tag WHEN 'h2' THEN 2 END AS level FROM r WHERE leaf")
def X15_page_blocks(spark, d):
    return V.blocks_of(_read(spark, d)).select("content_id", F.col("pos").cast("long").alias("pos"), "kind", "text", "level")


@query(READ + "SELECT content_id, '<' || tag || '> does not say which page it is on' AS problem, count(*) AS n FROM r WHERE leaf GROUP BY 1, 2")
def X27_reviewed(spark, d):
    return V.reviewed(_read(spark, d)).groupBy("content_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(READ + ", hd AS (SELECT content_id, substr(path, 1, 4) AS up FROM r WHERE tag = 'h2' AND text <> '' GROUP BY 1, 2) SELECT r.content_id, path, tag, CASE WHEN leaf THEN text END AS text, CASE WHEN tag = 'h2' OR (tag = 'section' AND hd.up IS NOT NULL) THEN 2 END AS level FROM r LEFT JOIN hd ON hd.content_id = r.content_id AND hd.up = r.path WHERE NOT leaf OR text <> ''")
def X28_nodes(spark, d):
    return V.extracted(_read(spark, d)).select("content_id", "path", "tag", "text", "level")


ITEMS = f"""WITH i AS (SELECT conv_id AS content_id, turn AS item, CASE WHEN turn % 6 = 0 THEN CASE WHEN turn % 4 = 0 THEN 'h2' ELSE 'h3' END WHEN turn % 6 < 3 THEN 'li' WHEN turn % 6 = 3 THEN 'figcaption' WHEN turn % 6 = 4 THEN 'figure' ELSE 'p' END AS kind, {LINES} AS text, turn // 2 + 1 AS page FROM conversations WHERE text <> ''),
o AS (SELECT *, CASE WHEN kind = 'figcaption' AND lead(kind) OVER w = 'figure' THEN item + 1.5 ELSE item END AS place, kind = 'li' AND NOT coalesce(lag(kind) OVER w = 'li', FALSE) AS first FROM i WINDOW w AS (PARTITION BY content_id ORDER BY item)) """


@query(ITEMS + "SELECT content_id, CAST(sum(CASE WHEN kind[1] = 'h' OR first THEN 2 ELSE 1 END) OVER (PARTITION BY content_id ORDER BY place) AS BIGINT) AS nid, kind AS tag, CASE WHEN kind = 'figure' THEN NULL ELSE text END AS text, page FROM o")
def X29_round_trip(spark, d):
    k = F.col("turn") % 6
    kind = F.when(k == 0, F.when(F.col("turn") % 4 == 0, "h2").otherwise("h3")).when(k < 3, "li").when(k == 3, "figcaption").when(k == 4, "figure").otherwise("p")
    page = (F.floor(F.col("turn") / 2) + 1).cast("int")
    part = F.struct(page.alias("page"), F.lit(None).cast(V.BOX).alias("box"), F.lit(0).alias("start"), F.length("text").alias("stop"))
    c = t(spark, d, "conversations").where("text <> ''")
    items = c.select(F.col("conv_id").alias("content_id"), F.col("turn").alias("item"), kind.alias("kind"), "text", F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(False).alias("header"), F.lit(None).cast("string").alias("aside"), F.array(part).alias("parts"))
    nodes = V.read_back(V.serialised(items)).where(~F.col("tag").isin("section", "ul"))
    return nodes.select("content_id", F.col("pos").cast("long").alias("nid"), "tag", "text", F.col("regions")[0]["page"].cast("long").alias("page"))


WHOLE = P.JOINED + """, s AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY content_id, item ORDER BY page, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f),
it AS (SELECT content_id, item, min_by(kind, pos) AS kind, string_agg(piece, '' ORDER BY page, pos) AS text, string_agg(page::INT || ';;' || start::INT || ',' || (start + own)::INT, '|' ORDER BY page, pos) AS box, list(page::INT ORDER BY page) AS on_pages FROM s GROUP BY 1, 2),
wg AS (SELECT *, sum(CASE WHEN kind = 'li' AND before = 'li' THEN 0 ELSE 1 END) OVER (PARTITION BY content_id ORDER BY item) AS grp FROM (SELECT *, lag(kind) OVER (PARTITION BY content_id ORDER BY item) AS before FROM it)),
n AS (SELECT *, row_number() OVER (PARTITION BY content_id, grp ORDER BY item) AS nth, count(*) OVER (PARTITION BY content_id, grp) AS size FROM wg),
k AS (SELECT *, sum(CASE WHEN kind = 'li' AND nth = 1 THEN 2 ELSE 1 END) OVER (PARTITION BY content_id ORDER BY item)::BIGINT AS nid FROM n),
wl AS (SELECT content_id, grp, array_to_string(list_sort(list_distinct(flatten(list(on_pages)))), ',') AS pages FROM k GROUP BY 1, 2),
e AS (SELECT content_id, item, CASE WHEN kind = 'li' AND nth = 1 THEN '<ul data-nid="' || (nid - 1) || '" data-pages="' || pages || '">' ELSE '' END || '<' || kind || ' data-nid="' || nid || '" data-pages="' || array_to_string(list_sort(list_distinct(on_pages)), ',') || '" data-box="' || box || '">'
  || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || kind || '>' || CASE WHEN kind = 'li' AND nth = size THEN '</ul>' ELSE '' END AS piece FROM k JOIN wl USING (content_id, grp)) """


@query(WHOLE + "SELECT content_id, string_agg(piece, '' ORDER BY item) AS html FROM e GROUP BY 1")
def X25_assembled_html(spark, d):
    b, pages = P._blocks(spark, d)
    return V.assembled(b.withColumn("box", F.lit(None).cast(V.BOX)), pages)


@query(P.TURNS + """, x AS (SELECT content_id, nid, length(text) AS n, text_start, (nid % 9) / 8.0 - 0.005 AS x0, (nid % 9) / 8.0 + 0.125 AS x1 FROM o WHERE leaf)
SELECT content_id, nid, concat_ws(',', CASE WHEN nid % 4 = 3 THEN 'page' END, CASE WHEN x1 > 1.01 THEN 'coordinate' END, CASE WHEN nid % 5 = 4 THEN 'span' END) AS problems, round(greatest(x0, 0), 9) AS x0, round(least(x1, 1), 9) AS x1, text_start::BIGINT AS start, (text_start + n + CASE WHEN nid % 5 = 4 THEN 1 ELSE 0 END)::BIGINT AS stop FROM x""")
def X31_regions(spark, d):
    plan = P._plan(spark, d)
    nid, x = F.col("nid"), (F.col("nid") % 9) / 8.0
    box = F.struct((x - 0.005).alias("x0"), F.lit(0.0).alias("y0"), (x + 0.125).alias("x1"), F.lit(1.0).alias("y1"))
    none = lambda kind: F.lit(None).cast(kind)
    regions = plan.where("leaf").select("content_id", "nid", (nid % 4).alias("page"), box.alias("box"), none("array<struct<x:double,y:double>>").alias("ring"), F.lit(0).alias("start"), (F.length("text") + F.when(nid % 5 == 4, 1).otherwise(0)).alias("stop"), none("array<struct<x0:double,y0:double,x1:double,y1:double,start:int,stop:int,conf:double>>").alias("words"))
    pages = plan.select("content_id").distinct().select("content_id", F.explode(F.array(*map(F.lit, range(3)))).alias("page"))
    placed = V.regions_placed(regions, plan, pages)
    return placed.select("content_id", F.col("nid").cast("long").alias("nid"), F.array_join("problems", ",").alias("problems"), F.round("box.x0", 9).alias("x0"), F.round("box.x1", 9).alias("x1"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query(P.TURNS + "SELECT content_id, replace(html, '</p>', ' &lt; x</p>') AS html FROM d")
def X33_sanitised(spark, d):
    bad = F.replace(F.replace("html", F.lit("<p data"), F.lit('<P onclick="a>b" data')), F.lit("</p>"), F.lit("<script>1</script> < <b title='<p>'>x</b><!-- y --></p>"))
    return Z.rendered(P._plan(spark, d)).select("content_id", V.sanitised(bad).alias("html"))


def _stored(spark, d):
    """The documents of X25, stored as one batch in the shared folder: its root."""
    from palimpsest.operators import stored
    from palimpsest.sources.staging import shared_folder

    b, pages = P._blocks(spark, d)
    root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/stored-{uuid.uuid4().hex}"
    stored.store(root, "first", V.assembled(b.withColumn("box", F.lit(None).cast(V.BOX)), pages), pages.select("content_id", F.col("page").cast("int").alias("page")))
    return root


LEFT = WHOLE + f", y AS (SELECT *, {LINES} AS line FROM k), z AS (SELECT * FROM y WHERE line <> '') "


@query(LEFT + "SELECT content_id, string_agg(line, chr(10) || chr(10) ORDER BY item) AS text, count(*) + count(DISTINCT CASE WHEN kind = 'li' THEN grp END) AS nodes, sum(len(on_pages))::BIGINT AS regions FROM z GROUP BY 1")
def K8_stored_documents(spark, d):
    from palimpsest.operators import stored

    root, kind = _stored(spark, d), "content_id long"
    read = lambda name, more: S.published(spark, root, name, f"{kind}, {more}")
    count = lambda name, more: read(name, more).groupBy("content_id").agg(F.count(F.lit(1)).alias(name))
    return read("contents", "html string, text string").select("content_id", "text").join(count("nodes", stored.NODE), "content_id").join(count("regions", stored.REGION), "content_id")


@query("SELECT user_id AS obj_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type FROM events")
def K13_dump_and_load(spark, d):
    """A log is dumped, one owner of three erased, and the dump loaded: all is there as it was."""
    from palimpsest.operators import stored
    from palimpsest.sources.staging import shared_folder

    rows = log(spark, d)
    root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/dump-{uuid.uuid4().hex}"
    stored.dump(root, "whole", rows)
    return stored.load(root, "whole", rows.where("owner_id <> 1")).select("obj_id", "event_id", F.col("version").cast("long").alias("version"), "event_type")
