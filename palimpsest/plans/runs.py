"""Registered queries of text runs, lines and blocks, with their DuckDB forms: a conversation as a page, its words as runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import runs as X
from palimpsest.plans.registry import query, t
from palimpsest.sources import paged
from palimpsest.sources import readers as S
from palimpsest.sources.staging import shared_folder

RUNS = """WITH tl AS (SELECT conv_id AS page, turn, unnest(string_split(text, chr(10))) AS said, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM conversations),
wd AS (SELECT page, turn, line, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS k FROM (SELECT *, list_filter(string_split_regex(said, '\\s+'), lambda w: w <> '') AS ws FROM tl)),
ru AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY turn, line, k) - 1 AS seq, text, (k * 30)::DOUBLE AS x, (-(turn * 1000 + line * 14))::DOUBLE AS y, (CASE WHEN turn % 3 = 0 THEN 16 ELSE 10 END)::DOUBLE AS size FROM wd) """


def _runs(spark, d):
    said = t(spark, d, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(F.split("text", "\n")).alias("line", "said"))
    words = F.filter(F.split("said", r"\s+"), lambda w: w != "")
    each = said.select("page", "turn", "line", F.posexplode(words).alias("k", "text"))
    seq = F.row_number().over(Window.partitionBy("page").orderBy("turn", "line", "k")) - 1
    size = F.when(F.col("turn") % 3 == 0, 16.0).otherwise(10.0)
    return each.select("page", seq.alias("seq"), "text", (F.col("k") * 30.0).alias("x"), (-(F.col("turn") * 1000.0 + (F.col("line") + 1) * 14)).alias("y"), size.alias("size"), F.lit(False).alias("bold"))


@query(RUNS + "SELECT page AS content_id, page % 5 + 1 AS number, seq, text, x, y, size, seq % 4 = 1 AS bold FROM ru")
def S10_stored_runs(spark, d):
    value = lambda c: F.col(c).cast("string")
    one = F.when(F.col("seq") % 4 == 1, F.array("text", value("x"), value("y"), value("size"), F.lit("Serif-Bold"))).otherwise(F.array("text", value("x"), value("y"), value("size")))
    pages = _runs(spark, d).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("run")))), lambda s: s["run"]).alias("runs"))
    page = F.struct((F.col("page") % 5 + 1).alias("number"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), "runs")
    raw = pages.select(F.col("page").alias("content_id"), F.to_json(F.struct(F.array(page).alias("pages"))).alias("raw"))
    return X.stored_runs(raw).select("content_id", F.col("number").cast("long").alias("number"), F.col("seq").cast("long").alias("seq"), "text", "x", "y", "size", "bold")


LINES = RUNS + ", ln AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY min(seq)) AS pos, string_agg(text, ' ' ORDER BY seq) AS text, y, max(size) AS size, count(*) AS words FROM ru GROUP BY page, y) "


@query(LINES + "SELECT page, pos, text, 0.0::DOUBLE AS x0, (0.5 * size * length(text))::DOUBLE AS x1, y::DOUBLE AS y, size::DOUBLE AS size, words FROM ln")
def W12_lines(spark, d):
    return X.lines(_runs(spark, d)).select("page", F.col("pos").cast("long").alias("pos"), "text", "x0", "x1", "y", "size", F.size("runs").cast("long").alias("words"))


@query(LINES + """, ga AS (SELECT *, lag(y) OVER w - y AS gap, lag(size) OVER w AS prior FROM ln WINDOW w AS (PARTITION BY page ORDER BY pos)),
le AS (SELECT page, median(gap) FILTER (gap > 0) AS usual FROM ga GROUP BY 1),
bl AS (SELECT ga.*, sum(CASE WHEN prior IS NULL OR gap > 1.55 * usual OR abs(size - prior) > 0.15 * prior THEN 1 ELSE 0 END) OVER (PARTITION BY ga.page ORDER BY pos) AS block FROM ga JOIN le USING (page))
SELECT page, block::BIGINT AS block, CASE WHEN count(*) = 1 AND max(size) > 10 THEN 'h2' ELSE 'p' END AS kind, replace(string_agg(text, chr(10) ORDER BY pos), '-' || chr(10), '') AS text, sum(words)::BIGINT AS words FROM bl GROUP BY 1, 2""")
def X6_blocks(spark, d):
    lines = X.lines(_runs(spark, d))
    sizes = lines.select("page").distinct().select("page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(10.0).alias("body"))
    return X.blocks(lines, sizes).select("page", F.col("block").cast("long").alias("block"), "kind", "text", F.size("words").cast("long").alias("words"))


@query(RUNS + "SELECT page, count(*) AS words, round(avg((seq % 100) / 100.0), 9) AS conf, max(x + 25) AS edge FROM ru WHERE seq % 7 <> 3 GROUP BY 1")
def S11_ocr_rows(spark, d):
    """A page's words as a table of recognised text, of which every seventh row is broken, read back."""
    seq = F.col("seq").cast("string")
    cells = [F.lit("5"), F.col("page").cast("string"), F.lit("1"), F.lit("1"), F.lit("1"), seq, F.col("x").cast("int").cast("string"), F.lit("0"), F.lit("25"), F.when(F.col("seq") % 7 == 3, "broken").otherwise("9"), (F.col("seq") % 100).cast("string"), F.col("text")]
    words = S.ocr_words(_runs(spark, d).select(F.concat_ws("\t", *cells).alias("value")))
    return words.groupBy(F.col("page").cast("long").alias("page")).agg(F.count(F.lit(1)).alias("words"), F.round(F.avg("conf"), 9).alias("conf"), F.max(F.col("left") + F.col("width")).alias("edge"))


def _turns(spark, d):
    """The words of each turn as runs of a page of its own: content_id, number, line, k, text."""
    said = t(spark, d, "conversations").select(F.col("conv_id").alias("content_id"), (F.col("turn") + 1).alias("number"), F.posexplode(F.split("text", "\n")).alias("line", "said"))
    return said.select("content_id", "number", "line", F.posexplode(F.filter(F.split("said", r"\s+"), lambda w: w != "")).alias("k", "text"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


PAGED = RUNS + ", pg AS (SELECT page AS content_id, turn + 1 AS number, line, k, text FROM wd WHERE turn >= 1) "


@query(PAGED + "SELECT content_id, number::BIGINT AS number, count(*) AS runs, string_agg(text, ' ' ORDER BY line, k) AS text, max(k * 30)::DOUBLE AS edge FROM pg GROUP BY 1, 2")
def S9_page_range(spark, d):
    """Pages from the second on of stored payloads, two pages a file; the sizes of half of the runs come without a font, as older payloads had them."""
    value = lambda c: F.col(c).cast("string")
    at = _turns(spark, d).withColumns({"x": F.col("k") * 30.0, "y": -(F.col("line") * 14.0), "size": F.lit(10.0)})
    run = F.when(F.col("k") % 2 == 0, F.array("text", value("x"), value("y"), value("size"))).otherwise(F.array("text", value("x"), value("y"), value("size"), F.lit("Serif")))
    runs = F.transform(F.array_sort(F.collect_list(F.struct("line", "k", run.alias("run")))), lambda s: s["run"])
    pages = at.groupBy("content_id", "number").agg(runs.alias("runs"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.lit(False).alias("failed"))
    folder = _folder(spark, "stored_runs")
    paged.write_pages(pages, folder, 2, paged.payload())
    read = paged.read(spark, "stored_runs", folder, first=2).where(~F.col("failed"))
    text = F.array_join(F.transform("runs", lambda r: r["text"]), " ")
    return read.select("content_id", F.col("number").cast("long").alias("number"), F.size("runs").cast("long").alias("runs"), text.alias("text"), F.array_max(F.transform("runs", lambda r: r["x"])).alias("edge"))


@query(PAGED + "SELECT content_id, number::BIGINT AS number, count(*) AS words, max(k * 30 + 25)::DOUBLE AS edge, string_agg(text, ' ' ORDER BY line, k) AS text FROM pg WHERE (line * 1000 + k) % 7 <> 3 GROUP BY 1, 2")
def S11_page_range(spark, d):
    """Words from the second page on of stored tables of recognised text, three pages a file; every seventh row or so is broken."""
    text = lambda c: F.col(c).cast("string")
    at = _turns(spark, d).withColumns({"line": F.col("line") + 1, "x": F.col("k") * 30})
    cells = [F.lit("5"), text("number"), F.lit("1"), F.lit("1"), text("line"), text("k"), text("x"), F.lit("0"), F.lit("25"), F.when((F.col("line") * 1000 + F.col("k")) % 7 == 3, "broken").otherwise("9"), F.lit("90"), F.col("text")]
    rows = at.select("content_id", "number", F.struct("number", "line", "k", F.concat_ws("\t", *cells).alias("row")).alias("entry"))
    folder = _folder(spark, "ocr_lines")
    paged.write_pages(rows, folder, 3, F.array_join(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["row"]), "\n"))
    words = S.ocr_words(paged.read(spark, "ocr_lines", folder, first=2), "content_id")
    order = F.array_sort(F.collect_list(F.struct("line", "word", "text")))
    return words.groupBy("content_id", F.col("page").cast("long").alias("number")).agg(F.count(F.lit(1)).alias("words"), F.max(F.col("left") + F.col("width")).alias("edge"), F.array_join(F.transform(order, lambda o: o["text"]), " ").alias("text"))
