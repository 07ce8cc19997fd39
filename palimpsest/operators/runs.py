"""Text runs of pages to lines, blocks and their regions. A page's runs are folded in the order they were drawn; all stays in the JVM, one shuffle by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import layout as Y

#: How far from a line's baseline a run may lie, in its sizes; how far the pen moves for a new word, in points; a glyph's width in sizes.
BASELINE, SPACE, ADVANCE = 0.4, 0.5, 0.5
STRIP = r"(?U)^\s+|\s+$"


def stored_runs(payload: DataFrame) -> DataFrame:
    """Runs (content_id, number, width, height, seq, text, x, y, size, bold, font) of stored payloads (content_id, raw): pages of runs, each run its text, place and size, in
    newer payloads its font too. A page that failed, or a run that isn't four or five values, has none."""
    kind = "pages array<struct<number:int,width:double,height:double,failed:boolean,runs:array<array<string>>>>"
    pages = payload.select("content_id", F.explode(F.from_json("raw", kind)["pages"]).alias("p")).where(~F.coalesce("p.failed", F.lit(False)))
    rows = pages.select("content_id", "p.number", "p.width", "p.height", F.posexplode("p.runs").alias("seq", "r")).where(F.size("r").isin(4, 5))
    number = lambda k: F.try_element_at("r", F.lit(k)).try_cast("double")
    rows = rows.select("content_id", "number", "width", "height", "seq", F.col("r")[0].alias("text"), number(2).alias("x"), number(3).alias("y"), number(4).alias("size"), F.coalesce(F.try_element_at("r", F.lit(5)), F.lit("")).alias("font"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND size IS NOT NULL").withColumn("bold", F.lower("font").contains("bold"))


def lines(runs: DataFrame) -> DataFrame:
    """Lines (page, pos, text, x0, x1, y, size, bold, runs) of runs (page, seq, text, x, y, size, bold); ``page`` tells one page of all from another.

    A run is of the line before it if it lies near that line's first baseline, wherever it stands: drawn order is reading order. A new word begins where the run says so with a
    space or the pen has moved on. Blank runs are passed over. A line is as wide as its text at its largest size.
    """
    said = runs.where(F.regexp_replace("text", STRIP, "") != "")
    pages = said.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "x", "y", "size", "bold"))).alias("all"))

    def step(acc: Column, r: Column) -> Column:
        same = F.coalesce(F.abs(acc["base"] - r["y"]) <= BASELINE * F.greatest(r["size"], F.lit(1.0)), F.lit(False))
        pos = acc["pos"] + F.when(same, 0).otherwise(1)
        return F.struct(F.when(same, acc["base"]).otherwise(r["y"]).alias("base"), pos.alias("pos"), F.concat(acc["marks"], F.array(pos)).alias("marks"))

    begin = F.struct(F.lit(None).cast("double").alias("base"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("marks"))
    folded = pages.select("page", "all", F.aggregate("all", begin, step)["marks"].alias("marks"))
    each = folded.select("page", F.explode(F.arrays_zip("all", "marks")).alias("z")).select("page", F.col("z.marks").alias("pos"), "z.all.*")
    w = Window.partitionBy("page", "pos").orderBy("seq")
    piece = F.regexp_replace("text", STRIP, "")
    spaced = F.coalesce(F.startswith("text", F.lit(" ")) | (F.col("x") > F.lag("x").over(w) + SPACE), F.lit(False)) & F.lag("x").over(w).isNotNull()
    each = each.withColumns({"piece": piece, "lead": F.when(spaced, " ").otherwise("")})
    order = F.array_sort(F.collect_list(F.struct("seq", "lead", "piece", "x", "y", "size")))
    made = each.groupBy("page", "pos").agg(order.alias("runs"), F.min("x").alias("x0"), F.min_by("y", "seq").alias("y"), F.max("size").alias("largest"), F.bool_or("bold").alias("bold"))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["lead"], r["piece"])), "")
    return made.select("page", "pos", text.alias("text"), "x0", (F.col("x0") + ADVANCE * F.col("largest") * F.length(text)).alias("x1"), "y", F.col("largest").alias("size"), "bold", F.transform("runs", lambda r: F.struct(r["piece"].alias("piece"), r["x"].alias("x"), r["y"].alias("y"), r["size"].alias("size"))).alias("runs"))


def blocks(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks (page, block, kind, text, box, words) of ``lines`` on pages (page, width, height, body: the document's usual size).

    ``words`` are the runs that are found one after another in the block's text, with their boxes and [start, stop). A list item's sign goes; blank blocks and
    single glyphs far larger than the text aren't blocks. A page without extent has no boxes.
    """
    split = Y.split_blocks(lines)
    entry = F.struct("pos", "text", "x0", "x1", "y", "size", "bold", "runs")
    made = split.groupBy("page", "block").agg(F.array_sort(F.collect_list(entry)).alias("lines")).join(pages.select("page", "width", "height", "body"), "page")
    first, count = F.col("lines")[0], F.size("lines")
    whole = Y.joined_lines(F.transform("lines", lambda x: x["text"]))
    sign = Y.bullet(first["text"])
    text = F.when(sign.isNull(), whole).otherwise(F.regexp_replace(F.expr("substring(whole, length(sign) + 1)"), r"(?U)^\s+", ""))
    rows = made.withColumns({"whole": whole, "sign": sign}).withColumn("text", text)
    words = F.size(F.filter(F.split(F.regexp_replace(first["text"], STRIP, ""), r"(?U)\s+"), lambda v: v != ""))
    rows = rows.where((F.regexp_replace("whole", STRIP, "") != "") & ~Y.decoration(count, F.col("whole"), first["size"], F.col("body")))
    kind = Y.block_kind(count, first["size"], first["bold"], words, F.col("body"), F.col("sign").isNotNull())
    box = lambda x, y, wide, size: Y.flipped_box(x, y, wide, size, F.col("width"), F.col("height"))
    sides = F.transform("lines", lambda x: box(x["x0"], x["y"], x["x1"] - x["x0"], x["size"]))
    side = lambda f, s: f(F.transform(sides, lambda b: b[s])).alias(s)
    envelope = F.struct(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))
    flat = F.flatten(F.transform("lines", lambda x, i: F.transform(x["runs"], lambda r, k: F.struct(r["piece"].alias("piece"), r["x"].alias("x"), r["y"].alias("y"), r["size"].alias("size"), ((i > 0) & (k == 0)).cast("int").alias("turn")))))

    def find(acc: Column, r: Column) -> Column:
        at = F.position(r["piece"], F.col("text"), acc["next"] + r["turn"] + 1) - 1
        stop = at + F.length(r["piece"])
        got = F.struct(r["piece"].alias("piece"), box(r["x"], r["y"], ADVANCE * r["size"] * F.length(r["piece"]), r["size"]).alias("box"), at.alias("start"), stop.alias("stop"))
        return F.struct(F.when(at >= 0, stop).otherwise(acc["next"] + r["turn"]).alias("next"), F.when(at >= 0, F.concat(acc["found"], F.array(got))).otherwise(acc["found"]).alias("found"))

    none = F.array().cast("array<struct<piece:string,box:struct<x0:double,y0:double,x1:double,y1:double>,start:int,stop:int>>")
    found = F.aggregate(flat, F.struct(F.lit(0).alias("next"), none.alias("found")), find)["found"]
    return rows.select("page", "block", kind.alias("kind"), "text", F.when(sides[0].isNotNull(), envelope).alias("box"), found.alias("words"))
