"""Documents as HTML and back: pages of blocks, joined and grouped items written out with numbers, pages and boxes, reviewed, and read as nodes again;
regions in the document's places; HTML cut down to what a stored tree may hold. Rows in and out; reading HTML is ``sources.markup``'s."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import assembly as A
from palimpsest.functions import expressions as E
from palimpsest.operators import pages as B
from palimpsest.operators import snapshot as Z
from palimpsest.sources import markup as M

#: How far outside its page a coordinate may lie and still be moved to its edge; attributes of a stored tag and of its cells.
SLACK = 0.01
KEPT = ("data-nid", "data-pages", "data-date", "data-aside")
SPANS = ("colspan", "rowspan")
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


# --- attributes


def box_value(parts: Column) -> Column:
    """Fragments (array of struct<page, box, start, stop>) as one attribute."""
    one = lambda f: F.concat_ws(";", f["page"].cast("string"), F.coalesce(A.box_attribute(f["box"]), F.lit("")), F.concat_ws(",", f["start"].cast("string"), f["stop"].cast("string")))
    return F.array_join(F.transform(parts, one), "|")


def boxes_of(value: Column) -> Column:
    """The fragments of such an attribute; what can't be read is left out, a box that isn't four numbers is null."""
    number = lambda p, k: F.try_element_at(F.split(p, ","), F.lit(k)).try_cast("double")
    place = lambda p, k: F.coalesce(F.regexp_extract(F.trim(F.coalesce(F.try_element_at(F.split(p, ","), F.lit(k)), F.lit(""))), r"^\d+$", 0).try_cast("int"), F.lit(0))
    box = lambda p: F.when((F.size(F.split(p, ",")) == 4) & F.forall(F.split(p, ","), lambda v: v.try_cast("double").isNotNull()), F.struct(*(number(p, k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"), 1))))
    split = F.transform(F.split(value, r"\|"), lambda e: F.split(e, ";"))
    fine = F.filter(split, lambda p: (F.size(p) == 3) & F.trim(p[0]).rlike(r"^\d{1,9}$"))
    return F.transform(fine, lambda p: F.struct(F.trim(p[0]).cast("int").alias("page"), box(p[1]).alias("box"), place(p[2], 1).alias("start"), place(p[2], 2).alias("stop")))


def pages_of(value: Column) -> Column:
    """The page numbers of an attribute, each once, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.split(value, ","), lambda p: F.trim(p).rlike(r"^\d{1,9}$")), lambda p: F.trim(p).cast("int"))))


def truth(value: Column) -> Column:
    """An attribute that is there without a value says yes; null if it isn't there."""
    return F.when(value.isNotNull(), F.lower(F.trim(value)).isin("", "true", "1", "yes"))


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f' {name}="'), Z.escaped(value, True), F.lit('"'))).otherwise("")


# --- pages of own HTML: blocks


def blocks_of(read: DataFrame) -> DataFrame:
    """Blocks (content_id, pos, kind, text, level, rows, header, attrs) of ``markup.own_rows``, in order: sections and lists give what they hold, a figure is
    followed by its caption; what stands in any other block is part of none."""
    rows = read.select("content_id", F.explode("rows").alias("r")).select("content_id", "r.*")
    holds = F.col("tag").isin("section", "ul", "ol", "figure")
    shut = rows.where(~holds).select("content_id", F.col("path").alias("above"))
    up = rows.select("content_id", "path", F.explode(E.ancestors(F.col("path"), own=False)).alias("above")).join(shut, ["content_id", "above"], "left_semi").select("content_id", "path").distinct()
    kept = rows.where(~F.col("tag").isin("section", "ul", "ol")).join(up, ["content_id", "path"], "left_anti")
    level = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    text = F.when(F.col("tag").isin("table", "figure"), "").otherwise(F.col("text"))
    return kept.select("content_id", "pos", F.col("tag").alias("kind"), text.alias("text"), level.alias("level"), "rows", "header", "attrs")


# --- documents written out


def serialised(items: DataFrame) -> DataFrame:
    """(content_id, html) of items (content_id, item, kind, text, rows, header, aside, parts: array of struct<page, box, start, stop>).

    Sections follow the headings, items of a list stand in one, a figure holds its caption; every tag has its number, parents first, so one running sum
    numbers them. How many sections a heading ends is told by the last heading of each level: it is open if none of a smaller level came after it.
    """
    rows = Z.grouped(items)
    level = F.when(F.col("shape") == "heading", F.substring("kind", 2, 1).cast("int"))
    first = (F.col("kind") == "figcaption").cast("int")  # a figure comes before the caption it was grouped with
    w = Window.partitionBy("content_id").orderBy("grp", "late", "item")
    rows = rows.withColumns({"level": level, "late": F.when(F.col("shape") == "figure", first).otherwise(0)})
    place = F.row_number().over(w)
    rows = rows.withColumn("place", place)
    w = Window.partitionBy("content_id").orderBy("place")

    def opened(frame) -> list[Column]:
        last = [F.coalesce(F.max(F.when(F.col("level") == k, F.col("place"))).over(frame), F.lit(0)) for k in range(1, 7)]
        return [(c > F.greatest(F.lit(0), *last[:k]) if k else c > 0).cast("int") for k, c in enumerate(last)]

    before, now = opened(w.rowsBetween(Window.unboundedPreceding, -1)), opened(w.rowsBetween(Window.unboundedPreceding, 0))
    ends = F.when(F.col("level").isNotNull(), sum((F.when(F.col("level") <= k, c).otherwise(0) for k, c in enumerate(before, 1)), F.lit(0))).otherwise(0)
    size = F.count(F.lit(1)).over(Window.partitionBy("content_id", "grp"))
    nth = F.row_number().over(Window.partitionBy("content_id", "grp").orderBy("place"))
    rows = rows.withColumns({"ends": ends, "left": sum(now[1:], now[0]), "nth": nth, "size": size, "final": F.lead("place").over(w).isNull()})
    wraps = (F.col("level").isNotNull() | ((F.col("shape") == "list") & (F.col("nth") == 1))).cast("int")
    rows = rows.withColumn("nid", F.sum(1 + wraps).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["page"])))
    joined = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",")
    rows = rows.withColumn("on", F.coalesce(on, F.array().cast("array<int>")))
    of_list = F.array_sort(F.array_distinct(F.flatten(F.collect_list("on").over(Window.partitionBy("content_id", "grp")))))
    number = lambda n: F.concat(F.lit(' data-nid="'), n.cast("string"), F.lit('"'))
    attrs = F.concat(number(F.col("nid")), _attribute("data-aside", F.col("aside")), _attribute("data-pages", joined(F.col("on"))), _attribute("data-box", box_value(F.col("parts"))))
    cell = lambda tag: lambda c: F.concat(F.lit(f"<{tag}>"), Z.escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{tag}>"))
    line = lambda tag: lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell(tag)), ""), F.lit("</tr>"))
    table = Z.table_of(F.coalesce("rows", F.array().cast("array<array<string>>")), F.col("header"))
    head = F.when(F.size(table["header"]) > 0, F.concat(F.lit("<thead>"), F.array_join(F.transform(table["header"], line("th")), ""), F.lit("</thead>"))).otherwise("")
    cells = F.concat(head, F.lit("<tbody>"), F.array_join(F.transform(table["body"], line("td")), ""), F.lit("</tbody>"))
    inner = F.when(F.col("kind") == "table", cells).when(F.col("kind") == "figure", "").otherwise(Z.escaped(F.coalesce("text", F.lit(""))))
    wrap = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("</section>"), F.col("ends").cast("int")), F.lit("<section"), number(F.col("nid") - 1), F.lit(">")))
    wrap = wrap.when((F.col("shape") == "list") & (F.col("nth") == 1), F.concat(F.lit("<ul"), number(F.col("nid") - 1), _attribute("data-pages", joined(of_list)), F.lit(">"))).otherwise("")
    shut = F.when((F.col("kind") == "figure") & (F.col("nth") < F.col("size")), "").otherwise(F.concat(F.lit("</"), "kind", F.lit(">")))
    after = F.when((F.col("shape") == "list") & (F.col("nth") == F.col("size")), "</ul>").when((F.col("kind") == "figcaption") & (F.col("shape") == "figure"), "</figure>").otherwise("")
    tail = F.when(F.col("final"), F.repeat(F.lit("</section>"), F.col("left").cast("int"))).otherwise("")
    piece = F.concat(wrap, F.lit("<"), "kind", attrs, F.lit(">"), inner, shut, after, tail)
    pieces = rows.select("content_id", "place", piece.alias("piece"))
    return pieces.groupBy("content_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda s: s["piece"]), "").alias("html"))


def assembled(blocks: DataFrame, pages: DataFrame, merge_tables: bool = True) -> DataFrame:
    """(content_id, html): read pages as one document. ``blocks``: content_id, page, pos, kind, text, furniture, aside, continues, box; ``pages``:
    content_id, page, failed. What is judged out goes, what goes on over a page is joined, and the rest is grouped and written out."""
    kept = B.judged(blocks, pages).where("verdict = 'kept'")
    parts = B.fragments(kept, pages, merge_tables)
    part = F.struct(F.col("page").cast("int").alias("page"), F.col("box").cast(BOX).alias("box"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    order = F.struct("page", "pos", "piece", "aside", part.alias("part"))
    met = parts.groupBy("content_id", "item").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(order)).alias("all"))
    text = F.array_join(F.transform("all", lambda s: s["piece"]), "")
    rows = F.when(F.col("kind") == "table", F.transform(F.split("text", "\n"), lambda r: F.split(r, "\t")))
    items = met.select("content_id", "item", "kind", text.alias("text"), F.col("all")[0]["aside"].alias("aside"), F.transform("all", lambda s: s["part"]).alias("parts"))
    return serialised(items.withColumns({"rows": rows, "header": F.lit(False)}))


def reviewed(read: DataFrame) -> DataFrame:
    """(content_id, problem) of documents as ``markup.own_rows`` read them: what reading found, no content, leaves that say no page, and boxes
    outside their page."""
    rows = read.select("content_id", F.explode("rows").alias("r")).select("content_id", "r.tag", "r.attrs")
    leaf = ~F.col("tag").isin("section", "ul", "ol", "figure")
    none = F.size(F.coalesce(pages_of(F.try_element_at("attrs", F.lit("data-pages"))), F.array().cast("array<int>"))) == 0
    unplaced = rows.where(leaf & none).select("content_id", F.concat(F.lit("<"), "tag", F.lit("> does not say which page it is on")).alias("problem"))
    boxes = rows.select("content_id", "tag", F.explode(boxes_of(F.try_element_at("attrs", F.lit("data-box")))).alias("f")).where("f.box IS NOT NULL").select("content_id", "tag", "f.box.*")
    inside = (F.lit(0) <= F.col("x0")) & (F.col("x0") <= F.col("x1")) & (F.col("x1") <= 1) & (F.lit(0) <= F.col("y0")) & (F.col("y0") <= F.col("y1")) & (F.col("y1") <= 1)
    outside = boxes.where(~inside).select("content_id", F.concat(F.lit("<"), "tag", F.lit("> has a box outside the page")).alias("problem"))
    empty = read.where(F.size("rows") == 0).select("content_id", F.lit("the document has no content").alias("problem"))
    return read.select("content_id", F.explode("problems").alias("problem")).unionByName(empty).unionByName(unplaced).unionByName(outside)


def extracted(read: DataFrame) -> DataFrame:
    """Nodes (content_id, path, pos, tag, level, text, rows, header, aside, regions) of documents as ``markup.own_rows`` read them.

    A blank leaf goes, with what stands in it, and a list that holds nothing; a numbered list is a list. A section has the level of its first heading. Regions are a
    node's boxes, else its pages without a place."""
    rows = read.select("content_id", F.explode("rows").alias("r")).select("content_id", "r.*")
    holds, table = F.col("tag").isin("section", "ul", "ol", "figure"), F.col("tag") == "table"
    key = ["content_id", "path"]
    above = lambda df: df.select(*key, F.explode(E.ancestors(F.col("path"), own=False)).alias("above"))
    shut = rows.where(~holds).select("content_id", F.col("path").alias("above"))
    inside = above(rows).join(shut, ["content_id", "above"], "left_semi").select(*key).distinct()
    left = rows.where(holds | table | (F.col("text") != "")).join(inside, key, "left_anti")
    full = above(left.where(~F.col("tag").isin("ul", "ol"))).select("content_id", F.col("above").alias("path")).distinct()
    left = left.join(full.withColumn("full", F.lit(True)), key, "left").where(~F.col("tag").isin("ul", "ol") | F.col("full")).drop("full")
    own = F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int"))
    heads = left.where(own.isNotNull()).select("content_id", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("path"), "pos", own.alias("l")).groupBy(*key).agg(F.min_by("l", "pos").alias("under"))
    boxes = boxes_of(F.try_element_at("attrs", F.lit("data-box")))
    whole = F.transform(pages_of(F.try_element_at("attrs", F.lit("data-pages"))), lambda p: F.struct(p.alias("page"), F.lit(None).cast(BOX).alias("box"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("stop")))
    regions = F.when(~F.col("tag").isin("section", "ul", "ol"), F.when(F.size(F.coalesce(boxes, F.array().cast(f"array<struct<page:int,box:{BOX},start:int,stop:int>>"))) > 0, boxes).otherwise(whole))
    tag = F.when(F.col("tag") == "ol", "ul").otherwise(F.col("tag"))
    return left.join(heads, key, "left").select(
        *key, "pos", tag.alias("tag"), F.coalesce(own, F.when(F.col("tag").isin("section", "figure"), F.col("under"))).alias("level"), F.when(~holds, F.col("text")).alias("text"), "rows", "header", F.try_element_at("attrs", F.lit("data-aside")).alias("aside"), regions.alias("regions")
    )


# --- regions and what may be stored


def regions_placed(regions: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions (content_id, nid, page, box, ring, start, stop, words: array of struct<x0, y0, x1, y1, start, stop, conf>; places within the node's text) of planned
    nodes with their box (the ring's, where it has one) and ring moved onto the page, places in the document's text, and ``problems``: page that
    the content hasn't, ring of under three points, coordinate outside the page by more than SLACK, inverted box, span or word outside the node's text."""
    known = pages.select("content_id", "page").distinct().withColumn("known", F.lit(True))
    rows = regions.join(nodes.select("content_id", "nid", "text_start", "text_end"), ["content_id", "nid"]).join(known, ["content_id", "page"], "left")
    off = lambda v: F.coalesce((v < -SLACK) | (v > 1 + SLACK), F.lit(False))
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    sides = ("x0", "y0", "x1", "y1")
    ringed, length = F.col("ring").isNotNull(), F.col("text_end") - F.col("text_start")
    some = lambda c, test: F.coalesce(F.exists(c, test), F.lit(False))
    out = lambda a, b: ~F.coalesce((F.lit(0) <= a) & (a <= b) & (b <= length), F.lit(True))
    boxed = F.when(ringed, E.ring_box(F.transform("ring", lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y"))))).otherwise(F.when(F.col("box").isNotNull(), F.struct(*(unit(F.col(f"box.{s}")).alias(s) for s in sides))))
    rows = rows.withColumn("placed", boxed)
    checks = {
        "page": F.col("known").isNull(),
        "ring": ringed & (F.size("ring") < 3),
        "coordinate": some("ring", lambda p: off(p["x"]) | off(p["y"])) | (~ringed & F.coalesce(sum((off(F.col(f"box.{s}")).cast("int") for s in sides), F.lit(0)) > 0, F.lit(False))) | some("words", lambda v: off(v["x0"]) | off(v["y0"]) | off(v["x1"]) | off(v["y1"])),
        "inverted": F.coalesce((F.col("placed.x0") > F.col("placed.x1")) | (F.col("placed.y0") > F.col("placed.y1")), F.lit(False)),
        "span": out(F.col("start"), F.col("stop")),
        "word": some("words", lambda v: out(v["start"], v["stop"])),
    }
    moved = F.transform("words", lambda v: F.struct(*(unit(v[s]).alias(s) for s in sides), (v["start"] + F.col("text_start")).alias("start"), (v["stop"] + F.col("text_start")).alias("stop"), v["conf"].alias("conf")))
    ring = F.transform("ring", lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y")))
    return rows.select("content_id", "nid", "page", F.col("placed").alias("box"), ring.alias("ring"), (F.col("start") + F.col("text_start")).alias("start"), (F.col("stop") + F.col("text_start")).alias("stop"), moved.alias("words"), F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items()))).alias("problems"))


def sanitised(html: Column) -> Column:
    """HTML with the tags of a stored tree and their attributes alone. Scripts, styles and comments go whole, of other tags what they hold stays; a ``<`` that
    begins no tag is text. Tags that may stay are written anew with the attributes that may, so nothing else can hide in them."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?(-->|$)|<(script|style)\b.*?(</\2\s*>|$)", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"(?s)</?[a-zA-Z](?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<|[^<]++"), F.lit(0))
    names = "|".join(Z.TAGS)

    def one(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, rf"^</?((?i:{names}))(?=[\s/>])", 1))
        fits = F.when(name.isin("td", "th"), "|".join(KEPT + SPANS)).otherwise("|".join(KEPT))
        given = F.regexp_extract_all(token, F.lit(r"(?<=\s)([a-zA-Z-]+=\"[^\"]*\")"), F.lit(1))
        own = F.filter(given, lambda a: F.array_contains(F.split(fits, r"\|"), F.lower(F.substring_index(a, "=", 1))))
        return F.when(token == "<", "&lt;").when(~token.startswith("<"), F.replace(token, F.lit(">"), F.lit("&gt;"))).when(name == "", "").when(token.startswith("</"), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(F.concat(F.lit("<"), name, F.array_join(F.transform(own, lambda a: F.concat(F.lit(" "), a)), ""), F.lit(">")))

    return F.array_join(F.transform(tokens, one), "")


def read_back(documents: DataFrame) -> DataFrame:
    """The nodes of documents (content_id, html) as ``assembled`` writes them."""
    return extracted(M.own_rows(documents))
