"""A document's tree as it is stored: numbers and places from materialised paths, HTML with the place of every node in it, groups of items,
and tables. Trees are rows with a path, so all is windows over them; nothing recurses, and all stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E
from palimpsest.operators import documents as D

#: Tags that a tree may hold, digits of a path's segment, and how long a path may be.
TAGS = ("section", "h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "table", "thead", "tbody", "tr", "th", "td", "figure", "figcaption", "blockquote", "pre", "code")
SEGMENT, PATH = 4, 255


def planned(nodes: DataFrame) -> DataFrame:
    """Nodes (content_id, path, tag, text) with nid (from 1, parents before children), depth, leaf, and [text_start, text_end) in the text that
    joins the leaves by a blank line; a container reaches from its first leaf to its last. A null text is empty."""
    w = Window.partitionBy("content_id").orderBy("path")
    leaf = ~F.coalesce(F.lead("path").over(w).startswith(F.concat("path", F.lit("."))), F.lit(False))  # a child would come next
    rows = nodes.withColumns({"nid": F.row_number().over(w), "depth": E.depth(F.col("path")), "leaf": leaf})
    size = F.length(F.coalesce("text", F.lit("")))
    before = F.sum(F.when(F.col("leaf"), size + 2)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("text_start", F.coalesce(before, F.lit(0)))
    ends = D.roll_up(rows.where("leaf").select("content_id", "path", (F.col("text_start") + size).alias("end")), F.max("end").alias("text_end"))
    return rows.join(ends, ["content_id", "path"])


def places(nodes: DataFrame) -> DataFrame:
    """Nodes (content_id, path, text_start, text_end) with a place for each; given are those of leaves, null where a leaf has none.

    A container reaches from its first placed leaf to its last. A subtree without any is empty and has one point, within its parent's range: where the
    next sibling with a place starts, else where the one before ends, else the end of the text. Only the top of an empty subtree has siblings
    to ask, and all below it comes right after it in order of paths, so two windows do, however deep a tree is. A content without placed leaves is at 0.
    """
    leaves = nodes.where("text_start IS NOT NULL").select("content_id", "path", F.col("text_start").alias("start"), F.col("text_end").alias("stop"))
    spans = D.roll_up(leaves, F.min("start").alias("start"), F.max("stop").alias("stop"))
    rows = nodes.drop("text_start", "text_end").join(spans, ["content_id", "path"], "left").withColumn("above", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1))
    beside = Window.partitionBy("content_id", "above").orderBy("path")
    ahead = F.first("start", True).over(beside.rowsBetween(1, Window.unboundedFollowing))
    back = F.last("stop", True).over(beside.rowsBetween(Window.unboundedPreceding, -1))
    end = F.coalesce(F.max("stop").over(Window.partitionBy("content_id")), F.lit(0))
    rows = rows.withColumn("point", F.when(F.col("start").isNull(), F.coalesce(ahead, back, F.when(F.col("above") == "", end))))
    down = F.last("point", True).over(Window.partitionBy("content_id").orderBy("path"))  # the top of the empty subtree is the last with a point
    rows = rows.withColumn("point", down)
    return rows.withColumns({"text_start": F.coalesce("start", "point"), "text_end": F.coalesce("stop", "point")}).drop("start", "stop", "above", "point")


def plan_problems(plan: DataFrame) -> DataFrame:
    """(content_id, nid, problem) of what keeps a plan from being stored: ``tag`` not allowed, ``both`` leaf and container, too many ``siblings``, too long a ``path``."""
    checks = {"tag": ~F.coalesce(F.col("tag").isin(*TAGS), F.lit(False)), "both": ~F.col("leaf") & F.col("text").isNotNull(), "siblings": F.col("path").rlike(rf"(^|\.)\d{{{SEGMENT + 1},}}"), "path": F.length("path") > PATH}
    found = F.array_compact(F.array(*(F.when(c, k) for k, c in checks.items())))
    return plan.select("content_id", "nid", F.explode(found).alias("problem"))


def escaped(text: Column, quote: bool = False) -> Column:
    """Text for HTML; with ``quote`` for an attribute."""
    marks = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quote else [])
    for mark, name in marks:
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _pieces(plan: DataFrame) -> DataFrame:
    """The opening (with a leaf's text) and the closing of every node, with ``at``, by which they sort: a closing comes after all below its node."""
    attr = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f' data-{name}="'), escaped(F.col(name).cast("string"), True), F.lit('"'))).otherwise("") if name in plan.columns else F.lit("")
    text = F.when(F.col("leaf"), F.concat(F.when(F.col("tag") == "pre", "\n").otherwise(""), escaped(F.coalesce("text", F.lit(""))))).otherwise("")
    opened = F.concat(F.lit("<"), "tag", attr("nid"), attr("pages"), attr("date"), attr("aside"), F.lit(">"), text)
    ends = F.array(F.struct(F.col("path").alias("at"), opened.alias("piece")), F.struct(F.concat("path", F.lit(".~")).alias("at"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("piece")))
    return plan.select("content_id", "nid", F.explode(ends).alias("e")).select("content_id", "nid", "e.at", "e.piece")


def rendered(plan: DataFrame) -> DataFrame:
    """(content_id, html) of ``planned`` nodes; columns pages, date and aside, where there are any, become attributes."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"])
    return _pieces(plan).groupBy("content_id").agg(F.array_join(parts, "").alias("html"))


def located(plan: DataFrame) -> DataFrame:
    """(content_id, nid, html_start, html_end): the place of each node in the HTML that ``rendered`` gives, in code points."""
    w = Window.partitionBy("content_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = _pieces(plan).withColumn("stop", F.sum(F.length("piece")).over(w))
    return rows.groupBy("content_id", "nid").agg(F.min(F.col("stop") - F.length("piece")).alias("html_start"), F.max("stop").alias("html_end"))


def enclosure_problems(nodes: DataFrame, html: DataFrame) -> DataFrame:
    """(content_id, nid, problem) of stored nodes (content_id, nid, path, tag, text_start, text_end, html_start, html_end): ``slice`` where the
    HTML at its place isn't its tag, ``parent`` where its places leave those of its parent."""
    at = F.substring(F.col("html"), F.col("html_start") + 1, F.length("tag") + 1)
    cut = nodes.join(html.select("content_id", "html"), "content_id").where(~F.coalesce(at == F.concat(F.lit("<"), "tag"), F.lit(False)))
    up = nodes.select("content_id", F.col("path").alias("above"), *(F.col(c).alias(f"a_{c}") for c in ("text_start", "text_end", "html_start", "html_end")))
    low = nodes.withColumn("above", F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)).join(up, ["content_id", "above"])
    within = (F.col("a_text_start") <= F.col("text_start")) & (F.col("text_end") <= F.col("a_text_end")) & (F.col("a_html_start") <= F.col("html_start")) & (F.col("html_end") <= F.col("a_html_end"))
    named = lambda df, what: df.select("content_id", "nid", F.lit(what).alias("problem"))
    return named(cut, "slice").unionByName(named(low.where(~within), "parent"))


def grouped(items: DataFrame) -> DataFrame:
    """Items (content_id, item, kind) with ``grp``, a number, and ``shape``: list, figure, heading or block.

    List items that follow each other are one list. A figure goes with the caption after it, else a caption with the figure after it: in a run
    where figures and captions take turns, two by two from its start. A caption left alone is a block."""
    w = Window.partitionBy("content_id").orderBy("item")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    before, kind = F.col("before"), F.col("kind")
    drawn = kind.isin("figure", "figcaption")
    rows = items.withColumn("before", F.lag("kind").over(w))
    turns = drawn & F.coalesce(before.isin("figure", "figcaption") & (before != kind), F.lit(False))
    rows = rows.withColumn("island", F.sum((~turns).cast("int")).over(back))
    odd = F.row_number().over(Window.partitionBy("content_id", "island").orderBy("item")) % 2 == 1
    starts = F.when(kind == "li", ~F.coalesce(before == "li", F.lit(False))).when(drawn, odd).otherwise(True)
    rows = rows.withColumn("starts", starts).withColumn("grp", F.sum(F.col("starts").cast("int")).over(back))
    figure = F.max((kind == "figure").cast("int")).over(Window.partitionBy("content_id", "grp")) == 1
    shape = F.when(kind == "li", "list").when(figure, "figure").when(kind.rlike("^h[1-6]$"), "heading").otherwise("block")
    return rows.withColumn("shape", shape).drop("before", "island", "starts")


def table_of(rows: Column, header: Column) -> Column:
    """Rows of cells as struct<header, body>, the first row as header where it is one."""
    has = F.coalesce(header, F.lit(False)) & (F.size(rows) > 0)
    none = F.array().cast("array<array<string>>")
    rest = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    return F.struct(F.when(has, F.slice(rows, 1, 1)).otherwise(none).alias("header"), F.when(has, rest).otherwise(rows).alias("body"))


def table_appended(table: Column, more: Column) -> Column:
    """A table with the rows of the one that goes on from it; a first row that repeats the header's cells goes."""
    rows = F.concat(more["header"], more["body"])
    repeats = F.coalesce((F.size(table["header"]) > 0) & (F.get(rows, F.lit(0)) == F.get(table["header"], F.lit(0))), F.lit(False))
    rest = F.when(repeats, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    return F.struct(table["header"].alias("header"), F.concat(table["body"], rest).alias("body"))


def table_text(table: Column) -> Column:
    """Cells by tabs, rows by line ends."""
    return F.array_join(F.transform(F.concat(table["header"], table["body"]), lambda r: F.array_join(r, "\t", "")), "\n")
