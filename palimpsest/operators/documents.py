"""Documents: trees by materialised path, hits by offset and by point, search, and dates over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import expressions as E


def roll_up(nodes: DataFrame, *aggs) -> DataFrame:
    """Aggregates over each node's subtree, by (content_id, path): a node counts for all its ancestors and itself."""
    up = nodes.withColumn("top", F.explode(E.ancestors(F.col("path"))))
    return up.groupBy("content_id", F.col("top").alias("path")).agg(*aggs)


def topmost(nodes: DataFrame, *by: str) -> DataFrame:
    """Nodes none of whose ancestors is in the set too (with the same ``by``): an equi-join on exploded ancestors, never on LIKE."""
    over = nodes.select("content_id", *by, "path", F.explode(E.ancestors(F.col("path"), own=False)).alias("above"))
    held = nodes.select("content_id", *by, F.col("path").alias("above"))
    low = over.join(held, ["content_id", *by, "above"], "left_semi").select("content_id", *by, "path").distinct()
    return nodes.join(low, ["content_id", *by, "path"], "left_anti")


def text_offsets(leaves: DataFrame) -> DataFrame:
    """Leaves with their [text_start, text_end) in the text that joins them by a blank line, in order of nid."""
    w = Window.partitionBy("content_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(w), F.lit(0))
    return leaves.withColumn("text_start", start).withColumn("text_end", start + F.length("text"))


def deepest(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each hit (content_id, hit, at) with the smallest node whose range holds it; of equal ones the larger nid.

    Ranges lie within each other or apart, as a tree's do. The last node that starts at or before a hit holds it, or one of its
    ancestors does (by ``path``; without that column the nodes are leaves), so a hit meets as many nodes as a path has segments."""
    from palimpsest.operators.lineage import latest_before

    tree = "path" in nodes.columns
    start = F.col("text_start").alias("at")
    size = F.col("text_end") - F.col("text_start")
    mark = F.struct((-size).alias("inner"), "nid", F.col("text_end").alias("end"), *(["path"] if tree else [])).alias("found")
    met = latest_before(hits, nodes.select("content_id", start, mark), "content_id", "at", F.floor(F.col("at") / 65536)).where("found IS NOT NULL")
    if not tree:
        return met.where(F.col("at") < F.col("found.end")).select("content_id", "hit", "at", F.col("found.nid").alias("nid"))
    up = met.select("content_id", "hit", "at", F.explode(E.ancestors(F.col("found.path"))).alias("path")).join(nodes.select("content_id", "path", "nid", "text_start", "text_end"), ["content_id", "path"])
    up = up.where((F.col("text_start") <= F.col("at")) & (F.col("at") < F.col("text_end")))
    return up.groupBy("content_id", "hit", "at").agg(F.min_by("nid", F.struct(size.alias("w"), (-F.col("nid")).alias("n"))).alias("nid"))


def celled(boxes: DataFrame, box: Column) -> DataFrame:
    """Boxes (struct<x0, y0, x1, y1>) on the cells (grid, cx, cy) they lie on, 25 at most: a grid's cells measure a quarter to half of a box's longer side."""
    side = F.greatest(box["x1"] - box["x0"], box["y1"] - box["y0"])
    rows = boxes.withColumn("grid", F.coalesce(F.least(F.ceil(1 - F.log2(side)), F.lit(40)), F.lit(40)).cast("int"))
    for k in "xy":
        rows = rows.withColumn(f"c{k}", F.explode(F.sequence(_cell(box[f"{k}0"]), _cell(box[f"{k}1"]))))
    return rows


def _cell(c: Column) -> Column:
    return F.floor(c * F.pow(F.lit(2.0), F.col("grid")))


def on_cells(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Points (page, x, y) with the boxes of their page (``celled``) whose cell they lie on: on each page one cell of each grid that it has.

    Boxes on their cells are never sent to all machines: Spark takes them for as few as the boxes were."""
    placed = points.join(boxes.select("page", "grid").distinct(), "page").withColumns({"cx": _cell(F.col("x")), "cy": _cell(F.col("y"))})
    return placed.join(boxes.hint("merge"), ["page", "grid", "cx", "cy"])


def least_on(points: DataFrame, boxes: DataFrame, holds: Column) -> DataFrame:
    """Each point (page, point, x, y) with the least ``best`` of the boxes (page, box, best and what ``holds`` reads) that hold it.

    Points and boxes meet on cells of grids, see ``celled``; points at one place are looked up once.
    """
    least = F.min("best").alias("best")
    met = on_cells(points.select("page", "x", "y").distinct(), celled(boxes, F.col("box"))).where(holds).groupBy("page", "x", "y").agg(least)
    return points.join(met, ["page", "x", "y"]).groupBy("page", "point").agg(least)


def hit(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Each point (page, point, x, y) with the nid of the smallest shape that holds it: box first, then ring, smallest area first.

    Of equal shapes only the first nid can be it.
    """
    x, y = F.col("x"), F.col("y")
    shapes = regions.groupBy("page", "ring").agg(F.min("nid").alias("nid")).withColumn("box", E.ring_box(F.col("ring")))
    ranked = shapes.withColumn("best", F.struct(F.round(E.ring_area(F.col("ring")), 12).alias("area"), "nid"))
    held = (x >= F.col("box.x0")) & (x <= F.col("box.x1")) & (y >= F.col("box.y0")) & (y <= F.col("box.y1")) & E.point_in_ring(F.col("ring"), x, y)
    return least_on(points, ranked, held).select("page", "point", F.col("best.nid").alias("nid"))


def search(docs: DataFrame, query: str, most: int = 20) -> DataFrame:
    """Top documents that hold all terms: rank is term frequency over 1 + ln(length); the hit is the first occurrence of any term."""
    terms = sorted({t for t in query.lower().split() if t})
    low = F.lower("text")
    words = F.split(low, r"[^\p{L}\p{N}]+")
    all_in = F.lit(bool(terms))
    for t in terms:
        all_in &= F.array_contains(words, t)
    tf = F.size(F.filter(words, lambda w: w.isin(terms)))
    at = F.least(*(F.instr(low, t) for t in terms), F.lit(1 << 30)) - 1
    rank = F.round(tf / (1 + F.log(F.length("text").cast("double"))), 9)
    found = docs.where(all_in).select("doc_id", rank.alias("rank"), at.alias("at"), snippet(F.col("text"), at).alias("snippet"))
    return found.orderBy(F.desc("rank"), F.desc("doc_id")).limit(most)


def snippet(text, at, before: int = 60, after: int = 120):
    start = F.greatest(at - before, F.lit(0))
    end = F.least(at + after, F.length(text))
    cut = E.collapse(F.substring(text, start + 1, end - start))
    return F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(end < F.length(text), "…").otherwise(""))


def interpolate(pages: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Pages (content_id, number, lo, hi) with est_lo, est_hi and conf from the nearest dated page on either side.

    Not for contents whose dated pages aren't in order. Between two: 0.7 less 0.1 a page, 0.2 at least; at an end 0.5, 0.1 at least.
    An estimate with an open side is narrowed to what it shares with its content's prior (content_id, prior_lo, prior_hi;
    one row a content, null is open); if they share no day it stays as it is.
    """
    w = Window.partitionBy("content_id").orderBy("number")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    dated = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    anchor = F.when(dated, F.struct("number", "lo", "hi"))
    got = pages.withColumns({"p": F.last(anchor, True).over(back), "n": F.first(anchor, True).over(ahead)})
    wrong = dated & (F.coalesce(F.col("p.lo") > F.col("lo"), F.lit(False)) | F.coalesce(F.col("p.hi") > F.col("hi"), F.lit(False)))
    got = got.withColumn("ordered", ~F.max(wrong).over(Window.partitionBy("content_id")))
    inverted = F.coalesce(F.col("p.hi") > F.col("n.lo"), F.lit(False))
    lo, hi = F.when(inverted, F.col("p.lo")).otherwise(F.col("p.hi")), F.when(inverted, F.col("n.hi")).otherwise(F.col("n.lo"))
    lo, hi = F.when(F.col("n").isNull(), F.col("p.hi")).otherwise(lo), F.when(F.col("p").isNull(), F.col("n.lo")).otherwise(hi)
    both = F.col("p").isNotNull() & F.col("n").isNotNull()
    dist = F.least(F.col("number") - F.col("p.number"), F.col("n.number") - F.col("number"))
    conf = F.when(both, F.greatest(F.lit(20), 70 - 10 * (dist - 1))).otherwise(F.greatest(F.lit(10), 50 - 10 * (dist - 1))) / 100
    use = ~dated & F.col("ordered") & (F.col("p").isNotNull() | F.col("n").isNotNull())
    got = got.withColumns({"low": lo, "high": hi})
    lo, hi = F.col("low"), F.col("high")
    if priors is not None:
        got = got.join(priors.select("content_id", "prior_lo", "prior_hi"), "content_id", "left")
        low, high = F.greatest("low", "prior_lo"), F.least("high", "prior_hi")
        narrow = (lo.isNull() | hi.isNull()) & F.coalesce(low <= high, F.lit(True))
        lo, hi = F.when(narrow, low).otherwise(lo), F.when(narrow, high).otherwise(hi)
    return got.select("content_id", "number", F.when(dated, F.col("lo")).when(use, lo).alias("est_lo"), F.when(dated, F.col("hi")).when(use, hi).alias("est_hi"), F.when(use, conf).alias("conf"))


def envelope(lo: str, hi: str) -> list:
    """Aggregates: least known minimum and largest known maximum; both null if they contradict."""
    a, b = F.min(lo), F.max(hi)
    fine = F.coalesce(a <= b, F.lit(True))
    return [F.when(fine, a).alias("env_lo"), F.when(fine, b).alias("env_hi")]


def dated_ancestor(nodes: DataFrame, dated: DataFrame) -> DataFrame:
    """Nodes with ``above``, the path of their nearest ancestor among ``dated`` (content_id, path); null if none is."""
    up = nodes.select("content_id", "path", F.explode(E.ancestors(F.col("path"), own=False)).alias("above"))
    near = up.join(dated.select("content_id", F.col("path").alias("above")), ["content_id", "above"], "left_semi").groupBy("content_id", "path").agg(F.max("above").alias("above"))
    return nodes.join(near, ["content_id", "path"], "left")
